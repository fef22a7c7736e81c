from pyspark.sql import functions as F

from docloom.functions import spans


def test_long_runs_of_capitalised_words(spark):
    """A repeated group that Java matches by recursion ran out of stack, which ends an executor."""
    n = 30_000
    texts = ["x " + "Abc " * n + "end", "Foo " + "The " * 2_000 + "x", "The An And Foo Bar An Any", "The " * n, "Foo And Annex", "Foo Per Person", "Any-Such"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: [(s.start, s.end) for s in r.s] for r in df.select("i", F.expr(spans.entity_sql("text")).alias("s")).collect()}
    assert got == {0: [(2, 1 + 4 * n)], 1: [(0, 3)], 2: [(11, 18)], 3: [], 4: [(0, 13)], 5: [(0, 14)], 6: []}
    person = df.where("i = 0").select(F.concat(F.lit("Dr. "), F.substr("text", F.lit(3))).alias("text")).select(F.expr(spans.detector_sql("text", spans.PERSON)).alias("s")).first().s
    assert [(s.start, s.end) for s in person] == [(0, 3 + 4 * n)]
