import random

from pyspark.sql import functions as F

from docloom.operators import brackets, censor, fields, model, review, sections, style
from docloom.sources import documents


def test_keys_and_menus(spark):
    df = spark.createDataFrame([(k,) for k in ("c", "X", "n", "w", "tab", "z", None)], "k string")
    assert [r.a for r in df.select(review.key_action(F.col("k")).alias("a")).collect()] == ["confirm", "reject", "add_value", "edit_context", "skip", None, None]
    df = spark.createDataFrame([(k,) for k in ("f", "B", "o", "z")], "k string")
    assert [r.c for r in df.select(review.category_for_key(F.col("k")).alias("c")).collect()] == ["fake-number", "bad-indent-level", "other", None]
    df = spark.createDataFrame([(k,) for k in ("f", "H", "k", "l", "m")], "k string")
    assert [r.t for r in df.select(review.retype_label(F.col("k")).alias("t")).collect()] == ["PERCENT", "EMAIL", "ENTITY", "other", None]


def test_heading_levels_of_both_rules(spark):
    ids = {"Title": 1, "Heading2Char": 2, "HeadingFoo": 1, "heading  3": 3, "Heading0": 1, "Heading12": 6, "heading256": None, "Heading00002": 2, "My heading 2": None, "Subtitle": None, "": None}
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    assert {r.id: r.l for r in df.select("id", style.heading_level(F.col("id")).alias("l")).collect()} == ids
    assert {i: documents.heading_level(i) for i in ids} == ids


def test_suggestion_lines(spark):
    df = spark.createDataFrame([(True, "ORG"), (True, None), (False, None), (None, None)], "predicted boolean, predicted_reason string")
    got = [r.s for r in df.select(model.suggestion_line("weird", "fine").alias("s")).collect()]
    assert got == ["suggestion: weird — ORG", "suggestion: weird — (reason uncertain)", "suggestion: fine", None]


def test_meter_lines(spark):
    log = [("styling", i, i % 4 == 0, i % 5 == 0, "a" if i % 20 == 0 else None, "a" if i % 40 == 0 else "b") for i in range(100)]
    df = spark.createDataFrame(log, "task string, seq bigint, predicted boolean, actual boolean, predicted_reason string, actual_reason string")
    text = lambda d: model.meter(d).select(model.meter_text("fine", "weird").alias("t")).first().t
    assert text(df) == "styling model — last 100 prediction(s)\n  balanced accuracy: 50.0%\n  fine 60/80 · weird 5/20 (positives: 20)\n  reason: 3/5 correct"
    none = text(df.where("seq < 8").withColumn("predicted_reason", F.lit(None).cast("string")))
    assert none.endswith("\n  reason: (no confident reason predictions yet)") and "\n  not enough data yet (need 100 predictions and 5 positives; have 8, 2 positive)\n" in none


def test_paragraphs_keep_lone_returns_and_see_any_blank(spark):
    docs = spark.createDataFrame([(1, "a\rb\n \nc\r\n\r\nd")], "doc_id bigint, text string")
    assert [r.text for r in fields.paragraphs(docs).orderBy("block_index").collect()] == ["a\rb", "c", "d"]


def names_in_order(slugs):
    taken, out = set(), []
    for s in slugs:
        k = 1
        while (name := s if k == 1 else f"{s}-{k}") in taken:
            k += 1
        taken.add(name)
        out.append(name)
    return out


def test_snippet_names_equal_naming_one_by_one(spark):
    r = random.Random(7)
    for seed in range(3):
        texts = [r.choice(["[a]", "[a] 2", "[a] 3", "[a] 2 2", "[b]", "[c] 9", "]"]) for _ in range(60)]
        rows = [(1, i, "paragraph", None, t, None) for i, t in enumerate(texts)]
        b = spark.createDataFrame(rows, fields.BLOCKS)
        got = [x.path for x in sections.snippet_index(brackets.hits(b, fields.fields(b)), b).orderBy("block_index").collect()]
        slugs = ["-".join(t.replace("[", "").replace("]", "").split()) or "span" for t in texts]
        assert got == [f"snippets/{n}.md" for n in names_in_order(slugs)], seed


def test_many_ranges_of_one_slug(spark):
    b = spark.createDataFrame([(1, i, "paragraph", None, "Pay [x]", None) for i in range(4000)], fields.BLOCKS)
    got = sections.snippet_index(brackets.hits(b, fields.fields(b)), b)
    assert got.select("path").distinct().count() == 4000


def test_censoring_does_not_depend_on_the_order_of_rows(spark):
    texts = [f"Mail a{i % 7}@b.com and c{i % 5}@d.com, pay $1{i % 3}.00 now" for i in range(80)] + ["plain"] * 20
    schema = "doc_id bigint, block_index int, cell_row int, cell_col int, kind string, heading_level tinyint, text string"
    rows = [(i % 4, i, None, None, "paragraph", None, t) for i, t in enumerate(texts)]
    allowed = spark.createDataFrame([("a1@b.com",), ("$10.00",)], "value string")
    decisions = [(i % 4, i, f"c{i % 5}@d.com", "confirm", "EMAIL", "group", False, None, None, None, None, None) for i in range(12)] + [(0, 99, "now", "confirm", "other", "group", True, None, None, None, None, None), (1, 100, "Mail", "confirm", "ID", "occurrence", False, 1, None, None, 0, 4)]
    kind = "doc_id bigint, seq bigint, value string, verdict string, final_type string, scope string, user_added boolean, block_index int, cell_row int, cell_col int, start int, `end` int"
    seen = set()
    for n in (1, 3, 7):
        random.Random(n).shuffle(rows)
        found = censor.detect(spark.createDataFrame(rows, schema).repartition(n), allowed=allowed)
        censored = sorted((r.doc_id, r.block_index, r.text) for r in censor.censored(found).collect())
        applied = sorted((r.doc_id, r.block_index, r.text) for r in censor.apply_decisions(found, spark.createDataFrame(decisions, kind)).collect())
        assert len(censored) == len(applied) == 100
        assert all("a1@b.com" in t for _, i, t in censored if i < 80 and i % 7 == 1) and not any("c1@d.com" in t for *_, t in censored)
        seen.add((str(censored), str(applied)))
    assert len(seen) == 1
    assert dict((i, t) for _, i, t in applied)[1].startswith("REDACTED_ID_001 a1@b.com")
