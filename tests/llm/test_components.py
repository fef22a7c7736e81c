import pytest

from docloom.llm import common, simhash

DOC = "doc_id bigint, text string, lang string, _place string"


def test_rounds_grow_with_the_logarithm_of_a_chain(spark, monkeypatch):
    written = []
    settle = common.settle
    monkeypatch.setattr(simhash, "settle", lambda df: written.append(1) or settle(df))
    edges = spark.range(1, 1001).selectExpr("id AS a", "id + 1 AS b")
    got = simhash.components(edges)
    assert got.count() == 1001 and got.select("label").distinct().collect() == [(1,)]
    assert len(written) < 20


def test_a_folder_that_executors_share_is_needed_off_local_masters():
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, other: other)

    with pytest.raises(ValueError):
        common.shared_folder(Session())


def test_discarded_tables_are_gone(spark):
    import os

    t = common.settle(spark.range(3))
    path = t._docloom_path.removeprefix("file://")
    assert os.path.isdir(path)
    common.discard(t, spark.range(1))
    assert not os.path.exists(path)


def test_one_row_of_each_repeated_doc_id_is_kept(spark):
    df = spark.createDataFrame([(1, "b c", "x", "p"), (1, "a c", "x", "q"), (1, None, "x", "r"), (2, "z", "y", None)], DOC)
    for n in (1, 3):
        assert sorted((r.doc_id, r.text, r._place) for r in simhash.keep_first(df.repartition(n)).collect()) == [(1, None, "r"), (2, "z", None)]
