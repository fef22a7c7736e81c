"""run() against a plain version whose near copies link at a Jaccard similarity of 0.8 on five-word shingles, as the pipeline's stage does."""

import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from docloom.llm import packing, secrets, toxicity
from docloom.llm.common import table
from tests.llm.test_near import brute
from tests.llm.test_text_operators import brute_rules

SF = "/root/testdata/sf0.001"


def expected(spark, folder):
    """ids of each document that is left, by id, from a plain run over all documents; and the pieces that run() gives."""
    docs = [r.asDict() for r in table(spark, folder, "documents").collect()]
    model = toxicity.train(table(spark, folder, "documents"), table(spark, folder, "labels"))
    left = [d for d in docs if not toxicity.Scorer(model)(d["text"])[2]]
    judged = defaultdict(list)
    for r in entry.queries()["op1_quality_rules"](spark, folder).collect():
        judged[r.doc_id].append(r.kept)
    assert not any(all(judged[d["doc_id"]]) for d in left if brute_rules(d["text"])[5])
    left = [d for d in left if any(judged[d["doc_id"]]) and not brute_rules(d["text"])[5]]
    named = [d for d in left if d["doc_id"] is not None]
    first = {}
    for d, c in sorted(zip(named, brute([(d["doc_id"], d["text"]) for d in named]), strict=True), key=lambda x: x[0]["text"]):
        if d["doc_id"] == c:
            first.setdefault(c, d["text"])
    first |= {None: d["text"] for d in left if d["doc_id"] is None}  # at most one here
    clean = [secrets.redact(t, secrets.spans(t)) for t in first.values()]
    ids = packing.tokenizer().encode(clean, packing.END_ID)
    return dict(zip(first, ids, strict=True)), corpus_pipeline.run(spark, folder).collect()


def check(ids, rows):
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r)
    assert set(got) == set(ids)
    for i, pieces in got.items():
        pieces.sort(key=lambda r: r.start)
        assert [r.start for r in pieces] == np.cumsum([0, *[r.length for r in pieces]])[:-1].tolist()
        assert sum(r.length for r in pieces) == len(ids[i])
        assert all(zlib.crc32(np.ascontiguousarray(ids[i][r.start : r.start + r.length]).tobytes()) == r.ids_crc32 for r in pieces)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_run_equals_the_plain_version(spark):
    check(*expected(spark, SF))


def test_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows and ids, clashing columns."""
    r, words = random.Random(4), [f"{a}{b}" for a in "the of and ing tion er ou sh la que".split() for b in "st re nd ha en".split()]
    text = lambda n: "the of and in to " + " ".join(r.choice(words) for _ in range(n))
    docs = [(i, text(r.randint(60, 200))) for i in range(60)]
    docs += [docs[3], (4, text(90)), (60, docs[5][1] + " more words"), (None, text(80)), (61, None), (62, ""), (63, "the of and in to " + " ".join(f"{r.choice(words)}{k}" for k in range(60_000))), (64, "token=Zk8Qp2vXw9Lm4Rt7Yc1N " + text(80))]
    rows = [(i, t, None, None, None, "clash", 1) for i, t in docs]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, start string, _kept int"
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 1), (41, None, None)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    ids, rows = expected(spark, str(tmp_path))
    check(ids, rows)
    assert {None, 63, 64} <= set(ids) and not {60, 61, 62} & set(ids)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
