import os
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from docloom.llm import packing, secrets, simhash, toxicity
from docloom.llm.common import table
from tests.llm.test_simhash import brute
from tests.llm.test_text_operators import brute_rules

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_run_equals_brute_force(spark):
    docs = [r.asDict() for r in table(spark, SF, "documents").collect()]
    model = toxicity.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    left = [d for d in docs if not toxicity.Scorer(model)(d["text"])[2]]
    judged = {r.doc_id: r.kept for r in entry.queries()["op1_quality_rules"](spark, SF).collect()}
    assert not any(judged[d["doc_id"]] for d in left if brute_rules(d["text"])[5])
    left = [d for d in left if judged[d["doc_id"]]]
    classes = brute([(d["doc_id"], d["text"]) for d in left])
    left = [d for d, c in zip(left, classes, strict=True) if d["doc_id"] == c]
    texts = {d["doc_id"]: secrets.redact(d["text"], secrets.spans(d["text"])) for d in left}
    ids = dict(zip(texts, packing.tokenizer().encode(list(texts.values()), packing.END_ID), strict=True))
    got = defaultdict(list)
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r.doc_id].append(r)
    assert set(got) == set(ids)
    for i, rows in got.items():
        assert sum(r.length for r in rows) == len(ids[i])
        assert all(zlib.crc32(np.ascontiguousarray(ids[i][r.start : r.start + r.length]).tobytes()) == r.ids_crc32 for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_stages_return_the_columns_of_documents(spark):
    docs = table(spark, SF, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "near-duplicates", "secret scans", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", ["op1_quality_rules", "op9_topk_search", "op10_warc_fixity"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    want = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(str, want.fetchall()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_fingerprints_of_whole_documents(spark):
    rows = entry.queries()["op3_simhash"](spark, SF).collect()
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    assert len(rows) == len(docs)
    assert all(r.fingerprint == f"{simhash.fingerprint(docs[r.doc_id]):016x}" for r in rows)
    ordered = [(r.doc_id, docs[r.doc_id]) for r in rows]
    assert [r.component_id for r in rows] == brute(ordered)
