import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from docloom.llm import packing, queries

DOC = "doc_id bigint, text string, start string, source string"


def sequences(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.sequence_id].append(r)
    return {s: sorted(rs, key=lambda r: r.offset) for s, rs in out.items()}


def test_cuts_fall_at_sentences_and_documents(spark):
    texts = ["one two three. " * n for n in (900, 5, 3000, 40, 1700)] + ["plain words without an end " * 60]
    df = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], DOC).coalesce(1)
    tk = packing.tokenizer()
    ids = tk.encode(texts, packing.END_ID)
    for r in packing.pack(df).collect():
        end = r.start + r.length
        assert end == r.doc_tokens or tk.sentence_end[ids[r.doc_id][end - 1]]


def test_a_passage_over_a_window_is_cut_within(spark):
    text = "word " * 20_000
    rows = packing.pack(spark.createDataFrame([(1, text, "", "")], DOC)).collect()
    ids = packing.tokenizer().encode([text], packing.END_ID)[0]
    pieces = sorted(rows, key=lambda r: r.start)
    assert [r.start for r in pieces] == np.cumsum([0, *[r.length for r in pieces]])[:-1].tolist() and sum(r.length for r in pieces) == len(ids)
    assert max(r.length for r in pieces) <= packing.WINDOW and len(pieces) <= len(ids) // packing.WINDOW + 2


def test_rests_of_partitions_share_sequences(spark):
    """60 partitions of one short document each leave few sequences, with every id in one piece and none between."""
    df = spark.range(0, 600, 10, 60).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words here. "), F.repeat(F.lit("x y z. "), 40)).alias("text"))
    rows = packing.pack(df).collect()
    made = sequences(rows)
    total = sum(r.length for r in rows)
    assert len(made) <= -(-total // packing.WINDOW) + 1 and {r.doc_id for r in rows} == set(range(0, 600, 10))
    for rs in made.values():
        assert [r.offset for r in rs] == np.cumsum([0, *[r.length for r in rs]])[:-1].tolist()
    assert all(r.ids_crc32 == zlib.crc32(packing.tokenizer().encode(["some words here. " + "x y z. " * 40], packing.END_ID)[0][r.start : r.start + r.length].tobytes()) for r in rows)


def test_padding_is_small_over_many_partitions(spark):
    r = np.random.default_rng(4)
    rows = [(i, " ".join("words and more of them." if k % 5 == 0 else "plain" for k in range(int(r.integers(1, 900)))), "", "") for i in range(700)]
    made = sequences(packing.pack(spark.createDataFrame(rows, DOC).repartition(40)).collect())
    sizes = [sum(r.length for r in rs) for rs in made.values()]
    pad = sum(packing.WINDOW - s for s in sizes if s & (s - 1))
    assert max(sizes) <= packing.WINDOW and pad < 0.03 * sum(sizes)


def test_query_keeps_added_tokens_and_the_operator_reads_them_as_text(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = ["before <|endoftext|> after", "中文 <|startoftext|> é", None]
    df = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], DOC)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    tk = Tokenizer.from_file(packing.default_tokenizer())
    for special, found in ((False, queries.op2_packing(spark, str(tmp_path))), (True, packing.pack(df))):
        tk.encode_special_tokens = special
        want = {i: [*tk.encode(t or "", add_special_tokens=False).ids, packing.END_ID] for i, t in enumerate(texts)}
        got = {r.doc_id: (r.ids_crc32, r.length, r.doc_tokens) for r in found.collect()}
        assert got == {i: (zlib.crc32(np.array(x, "<u4").tobytes()), len(x), len(x)) for i, x in want.items()}
