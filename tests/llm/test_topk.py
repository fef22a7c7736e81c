import random

import numpy as np
import pytest

from docloom.llm import topk


def brute(rows, every, k):
    out = []
    for q, a in rows:
        if q is None or a is None or q % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in rows if i is not None and i != q and b is not None)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [7, 2048])
def test_matches_brute_force(spark, block):
    r = random.Random(2)
    vectors = [(i, [r.gauss(0, 0.3) for _ in range(8)]) for i in range(200)] + [(i, [0.5] * 8) for i in range(200, 230)]
    floors = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in vectors]
    bad = [(1000, None), (1050, [1.0, None]), (1100, [float("nan")] * 8), (1150, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (1200, [])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in vectors + bad], "vec_id bigint, embedding array<float>, label int, score string").repartition(3)
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in topk.search(df, block=block).collect())
    assert got == brute(floors, 50, 5)


def test_early_stop_reads_less_than_all():
    v = np.zeros((5000, 4), np.int64)
    v[:, 0] = np.arange(5000)
    b = topk.Block(np.arange(5000), v)
    seen = []
    score = b.scores
    b.scores = lambda rows, q: seen.append(len(rows)) or score(rows, q)
    ids, scores = b.search(-1, np.array([3, 0, 0, 0]), 5)
    assert ids.tolist() == [4999, 4998, 4997, 4996, 4995] and scores[0] == 3 * 4999 and sum(seen) < 100


def test_short_vectors_few_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 1.0]), (1, [2.0]), (1, [2.0])], "vec_id bigint, embedding array<float>")
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in topk.search(df).collect())
    assert got == [(0, 1, 1, 256 * 512), (0, 2, 1, 256 * 512)]
    assert topk.search(df.limit(0)).count() == 0
