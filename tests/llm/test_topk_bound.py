import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>"


def test_bound_is_the_largest_sum_under_reach_and_norm():
    r = np.random.default_rng(0)
    for _ in range(150):
        d = r.integers(1, 6)
        weight, reach = r.random(d) + 0.05, r.normal(0.2, 0.6, d)
        if (np.minimum(reach, 0) ** 2).sum() > 1:
            continue
        tried = (np.minimum(t * weight, reach) for t in np.linspace(0, 50, 3001))
        best = max(x @ weight for x in tried if x @ x <= 1 + 1e-9)
        bound = topk.most(weight, reach, 1.0)
        assert best <= bound + 1e-9 and bound - best < 0.05


def test_carried_threshold_leaves_whole_blocks_out():
    r = np.random.default_rng(1)
    near = r.normal(0, 5, (200, 16)).astype(np.int64)
    near[:, 0] += 3000
    far = r.normal(0, 5, (4000, 16)).astype(np.int64)
    q = near[0]
    *best, n = topk.Block(np.arange(200), near).advance(0, q, 5)
    assert n <= 200
    *again, n = topk.Block(np.arange(200, 4200), far, np.arange(200, 4200)).advance(0, q, 5, tuple(best))
    assert n == 0 and all(np.array_equal(a, b) for a, b in zip(best, again, strict=True))


def test_stop_is_by_the_bound_on_vectors_of_few_directions():
    """Components of falling size, as of embeddings turned to their principal axes: most rows are never scored."""
    r = np.random.default_rng(2)
    v = (r.normal(0, 1, (20_000, 32)) * 2000 / (1 + np.arange(32)) ** 2).astype(np.int64)
    b, share = topk.Block(np.arange(len(v)), v), []
    for i in range(0, 400, 20):
        ids, score, _, n = b.advance(i, v[i], 5)
        want = v @ v[i]
        want[i] = -(10**15)
        best = np.lexsort((np.arange(len(v)), -want))[:5]
        assert ids.tolist() == best.tolist() and score.tolist() == want[best].tolist()
        share.append(n / len(v))
    assert np.mean(share) < 0.2


@pytest.mark.parametrize("chunk", [2, 100])
def test_rows_that_share_an_id_equal_the_sql(spark, chunk):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(0, 0.3, 6).astype(np.float32).tolist()) for i in [*range(120), 0, 50, 50, 7, 7]]
    rows += [(100, rows[100][1]), (150, [0.0] * 6), (200, None), (None, [1.0] * 6)]
    df = spark.createDataFrame([(*x, "x", 1) for x in rows], SCHEMA + ", score string, row int").repartition(4)
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in topk.search(df, block=16, chunk=chunk).collect())
    con = duckdb.connect()
    embeddings = pa.table({"vec_id": [x[0] for x in rows], "embedding": pa.array([x[1] for x in rows], pa.list_(pa.float32()))})
    con.register("embeddings", embeddings)
    assert got == sorted(con.execute(topk.oracle()).fetchall())


def test_work_is_reported(spark):
    df = spark.range(300).select(F.col("id").alias("vec_id"), F.array(*[(F.hash("id", F.lit(k)) / 2**31).cast("float") for k in range(4)]).alias("embedding"))
    work = topk.best(df).groupBy("asked").agg(F.count("*").alias("n"), F.sum("scored").alias("scored")).collect()
    assert len(work) == 6 and all(0 < x.scored <= 300 for x in work)
