"""Exact top-k inner-product search by the threshold algorithm over sorted per-dimension lists.

Every partition of candidates is cut into blocks of ``BLOCK`` rows; a block keeps,
for every dimension, its rows in order of that component. Queries come in chunks
of about ``CHUNK``, each sent to the executors once, not once per block. For a
query, the lists are read from the end that the query's weight favours, deeper in
the dimensions of more weight; rows met for the first time are scored in full.

The bound is the most that a row not yet met can score: each of its components
lies at or under the depth reached in that list, and its norm at or under the
block's largest. Reading stops only when the kth score found is over the bound (a
tie could still have a smaller id) or no row is left to meet. The k best so far
go on from block to block, so a later block starts with their kth score and is
left out whole where the bound before any reading is under it. The best k of each
partition are merged per query.

A block and a chunk of queries with their k best are in memory at a time, whatever
the table holds; the chunk's size is fixed by ``CHUNK``, so what is sent at once
does not grow with the table.

Cases: vectors that are null, empty, or hold null or non-finite components take
no part, as query or as candidate; shorter vectors count as padded with zeros;
each row is a candidate of its own, but never for itself, so among rows that
share an id each meets the others; each query row gets its own k rows, so an id
that two query rows share has two lists; ties go to the smaller id; an empty table
gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import bounded_batches, settle

BLOCK, CHUNK, K = 16384, 32768, 5
RESULT = "query_id bigint, asked bigint, vec_id bigint, score bigint, row bigint, scored bigint"


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every usable vector, with x as a double."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select("vec_id", x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0)).where(~bad)
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


def most(weight: np.ndarray, reach: np.ndarray, norm: float) -> float:
    """The largest sum of weight * s over all s with s <= reach in each component and a norm of at most ``norm``; weights are positive.

    The best s is min(t * weight, reach) for some t: components at their reach first, in order of reach / weight,
    and the rest along the weights as far as the norm allows.
    """
    order = np.argsort(reach / weight, kind="stable")
    w, r = weight[order], reach[order]
    at_reach = np.append(0.0, np.cumsum(r * w))
    # A negative reach binds even at t = 0, and then counts in full towards the norm.
    left = norm * norm - np.append(0.0, np.cumsum(r * r))
    rest = np.append(np.cumsum((w * w)[::-1])[::-1], 0.0)
    if left[-1] >= 0:
        return float(at_reach[-1])
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.sqrt(np.maximum(left, 0) / rest)
    # The first place where the next component would not be held back by its reach.
    fits = np.flatnonzero(t[:-1] * w <= r)
    i = int(fits[0]) if len(fits) else len(w)
    return float(at_reach[i] + (t[i] * rest[i] if i < len(w) else 0.0))


class Block:
    """Vectors with their sorted per-dimension lists."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray | None = None):
        self.ids, self.rows = ids, np.arange(len(ids)) if rows is None else rows
        self.v, self.f = vectors, vectors.astype(np.float64)
        self.largest = float(np.abs(self.f).max(initial=0))
        self.norm = float(np.sqrt((self.f * self.f).sum(axis=1).max(initial=0))) * (1 + 1e-9)
        self.lists = np.ascontiguousarray(np.argsort(self.f, axis=0, kind="stable").T.astype(np.int32))  # ascending, (dimensions, rows)

    def scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact integers: in doubles while every sum stays under 2**53, else in 64-bit integers."""
        if self.largest * float(np.abs(q).max(initial=0)) * len(q) < 2**53:
            return (self.f[rows] @ q.astype(np.float64)).astype(np.int64)
        return self.v[rows] @ q

    def search(self, query_row: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best of this block."""
        return self.advance(query_row, q, k)[:2]

    def advance(self, query_row: int, q: np.ndarray, k: int, best: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(ids, scores, rows) of the k best, by score down and id up, of the block and of ``best``; and how many rows were scored.

        ``best`` holds those of earlier blocks. The row ``query_row`` is the query's own and left out.
        """
        ids, score, rows = best or (np.empty(0, np.int64),) * 3
        n, used = len(self.ids), np.flatnonzero(q)
        weight, up = np.abs(q[used]).astype(np.float64), q[used] > 0
        lists = [self.lists[d][::-1] if u else self.lists[d] for d, u in zip(used.tolist(), up.tolist(), strict=True)]
        depth, share = np.zeros(len(used), np.int64), weight / weight.max(initial=1)
        met, count, step = np.zeros(n, bool), 0, 16
        while count < n:
            if len(score) >= k:
                reach = np.array([self.f[x[d], j] for x, d, j in zip(lists, depth.tolist(), used.tolist(), strict=True)])
                bound = most(weight, np.where(up, reach, -reach), self.norm)
                if score[k - 1] > bound + 1e-6 * (1 + abs(bound)):
                    break
            # A list that is read to its end has met every row, as has a query without weights, for which all rows tie.
            depth, step = depth + np.ceil(step * share).astype(np.int64), step * 2
            if not len(used) or depth.max() >= n:
                new = np.flatnonzero(~met)
            else:
                seen = np.zeros(n, bool)
                for x, d in zip(lists, depth.tolist(), strict=True):
                    seen[x[:d]] = True
                new = np.flatnonzero(seen & ~met)
            met[new] = True
            count += len(new)
            new = new[self.rows[new] != query_row]
            ids, score, rows = np.append(ids, self.ids[new]), np.append(score, self.scores(new, q)), np.append(rows, self.rows[new])
            if len(score) > 4 * k:  # only what can be among the k best, ties included, is sorted
                high = np.flatnonzero(score >= np.partition(score, -k)[-k])
                ids, score, rows = ids[high], score[high], rows[high]
            keep = np.lexsort((rows, ids, -score))[:k]
            ids, score, rows = ids[keep], score[keep], rows[keep]
        return ids, score, rows, count


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out, at = np.zeros((len(sizes), width), np.int64), np.repeat(np.arange(len(sizes)), sizes)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _found(rows: DataFrame, asked: pa.Table, width: int, k: int, block: int) -> DataFrame:
    """The k best of each partition for each of the asked rows; see RESULT."""
    columns = [asked.column(c).combine_chunks() for c in ("vec_id", "row", "v")]
    shared = rows.sparkSession.sparkContext.broadcast((columns[0].to_numpy(), columns[1].to_numpy(), _matrix(columns[2], width)))
    names = [x.split()[0] for x in RESULT.split(", ")]

    def run(batches):
        query_ids, query_rows, queries = shared.value
        best: list[tuple | None] = [None] * len(queries)
        scored, held, size = np.zeros(len(queries), np.int64), [], 0

        def take():
            b = Block(*(np.concatenate(x) for x in zip(*held, strict=True)))
            for i, q in enumerate(queries):
                *found, n = b.advance(int(query_rows[i]), q, k, best[i])
                best[i] = tuple(found)
                scored[i] += n

        for b in batches:
            held.append((b.column(0).to_numpy(), _matrix(b.column(2), width), b.column(1).to_numpy()))
            size += b.num_rows
            if size >= block:
                take()
                held, size = [], 0
        if size:
            take()
        for at in range(0, len(queries), 4096):
            part = [(i, x) for i, x in enumerate(best[at : at + 4096], at) if x is not None]
            if part:
                sizes = [len(x[0]) for _, x in part]
                of = np.repeat([i for i, _ in part], sizes)
                first = np.append(True, of[1:] != of[:-1])  # a query's count stands in its first row only
                made = [query_ids[of], query_rows[of], *(np.concatenate([x[c] for _, x in part]) for c in range(3)), scored[of] * first]
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in made], names=names)

    return rows.select("vec_id", "row", "v").mapInArrow(run, RESULT)


def best(vectors: DataFrame, every: int = 50, k: int = K, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """The k best of each partition of candidates for each row whose vec_id is divisible by ``every``; see RESULT."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    parts = max(spark.sparkContext.defaultParallelism, -(-vectors.count() // (64 * block)))
    # Written, so that a row's number is the same wherever it is read.
    rows = settle(quantised(vectors).repartition(parts).withColumn("row", F.monotonically_increasing_id()))
    is_asked = F.col("vec_id") % every == 0
    n, width = rows.agg(F.count_if(is_asked), F.max(F.size("v"))).first()
    chunks, out = max(1, -(-n // chunk)), None
    for c in range(chunks):
        mine = F.pmod(F.xxhash64("row"), F.lit(chunks)) == c
        made = _found(rows, rows.where(is_asked & mine).select("vec_id", "row", "v").toArrow(), width or 1, k, block)
        made = settle(made) if chunks > 1 else made
        out = made if out is None else out.unionByName(made)
    return out


def search(vectors: DataFrame, every: int = 50, k: int = K, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for each row whose vec_id is divisible by ``every``."""
    rank = F.row_number().over(Window.partitionBy("asked").orderBy(F.col("score").desc(), "vec_id", "row"))
    ranked = best(vectors, every, k, block, chunk).withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def oracle(every: int = 50, k: int = K) -> str:
    return f"""
    WITH e AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
    v AS (SELECT r, vec_id, list_transform(x, lambda c: CAST(floor(256 * c) AS BIGINT)) AS v FROM e
      WHERE len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(x) > 0),
    u AS (SELECT r, vec_id, unnest(v) AS a, generate_subscripts(v, 1) AS i FROM v),
    s AS (SELECT q.r AS q, q.vec_id AS query_id, c.r, c.vec_id, CAST(sum(q.a * c.a) AS BIGINT) AS score FROM u q JOIN u c ON q.i = c.i AND q.r <> c.r
      WHERE q.vec_id % {every} = 0 GROUP BY q.r, q.vec_id, c.r, c.vec_id),
    k AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
    SELECT * FROM k WHERE rank <= {k}"""
