"""SimHash near-dedup by bit-sliced comparison.

Every text gets a 64-bit fingerprint from the XXH64 hashes of its word shingles.
Fingerprints that differ in at most RADIUS = 2 bits are linked, and a class is
what can be reached over links.

1. Equal fingerprints are one node, so exact copies cost one row.
2. Two fingerprints within 2 bits agree on one of 3 bands of bits. Nodes meet in
   buckets (band mask, value). A bucket over ``HOT`` nodes is refined: its nodes
   agree on the band, so the rest again has 3 bands of which one agrees. After
   five levels all but 10 bits agree, so at most 2**10 nodes can share a bucket
   and no bucket is cut.
3. Within a bucket, nodes are compared bit-sliced: bit b of all lanes lies in one
   packed plane; each lane is compared with the one s places on by an exclusive
   or of planes; saturating counters add the planes by carry-save; a block is
   abandoned once all its lanes exceed the radius. Links join a forest, so a
   bucket returns fewer links than it has nodes.
4. Classes come from contracting edges towards the smallest doc_id: pointers to
   the smallest neighbour are doubled until they reach a root, so rounds and the
   steps of a round grow with the logarithm of a class's size and length. Each
   step is written to the shared folder and the last one deleted; nothing is
   collected.

Cases: null and empty texts have fingerprint zero and link like others; a text
with fewer words than a shingle is one shingle; repeated rows and ties share
their class; rows without a doc_id take no part in links and have a null class
(keep_first() keeps them); rows that share a doc_id are one document, of which
keep_first() keeps the row with the smallest text (null first); an empty
table gives an empty table; extra columns are ignored by classes() and kept by
keep_first().
"""

from __future__ import annotations

import re
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import bounded_batches, discard, settle, with_columns

RADIUS, SHINGLE, SEED = 2, 3, 42
HOT, LEVELS, LANES = 256, 5, 4096
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Unsigned fingerprint; bits are counted over blocks of shingles."""
    import xxhash

    words = _WORD.findall((text or "").translate(_LOWER))
    if not words:
        return 0
    digest, counts, n = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64), max(1, len(words) - width + 1)
    shingles = map(" ".join, zip(*(islice(words, i, None) for i in range(width)), strict=False)) if len(words) >= width else iter([" ".join(words)])
    for _ in range(0, n, 8192):
        h = np.array([digest(s, SEED) for s in islice(shingles, 8192)], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint's bits as a signed long."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return with_columns(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, fp bigint")


# Bit-sliced comparison -------------------------------------------------------


def _planes(bits: np.ndarray) -> np.ndarray:
    """(lanes, bits) to (bits, lanes / 8) packed planes."""
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")


def unpacked(fp: np.ndarray) -> np.ndarray:
    """Fingerprints to (lanes, bits)."""
    return np.unpackbits(np.ascontiguousarray(fp.astype("<u8")).view(np.uint8).reshape(len(fp), -1), axis=1, bitorder="little")


def exceeding(a: np.ndarray, b: np.ndarray, dead: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Packed lanes whose planes a and b differ in more than ``radius`` bits, or that were dead before.

    ``count`` holds the bits of radius + 1 or fewer differences per lane, by carry-save addition; a carry
    out of it, or a value over the radius, marks the lane as over.
    """
    size = (radius + 1).bit_length()
    count = [np.zeros_like(dead) for _ in range(size)]
    over = dead.copy()
    for plane in range(len(b)):
        carry = a[plane] ^ b[plane]
        for k in range(size):
            carry, count[k] = count[k] & carry, count[k] ^ carry
        over |= carry
        if plane % 8 == 7:
            now = over | _greater(count, radius)
            if (now == 255).all():
                return now
    return over | _greater(count, radius)


def _greater(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter exceeds the radius, from the highest bit down."""
    more, equal = np.zeros_like(count[0]), np.full_like(count[0], 255)
    for k in range(len(count) - 1, -1, -1):
        if radius >> k & 1:
            equal = equal & count[k]
        else:
            more |= equal & count[k]
            equal = equal & ~count[k]
    return more


def block_links(bucket: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (i, j) of lanes in one bucket within the radius. ``bucket`` is sorted; equal numbers stand together.

    ``fp`` holds a 64-bit word per lane, or a row of several words.
    """
    n, left, right = len(fp), [], []
    if n < 2:
        return np.empty(0, int), np.empty(0, int)
    bits = unpacked(fp)
    _, sizes = np.unique(bucket, return_counts=True)
    for lo in range(0, n - 1, LANES):
        hi = min(lo + LANES, n)
        own = _planes(bits[lo:hi])
        shift = 1
        while True:
            end = min(hi, n - shift)
            if end <= lo:
                break
            alive = bucket[lo:end] == bucket[lo + shift : end + shift]
            if not alive.any():
                break
            m = end - lo
            dead = ~np.packbits(alive, bitorder="little")
            over = exceeding(own[:, : len(dead)], _planes(bits[lo + shift : end + shift]), dead, radius)
            near = np.flatnonzero(np.unpackbits(~over, count=m, bitorder="little"))
            left.append(near + lo)
            right.append(near + lo + shift)
            shift += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, int), np.empty(0, int))


def _forest(i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """(root, member) of what the links join; the root is the smallest index."""
    up: dict[int, int] = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [(r, x) for x in up if (r := find(x)) != x]


def _bands(of: int, parts: int = RADIUS + 1) -> list[int]:
    """The set bits of ``of``, split into masks of nearly equal width."""
    bits = [b for b in range(64) if of >> b & 1]
    cut = [round(len(bits) * k / parts) for k in range(parts + 1)]
    return [sum(1 << b for b in bits[x:y]) for x, y in zip(cut, cut[1:], strict=False)]


_ALL = (1 << 64) - 1
_signed = lambda x: x - (1 << 64) if x >> 63 else x


def _buckets(nodes: DataFrame) -> DataFrame:
    """(mask, value, fp, node) rows of buckets with two nodes or more; hot buckets refined, for LEVELS levels at most."""
    level = {0: _bands(_ALL)}
    rows = nodes.select("fp", "node", F.explode(F.array(*[F.lit(_signed(m)) for m in level[0]])).alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
    masks, done = level[0], None
    for depth in range(LEVELS):
        counts = rows.groupBy("mask", "value").agg(F.count("*").alias("n")).where("n > 1")
        marked = rows.join(counts, ["mask", "value"])
        if depth == LEVELS - 1:
            part = marked
        else:
            marked = settle(marked)
            part = marked.where(F.col("n") <= HOT)
        part = part.select("mask", "value", "fp", "node")
        done = part if done is None else done.unionByName(part)
        if depth == LEVELS - 1:
            break
        hot = marked.where(F.col("n") > HOT)
        if hot.isEmpty():
            break
        finer = {m: [m | b for b in _bands(_ALL & ~m)] for m in masks}
        masks = sorted({x for xs in finer.values() for x in xs})
        choice = F.create_map(*[x for m, xs in finer.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(y)) for y in xs]))])
        rows = hot.select("fp", "node", F.explode(F.element_at(choice, F.col("mask"))).alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
    return done


def links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b), a < b, that join nodes (fp, node) within the radius: a forest of each bucket."""
    bounded_batches(nodes.sparkSession)

    def run(batches):
        held: list[np.ndarray] = []

        def solve(x: np.ndarray):
            order = np.lexsort((x[:, 3], x[:, 1], x[:, 0]))
            x = x[order]
            new = np.append(True, (x[1:, :2] != x[:-1, :2]).any(axis=1))
            pairs = _forest(*block_links(np.cumsum(new), x[:, 2].view(np.uint64)))
            a, b = (x[[p[k] for p in pairs], 3] if pairs else np.empty(0, np.int64) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            x = np.concatenate([*held, x]) if held else x
            last = (x[:, :2] == x[-1, :2]).all(axis=1)
            start = len(x) - int(np.argmin(last[::-1])) if not last.all() else 0
            held = [x[start:]]
            if start:
                yield solve(x[:start])
        if held:
            yield solve(np.concatenate(held))

    rows = _buckets(nodes).repartition("mask", "value").sortWithinPartitions("mask", "value")
    return rows.mapInArrow(run, "a bigint, b bigint").where("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node with an edge: label is the smallest node reachable.

    A round points each node to the smallest of itself and its neighbours, doubles these pointers until all
    reach a root, and contracts the edges to the roots. Every node but a local minimum is contracted.
    """
    edges = settle(edges)
    labels = settle(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up, moving = settle(both.groupBy("a").agg(F.least("a", F.min("b")).alias("q"))), True
        while moving:
            next_ = up.select(F.col("a").alias("q"), F.col("q").alias("root"))
            doubled = settle(up.join(next_, "q").select("a", F.col("root").alias("q"), (F.col("root") < F.col("q")).alias("moved")))
            moving = not doubled.where("moved").isEmpty()
            discard(up)
            up = doubled
        up = up.select("a", "q")
        first = edges.join(up, "a").select(F.col("q").alias("x"), "b")
        moved = first.join(up.withColumnRenamed("a", "b"), "b").select(F.least("x", "q").alias("a"), F.greatest("x", "q").alias("b"))
        old, labels = labels, settle(labels.join(up.withColumnRenamed("a", "label"), "label", "left").select("node", F.coalesce("q", "label").alias("label")))
        rest = settle(moved.where("a < b").distinct())
        discard(old, edges, doubled)
        edges = rest
    discard(edges)
    return labels


def classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fp and component_id, the smallest doc_id reachable over links."""
    fps = settle(fingerprints(docs))
    nodes = settle(fps.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node")))
    labels = components(links(nodes))
    named = nodes.join(labels, "node", "left").select("fp", F.coalesce("label", "node").alias("component_id"))
    return fps.join(named, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_first(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The documents that are the first of their class, and those without a doc_id, with the columns they came with.

    ``found``: doc_id and component_id of another operator; else those of classes().
    """
    found = settle(classes(docs) if found is None else found)
    first = found.where("doc_id = component_id")
    repeated = settle(first.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    # Joined by sorting at any size, so that small runs show what large ones shuffle.
    kept = docs.join(first.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi").select(*docs.columns)
    if not repeated.isEmpty():
        several = kept.join(repeated, "doc_id", "left_semi")
        order = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_first(), F.xxhash64(*docs.columns))
        one = several.select(F.struct(*docs.columns).alias("_row"), F.row_number().over(order).alias("_place")).where("_place = 1").select("_row.*")
        kept = kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(one)
    return kept.unionByName(docs.where("doc_id IS NULL"))
