"""Near copies by shingles: classes of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash as in op3's operator, with buckets and a radius for a similarity of 0.8:

1. Texts with equal sets are one node, so exact copies cost one row. Each has a
   fingerprint of 128 bits: the majorities of the bits of its shingles' hashes.
2. Candidates: nodes meet in buckets, and within a bucket their fingerprints are
   compared bit-sliced (simhash.block_links); those within RADIUS bits link, and
   links join into a group. Buckets are BANDS hashes of ROWS minima each, as bands
   of a fingerprint's bits cannot hold such pairs together: two texts at 0.8 differ
   in 15 % of the bits. A pair at 0.8 shares no bucket with a chance of
   (1 - 0.8**ROWS)**BANDS, about 5e-9; its fingerprints differ in more than RADIUS
   bits with a chance of 8e-13 (3e-9 for sets of four and five shingles, the
   worst); a more similar pair with less. Unrelated texts differ in 64 bits or so:
   98 of 100 that share a bucket are told apart. In a bucket over CROWD nodes, one
   node is compared with all, and so is each that lies apart from it; where over
   CROWD lie apart, the bucket is one group, so its work stays in proportion and
   nothing is lost.
3. Exact check: the shingle sets of a group are compared; only pairs of 0.8 or
   more link. Each found class is left out of further comparisons, so a large
   group of near copies costs about one pass. A group of up to LIMIT shingles is
   compared within one task.
4. A larger group is dealt into chunks of about LIMIT shingles, each compared by
   itself. Then the first chunk's classes, one text of each, are compared with
   every other chunk, which joins what is near to them. What is still outside the
   group's largest class is at last compared, in blocks of about LIMIT shingles,
   with all chunks: two texts of different classes are never both in the largest,
   so no link is missed. A task holds a chunk and a block, whatever a group holds.

Words, nulls, repeats and rows without a doc_id are as in simhash: words are cut
at white space and lower-cased (ASCII); a text of fewer words than a shingle is
one shingle; texts without words are copies of each other; rows without a doc_id
have a null class; rows that share a doc_id are one document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import simhash
from docloom.llm.common import bounded_batches, settle, with_columns

WIDTH, BANDS, ROWS, LIMIT = 5, 48, 5, 1 << 20
#: Bits that fingerprints of 128 may differ in; nodes of a bucket that are all compared with each other; rows compared at once.
RADIUS, CROWD, GATHERED = 52, 32, 1 << 14
_RANDOM = np.random.default_rng(5)
_TIMES = _RANDOM.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted 64-bit hashes of the different shingles of a text."""
    import xxhash

    words = simhash._WORD.findall((text or "").translate(simhash._LOWER))
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    made = map(" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [" ".join(words)]
    return np.unique(np.fromiter((digest(s, simhash.SEED) for s in made), np.uint64))


def bands(found: np.ndarray) -> np.ndarray:
    """The band hashes of a set of shingles as signed longs; none of an empty set."""
    import xxhash

    if not len(found):
        return np.empty(0, np.int64)
    h, least = (found >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, (1 << 32) - 1, np.uint32)
    for at in range(0, len(h), 512):
        np.minimum(least, (h[at : at + 512, None] * _TIMES + _PLUS).min(axis=0), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(rows[k].tobytes(), k) for k in range(BANDS)], np.uint64).view(np.int64)


def fingerprint(found: np.ndarray) -> np.ndarray:
    """Two words of 64 bits: a bit is 1 where over half the hashes have it, in the second word after a mix of theirs; 0 of an empty set."""
    with np.errstate(over="ignore"):
        mixed = (found ^ (found >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        mixed = (mixed ^ (mixed >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    words, counts = np.column_stack([found, mixed ^ (mixed >> np.uint64(33))]), np.zeros(128, np.int64)
    for at in range(0, len(words), 8192):
        counts += simhash.unpacked(words[at : at + 8192]).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(words), bitorder="little").view("<i8")


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, a digest of the set of shingles, its size, its fingerprint and its band hashes."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        import xxhash

        for b in batches:
            sets = [shingles(t) for t in b.column(1).to_pylist()]
            digests = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            fps = np.array([fingerprint(s) for s in sets], np.int64).reshape(-1, 2)
            columns = [b.column(0), digests, pa.array([len(s) for s in sets], pa.int64()), pa.array(fps[:, 0]), pa.array(fps[:, 1]), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "n", "fp", "fp2", "bands"])

    return with_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, digest binary, n bigint, fp bigint, fp2 bigint, bands array<bigint>")


def _crowd(fp: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that join the nodes of one bucket within RADIUS: each node that lies apart from the first is compared with all."""
    bits = simhash.unpacked(fp)
    planes, n = simhash._planes(bits), len(fp)
    none = np.zeros(planes.shape[1], np.uint8)

    def within(i: int) -> np.ndarray:
        over = simhash.exceeding((bits[i] * np.uint8(255))[:, None], planes, none, RADIUS)
        return np.unpackbits(~over, count=n, bitorder="little").astype(bool)

    near = within(0)
    apart = np.flatnonzero(~near)
    if len(apart) > CROWD:
        return np.full(n, nodes[0]), nodes
    left, right = [np.full(int(near.sum()), nodes[0])], [nodes[near]]
    for i in apart.tolist():
        close = within(i)
        to = apart[close[apart]].tolist() + [0] * bool((close & near).any())
        left.append(np.full(len(to), nodes[i]))
        right.append(nodes[to])
    return np.concatenate(left), np.concatenate(right)


def _bucket_links(x: np.ndarray) -> pa.RecordBatch:
    """Edges (a, b) of rows (band, node, fp, fp2) of whole buckets, sorted by band."""
    ends = np.append(np.flatnonzero(x[1:, 0] != x[:-1, 0]) + 1, len(x))
    starts = np.append(0, ends[:-1])
    size, fp = np.repeat(ends - starts, ends - starts), np.ascontiguousarray(x[:, 2:]).view(np.uint64)
    few = np.flatnonzero((size > 1) & (size <= CROWD))
    pairs = np.array(simhash._forest(*simhash.block_links(x[few, 0], fp[few], RADIUS)), np.int64).reshape(-1, 2)
    links = [(x[few[pairs[:, 0]], 1], x[few[pairs[:, 1]], 1])]
    links += [_crowd(fp[s:e], x[s:e, 1]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True) if e - s > CROWD]
    a, b = (np.concatenate([link[k] for link in links]) for k in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def candidates(nodes: DataFrame) -> DataFrame:
    """Edges (a, b), a < b, that join the nodes (node, fp, fp2, bands) of each bucket whose fingerprints lie within RADIUS."""
    bounded_batches(nodes.sparkSession)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.column_stack([c.to_numpy() for c in batch.columns]))
            size += batch.num_rows
            if size < GATHERED or held[0][0, 0] == held[-1][-1, 0]:
                continue
            x = np.concatenate(held)
            start = int(np.searchsorted(x[:, 0], x[-1, 0]))
            yield _bucket_links(x[:start])
            held, size = [x[start:]], len(x) - start
        if held:
            yield _bucket_links(np.concatenate(held))

    rows = nodes.select(F.explode("bands").alias("band"), "node", "fp", "fp2").repartition("band").sortWithinPartitions("band", "node")
    return rows.mapInArrow(run, "a bigint, b bigint").where("a < b").distinct()


def similar(sets: list[np.ndarray]) -> np.ndarray:
    """For each set, the place of the first set that it reaches over links of a Jaccard similarity of 0.8 or more."""
    sizes = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    parts = np.split(flat, np.cumsum(sizes)[:-1])
    label, mark = np.arange(len(sets)), np.zeros(int(flat.max(initial=-1)) + 1, bool)
    held = np.argsort(sizes, kind="stable")
    flat = np.concatenate([parts[i] for i in held])
    ends = np.append(0, np.cumsum(sizes[held]))
    open_ = np.ones(len(held), bool)  # of held: not yet in a class
    while open_.any():
        first = int(np.argmax(open_))
        open_[first] = False
        queue, members = [int(held[first])], []
        while queue:
            u = queue.pop()
            members.append(u)
            if 2 * (n := int(open_.sum())) < len(held):
                held = held[open_]
                flat = np.concatenate([parts[i] for i in held]) if n else flat[:0]
                ends, open_ = np.append(0, np.cumsum(sizes[held])), np.ones(n, bool)
            if not n:
                continue
            # Sizes ascend: only sets of 4/5 to 5/4 of this one's size can link.
            lo, hi = np.searchsorted(5 * sizes[held], 4 * sizes[u]), np.searchsorted(4 * sizes[held], 5 * sizes[u], side="right")
            if lo == hi:
                continue
            mark[parts[u]] = True
            shared = np.add.reduceat(mark[flat[ends[lo] : ends[hi]]], ends[lo:hi] - ends[lo], dtype=np.int64)
            mark[parts[u]] = False
            near = lo + np.flatnonzero(open_[lo:hi] & (9 * shared >= 4 * (sizes[u] + sizes[held[lo:hi]])))
            open_[near] = False
            queue += held[near].tolist()
        label[members] = min(members)
    return label


def _near(parts: list[np.ndarray], others: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all parts[i] and others[j] that link."""
    size, held = np.array([len(x) for x in others]), np.argsort([len(x) for x in others], kind="stable")
    _, flat = np.unique(np.concatenate([*parts, *(others[i] for i in held)]), return_inverse=True)
    mark, at = np.zeros(int(flat.max(initial=-1)) + 1, bool), np.append(0, np.cumsum([len(x) for x in parts]))
    flat, own, size = flat[at[-1] :], flat[: at[-1]], size[held]
    ends, left, right = np.append(0, np.cumsum(size)), [], []
    for i, n in enumerate(np.diff(at).tolist()):
        lo, hi = np.searchsorted(5 * size, 4 * n), np.searchsorted(4 * size, 5 * n, side="right")
        if lo < hi:
            mark[own[at[i] : at[i + 1]]] = True
            shared = np.add.reduceat(mark[flat[ends[lo] : ends[hi]]], ends[lo:hi] - ends[lo], dtype=np.int64)
            mark[own[at[i] : at[i + 1]]] = False
            found = held[lo + np.flatnonzero(9 * shared >= 4 * (n + size[lo:hi]))]
            left.append(np.full(len(found), i))
            right.append(found)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, int), np.empty(0, int))


def _by_key(batches, keys: int):
    """Lists of rows, without their key columns, of each key; rows of a key stand together."""
    key, rows = None, []
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if r[:keys] != key and rows:
                yield rows
                rows = []
            key = r[:keys]
            rows.append(r[keys:])
    if rows:
        yield rows


def _within(dealt: DataFrame, keys: list[str]) -> DataFrame:
    """(node, label) of (node, found) compared per key: label is the smallest node of the class."""

    def run(batches):
        for rows in _by_key(batches, len(keys)):
            nodes, least = [n for n, _ in rows], {}
            first = similar([np.frombuffer(s, np.uint64) for _, s in rows]).tolist()
            for k, n in zip(first, nodes, strict=True):
                least[k] = min(n, least.get(k, n))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([least[k] for k in first], pa.int64())], names=["node", "label"])

    return dealt.select(*keys, "node", "found").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "node bigint, label bigint")


def _between(probes: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """Edges (a, b), a < b: a forest of the links between the probes and the members of each key, both (keys, node, found)."""

    def run(batches):
        for rows in _by_key(batches, len(keys)):
            of = [[(n, np.frombuffer(s, np.uint64)) for kind, n, s in rows if kind == k] for k in (0, 1)]
            if of[0] and of[1]:
                i, j = _near([s for _, s in of[0]], [s for _, s in of[1]])
                nodes = np.array([n for n, _ in of[0]] + [n for n, _ in of[1]], np.int64)
                pairs = np.array(simhash._forest(i, j + len(of[0])), np.int64).reshape(-1, 2)
                a, b = nodes[pairs[:, 0]], nodes[pairs[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    side = lambda df, kind: df.select(*keys, F.lit(kind).alias("kind"), "node", "found")
    dealt = side(probes, 0).unionByName(side(members, 1)).repartition(*keys).sortWithinPartitions(*keys, "kind")
    return dealt.mapInArrow(run, "a bigint, b bigint").where("a < b")


def _edges(labels: DataFrame) -> DataFrame:
    return labels.where("label <> node").select(F.col("label").alias("a"), F.col("node").alias("b"))


def _large(sets: DataFrame, limit: int) -> DataFrame:
    """(node, label) of the groups over ``limit`` shingles; sets: (label, chunks, n, node, found)."""
    dealt = settle(sets.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks"))))
    own = settle(_within(dealt, ["label", "chunk"]))
    one = own.where("label = node").select("node")
    hubs = dealt.where("chunk = 0").join(one, "node").withColumn("chunk", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("chunks") - 1)))
    edges = settle(_edges(own).unionByName(_between(hubs, dealt.where("chunk > 0"), ["label", "chunk"])).distinct())
    found = simhash.components(edges).withColumnRenamed("label", "class")
    named = settle(dealt.drop("found").join(found, "node", "left").withColumn("class", F.coalesce("class", "node")))
    sizes = named.groupBy("label", "class").agg(F.count("*").alias("k"))
    largest = sizes.groupBy("label").agg(F.max(F.struct("k", "class")).alias("top")).select("label", F.col("top.class").alias("class"))
    outside = named.join(largest, ["label", "class"], "left_anti")
    blocks = outside.groupBy("label").agg(F.ceil(F.sum("n") / limit).cast("bigint").alias("blocks"))
    outside = settle(outside.join(blocks, "label").select("label", "node", "chunks", "blocks", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).alias("block")))
    if not outside.isEmpty():
        probes = dealt.select("node", "found").join(outside, "node").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
        members = dealt.join(blocks, "label").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        edges = edges.unionByName(_between(probes, members, ["label", "chunk", "block"])).distinct()
        found = simhash.components(edges).withColumnRenamed("label", "class")
    return dealt.select("node").join(found, "node", "left").select("node", F.coalesce("class", "node").alias("label"))


def checked(members: DataFrame, limit: int | None = None) -> DataFrame:
    """(node, label) of (label, total, n, node, text), whose labels are groups of candidates: label is the smallest node of the class.

    ``n`` is a text's number of shingles and ``total`` that of its group.
    """
    bounded_batches(members.sparkSession)
    limit = limit or LIMIT

    def sets(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([shingles(t).tobytes() for t in b.column(4).to_pylist()], pa.binary())], names=["label", "total", "n", "node", "found"])

    schema = "label bigint, total bigint, n bigint, node bigint, found binary"
    made = lambda rows: rows.select("label", "total", "n", "node", "text").mapInArrow(sets, schema).where(F.length("found") > 0)
    small = _within(made(members.where(F.col("total") <= limit)), ["label"])
    large = members.where(F.col("total") > limit)
    if large.select("label").isEmpty():
        return small
    return small.unionByName(_large(made(large).withColumn("chunks", F.ceil(F.col("total") / limit).cast("bigint")).drop("total"), limit))


def classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and component_id, the smallest doc_id reachable over links."""
    made = settle(sketches(docs))
    nodes = settle(made.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("node"), *[F.first(c).alias(c) for c in ("n", "fp", "fp2", "bands")]))
    named = settle(made.select("doc_id", "digest").join(nodes.select("digest", "node"), "digest", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")))
    groups = simhash.components(candidates(nodes)).join(nodes.select("node", "n"), "node")
    # A doc_id with several texts is a node of each; their sizes count together.
    groups = groups.groupBy("node", "label").agg(F.sum("n").alias("n"))
    groups = settle(groups.join(groups.groupBy("label").agg(F.sum("n").alias("total")), "label"))
    texts = with_columns(docs, "doc_id", "text").withColumnRenamed("doc_id", "node")
    # Joined by sorting at any size, so that small runs show what large ones shuffle.
    labels = settle(checked(texts.join(groups.hint("merge"), "node")))
    # A doc_id with several texts joins their classes.
    several = named.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z")
    links = named.join(several, "doc_id").select("a", F.col("node").alias("b"))
    repeated = settle(labels.groupBy("node").agg(F.min("label").alias("a"), F.max("label").alias("z")).where("a < z"))
    links = settle(links.unionByName(labels.join(repeated.select("node"), "node").select(F.col("label").alias("a"), F.col("node").alias("b"))).where("a <> b").distinct())
    if not links.isEmpty():
        all_ = links.unionByName(labels.select(F.col("label").alias("a"), F.col("node").alias("b")).where("a <> b"))
        labels = simhash.components(all_.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return named.join(labels.distinct(), "node", "left").select("doc_id", F.coalesce("label", "node").alias("component_id"))
