"""The stage's candidates come from SimHash fingerprints that are compared bit-sliced within buckets."""

import random

import numpy as np
import pytest

from docloom.llm import near

NODES = "node bigint, n bigint, fp bigint, fp2 bigint, bands array<bigint>"


def joined(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up if any(find(y) == find(x) for y in up if y != x)}


def flipped(r, word, k):
    for b in r.sample(range(128), k):
        word ^= 1 << b
    return word


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def buckets(r, sizes):
    """(node, fingerprint, band): copies of a base with some bits flipped, a few of them unrelated."""
    rows = []
    for k in range(12):
        base = r.getrandbits(128)
        for _ in range(r.choice(sizes)):
            rows.append((len(rows), flipped(r, base, r.choice((0, 20, near.RADIUS, near.RADIUS + 1))) if r.random() < 0.9 else r.getrandbits(128), k))
    return rows


def within(rows):
    return [(i, j) for i, f, b in rows for j, g, c in rows if i < j and b == c and (f ^ g).bit_count() <= near.RADIUS]


def test_candidates_lie_within_the_radius(spark):
    """Nodes that share a bucket only do not link."""
    rows = buckets(random.Random(3), (1, 2, 5, 30))
    frame = spark.createDataFrame([(i, 1, signed(f & (1 << 64) - 1), signed(f >> 64), [k]) for i, f, k in rows], NODES)
    got = joined((x.a, x.b) for x in near.candidates(frame.repartition(3)).collect())
    assert got == joined(within(rows)) and got != joined((i, j) for i, _, b in rows for j, _, c in rows if i < j and b == c)


@pytest.mark.parametrize("crowd", [64, 10, 1])
def test_no_link_of_a_crowd_is_lost(monkeypatch, crowd):
    """Where too many nodes of a bucket lie apart, it is one group; else its links are exact."""
    monkeypatch.setattr(near, "CROWD", crowd)
    rows = buckets(random.Random(4), (1, 2, 5, 40))
    x = np.array([(k, i, signed(f & (1 << 64) - 1), signed(f >> 64)) for i, f, k in rows], np.int64)
    made = near._bucket_links(x)
    got, want = list(zip(made.column(0).to_pylist(), made.column(1).to_pylist(), strict=True)), within(rows)
    assert all(rows[a][2] == rows[b][2] for a, b in got) and joined([*got, *want]) == joined(got)
    assert crowd < 64 or joined(got) == joined(want)


def test_a_crowd_with_few_apart():
    r, base = random.Random(5), 0x0123456789ABCDEF_FEDCBA9876543210
    words = [flipped(r, base, 20) for _ in range(200)] + [r.getrandbits(128) for _ in range(8)]
    words += [flipped(r, words[201], 30), flipped(r, words[0], 50), flipped(r, words[205], 10)]
    r.shuffle(words)
    fp = np.array([[w & (1 << 64) - 1, w >> 64] for w in words], np.uint64)
    want = [(i, j) for i, f in enumerate(words) for j, g in enumerate(words) if i < j and (f ^ g).bit_count() <= near.RADIUS]
    a, b = near._crowd(fp, np.arange(len(words)))
    assert joined(zip(a.tolist(), b.tolist(), strict=True)) == joined(want) and len(a) < 2 * len(words)


def test_similar_sets_have_near_fingerprints():
    """Pairs at a similarity of 0.8 differ in 15 % of the bits, unrelated ones in half."""
    r = np.random.default_rng(2)
    distance = lambda a, b: sum((int(x) ^ int(y)).bit_count() for x, y in zip(near.fingerprint(a).view(np.uint64), near.fingerprint(b).view(np.uint64), strict=True))
    near_by, others = [], []
    for n in (4, 40, 400, 20_000):
        for _ in range(100 if n < 1000 else 3):
            shared, own = r.integers(0, 1 << 64, n, np.uint64), r.integers(0, 1 << 64, n // 4, np.uint64)
            near_by.append(distance(shared, np.concatenate([shared, own])))
            others.append(distance(shared, r.integers(0, 1 << 64, n, np.uint64)))
    assert max(near_by) <= near.RADIUS and np.mean(near_by) < 26 and np.mean(np.array(others) > near.RADIUS) > 0.9
    assert not near.fingerprint(np.empty(0, np.uint64)).any()
