import random

import numpy as np
import pytest

from docloom.llm import near, simhash
from docloom.llm.common import settle
from tests.llm.test_near import DOC, brute, rows_of


def drifting(n, seed=5):
    """Texts of one base in which each step replaces some words, so that the ends of the chain do not link; and strays."""
    r, vocabulary = random.Random(seed), [f"v{i}" for i in range(900)]
    base, out = [r.choice(vocabulary) for _ in range(160)], []
    for i in range(n):
        w = list(base)
        for _ in range(r.choice((0, 1, 2, 4, 8))):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        out.append((i, " ".join(w)))
        if i % 6 == 5:
            base[r.randrange(len(base))] = r.choice(vocabulary)
    return out


@pytest.mark.parametrize("limit", [400, 3000])
def test_large_groups_equal_brute_force(spark, monkeypatch, limit):
    calls, large = [], near._large
    monkeypatch.setattr(near, "LIMIT", limit)
    monkeypatch.setattr(near, "_large", lambda sets, n: calls.append(n) or large(sets, n))
    texts = drifting(150)
    random.Random(2).shuffle(texts)
    got = {x.doc_id: x.component_id for x in near.classes(spark.createDataFrame(rows_of(texts), DOC).repartition(4)).collect()}
    assert got == dict(zip([i for i, _ in texts], brute(texts), strict=True)) and calls
    assert 1 < len(set(got.values())) < len(texts)


def test_no_task_holds_more_than_a_chunk_and_a_block(spark, monkeypatch):
    """Texts that are all candidates of each other and mostly do not link."""
    r = random.Random(3)
    shared = [f"s{i}" for i in range(60)]
    texts = [(i, " ".join(shared + [f"w{r.randrange(10**6)}" for _ in range(25)])) for i in range(120)]
    sets = [(1, near.shingles(t).size, i, near.shingles(t).tobytes()) for i, t in texts]
    total = sum(n for _, n, *_ in sets)
    limit = total // 8
    df = settle(spark.createDataFrame([(g, -(-total // limit), n, i, bytearray(s)) for g, n, i, s in sets], "label bigint, chunks bigint, n bigint, node bigint, found binary"))
    got = {x.node: x.label for x in near._large(df, limit).collect()}
    assert got == dict(zip([i for i, _ in texts], brute(texts), strict=True))


def test_links_between_lists_equal_a_plain_search():
    r = np.random.default_rng(6)
    base = r.integers(0, 2**63, (3, 50), dtype=np.uint64)
    some = lambda: np.unique(np.where(r.random(50) < 0.05, r.integers(0, 2**63, 50, dtype=np.uint64), base[r.integers(0, 3)])[: r.integers(30, 51)])
    parts, others = [some() for _ in range(20)], [some() for _ in range(30)]
    want = {(i, j) for i, a in enumerate(parts) for j, b in enumerate(others) if 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))}
    i, j = near._near(parts, others)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and want
    assert simhash._forest(i, j + 20)
