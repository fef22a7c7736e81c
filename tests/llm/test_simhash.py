import random

import numpy as np
import pytest

from docloom.llm import simhash

DOC = "doc_id bigint, text string, lang string, fp string"


def brute(rows):
    """component ids by comparing every two fingerprints."""
    fps = [simhash.fingerprint(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2 or rows[i][0] == rows[j][0]:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return [least[find(i)] for i in range(len(rows))]


def variants(n, seed=1):
    r, words, out = random.Random(seed), [f"w{i}" for i in range(400)], []
    bases = [[r.choice(words) for _ in range(150)] for _ in range(12)]
    for i in range(n):
        w = list(r.choice(bases))
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(words)
        out.append((i, " ".join(w)))
    return out


def test_spark_hash_is_the_same(spark):
    import xxhash

    got = spark.sql("select xxhash64('a bc déf')").first()[0]
    assert got % 2**64 == xxhash.xxh64_intdigest("a bc déf", 42)


def test_classes_match_brute_force(spark):
    rows = [*variants(300), (300, None), (301, ""), (302, "one"), (303, "One"), (304, "two words"), (305, " \n\t ")]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame([(i, t, "en", "clash") for i, t in rows], DOC).repartition(5)
    got = {r.doc_id: r.component_id for r in simhash.classes(df).collect()}
    assert got == dict(zip([i for i, _ in rows], brute(rows), strict=True))
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c in got.values()})


def test_hot_buckets_are_refined_without_loss(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 4)
    rows = variants(250, seed=9)
    df = spark.createDataFrame([(i, t, "en", "") for i, t in rows], DOC)
    got = {r.doc_id: r.component_id for r in simhash.classes(df).collect()}
    assert got == dict(zip([i for i, _ in rows], brute(rows), strict=True))


@pytest.mark.parametrize("lanes", [8, 64, 4096])
def test_block_links_match_popcounts(monkeypatch, lanes):
    monkeypatch.setattr(simhash, "LANES", lanes)
    r = np.random.default_rng(5)
    base = r.integers(0, 2**63, 6, dtype=np.uint64)
    fp = r.choice(base, 90)
    for _ in range(2):
        fp ^= np.uint64(1) << r.integers(0, 64, 90, dtype=np.uint64)
    bucket = np.sort(r.integers(0, 9, 90))
    i, j = simhash.block_links(bucket, fp)
    want = {(a, b) for a in range(90) for b in range(a + 1, 90) if bucket[a] == bucket[b] and bin(int(fp[a]) ^ int(fp[b])).count("1") <= 2}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_chain_of_links(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 200), (100, 300)], "a bigint, b bigint")
    got = {r.node: r.label for r in simhash.components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 200: 100, 300: 100}


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, None)]
    df = spark.createDataFrame([(i, t, None, None) for i, t in rows], DOC)
    got = sorted((str(r.doc_id), r.component_id) for r in simhash.classes(df).collect())
    assert got == [("1", 1), ("1", 1), ("2", 1), ("None", None), ("None", None)]
    assert sorted(str(r.doc_id) for r in simhash.keep_first(df).collect()) == ["1", "None", "None"]
    assert simhash.classes(df.limit(0)).count() == 0
    assert simhash.keep_first(df.limit(0)).count() == 0
