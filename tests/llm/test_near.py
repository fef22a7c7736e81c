import os
import random

import numpy as np
import pytest

import corpus_pipeline
from docloom.llm import near, simhash
from docloom.llm.common import table

SF = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def rows_of(texts):
    return [(i, t, "en", "x", len(t or "")) for i, t in texts]


def edited(words, places):
    """Copies differ at single words that stand apart, so each edit changes five shingles."""
    return " ".join(f"edit{k}" if k in places else w for k, w in enumerate(words))


def brute(texts):
    sets = [set(near.shingles(t).tolist()) for _, t in texts]
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or texts[i][0] == texts[j][0] or (a | b and len(a & b) / len(a | b) >= 0.8):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(texts):
        least[find(i)] = min(d, least.get(find(i), d))
    return [least[find(i)] for i in range(len(texts))]


def test_stage_links_copies_with_edited_words(spark):
    words = [f"w{random.Random(4).randrange(9)}{k}" for k in range(400)]
    # 6 edits: 366 / 426 shingles shared (0.86); 10 edits: 346 / 446 (0.78).
    texts = [(0, " ".join(words)), (1, edited(words, range(20, 320, 50))), (2, edited(words, range(20, 380, 36)))]
    assert bin(simhash.fingerprint(texts[0][1]) ^ simhash.fingerprint(texts[1][1])).count("1") > 2
    docs = spark.createDataFrame(rows_of(texts), DOC)
    kept = corpus_pipeline.one_of_each(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2]


def test_classes_match_brute_force(spark):
    r, vocabulary = random.Random(7), [f"v{i}" for i in range(500)]
    bases = [[r.choice(vocabulary) for _ in range(r.choice((12, 60, 250)))] for _ in range(15)]
    texts = []
    for i in range(250):
        w = list(r.choice(bases))
        for _ in range(r.randint(0, max(1, len(w) // 30))):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        texts.append((i, " ".join(w)))
    texts += [(250, "one two"), (251, "One  two"), (252, ""), (253, None), (254, " \n"), (255, "one")]
    # Two texts under one doc_id join their classes.
    texts += [(256, texts[3][1]), (256, "a text of its own with some ten words in it"), (257, "a text of its own with some ten words in it")]
    got = {x.doc_id: x.component_id for x in near.classes(spark.createDataFrame(rows_of(texts), DOC).repartition(5)).collect()}
    assert got == dict(zip([i for i, _ in texts], brute(texts), strict=True))


def test_nulls_repeats_and_empty_tables(spark):
    df = spark.createDataFrame(rows_of([(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, None)]), DOC)
    assert sorted((str(x.doc_id), x.component_id) for x in near.classes(df).collect()) == [("1", 1), ("1", 1), ("2", 1), ("None", None), ("None", None)]
    assert sorted(str(x.doc_id) for x in simhash.keep_first(df, near.classes(df)).collect()) == ["1", "None", "None"]
    assert near.classes(df.limit(0)).count() == 0


@pytest.mark.parametrize("shared, linked", [(800, True), (799, False)])
def test_similarity_is_exact_at_its_bound(shared, linked):
    """shared of 1,000 different shingles: 0.8 links, a shingle less does not."""
    a, b = np.arange(900, dtype=np.uint64), np.arange(900 - shared, 1000, dtype=np.uint64)
    assert len(np.intersect1d(a, b)) == shared
    assert (near.similar([a, b])[1] == 0) == (9 * shared >= 4 * (len(a) + len(b))) == linked


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_classes_of_whole_documents(spark):
    docs = table(spark, SF, "documents")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r.component_id for r in near.classes(docs).collect()}
    assert got == dict(zip([i for i, _ in texts], brute(texts), strict=True))
    assert (got[177], got[145]) == (got[1], got[6])  # 3 bits apart or more
