import math
from fractions import Fraction

import numpy as np

from docloom.llm import quality_knn, toxicity
from tests.llm.test_text_operators import TEXTS, corpus

DOC = "doc_id bigint, text string, n_words string, source string"
LABELS = "doc_id bigint, quality int, toxic int"


def brute_quality(m, text):
    """The vote by Python's whole numbers and fractions, one labelled vector at a time."""
    row = quality_knn.Features().row(text)
    whole = [round(float(x) * float(i) * 2**13) if np.float32(x * i) == float(x) * float(i) else round(float(np.float32(x * i)) * 2**13) for x, i in zip(row, m.idf, strict=True)]
    latent = [sum(w * int(b) for w, b in zip(whole, m.basis[:, d], strict=True) if w) for d in range(m.basis.shape[1])]
    norm = math.sqrt(sum(Fraction(x) ** 2 for x in latent))
    unit = [round(x / norm * 2**20) for x in latent]
    near = sorted(((-sum(u * int(v) for u, v in zip(unit, vector, strict=True)), i) for i, vector in enumerate(m.vectors)))[: quality_knn.NEIGHBOURS]
    weights = [(max(-c / 2**40, 1e-3) ** quality_knn.POWER, m.labels[i]) for c, i in near]
    return sum(w * y for w, y in weights) / sum(w for w, _ in weights)


def fitted_quality(n=150):
    docs, labels = corpus(n)
    f = quality_knn.Features()
    return quality_knn.fit(np.stack([f.row(d[1]) for d in docs]), np.array([q for _, q, _ in labels]))


def test_quality_scores_equal_brute_force():
    m, f = fitted_quality(), quality_knn.Features()
    texts = [t for t in TEXTS if t] + [d[1] for d in corpus(20, seed=8)[0]]
    got = m.scores(np.stack([f.row(t) for t in texts]))
    assert np.allclose(got, [brute_quality(m, t) for t in texts], rtol=0, atol=1e-9)


def test_quality_scores_do_not_depend_on_the_block():
    m, f = fitted_quality(), quality_knn.Features()
    rows = np.stack([f.row(d[1]) for d in corpus(256, seed=9)[0]])
    whole = m.scores(rows)
    for size in (1, 7, 100):
        assert np.array_equal(whole, np.concatenate([m.scores(rows[a : a + size]) for a in range(0, len(rows), size)]))


def test_equal_neighbours_go_by_the_order_of_the_sample():
    f = quality_knn.Features()
    row = f.row("some words that are all the same here")
    n = 2 * quality_knn.NEIGHBOURS
    labels = np.array([1] * quality_knn.NEIGHBOURS + [0] * quality_knn.NEIGHBOURS)
    m = quality_knn.fit(np.stack([row] * n + [f.row("$$ ## %% else")]), np.append(labels, 0))
    assert m.scores(row[None])[0] == 1.0


def test_rows_travel_whole():
    row, out = quality_knn.Features().row("a b c " * 9 + "x" * 300), np.zeros(quality_knn.WIDTH, np.float32)
    quality_knn.unpack(quality_knn.packed(row), out)
    assert np.array_equal(row, out)


def test_repeated_labelled_ids_are_one_row_and_none_is_cut_off(spark):
    docs = [(i, f"text number {i} of some", "", "") for i in range(60)] + [(3, f"copy {k}", "", "") for k in range(300)]
    labels = [(i, i % 2, i % 2) for i in range(60)]
    d, lab = spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, LABELS)
    first = None
    for parts in (1, 5):
        q, t = quality_knn.training_rows(d.repartition(parts), lab, sample=60), toxicity.training_rows(d.repartition(parts), lab, sample=60)
        assert len(t[0]) == 60 and len(q[0]) == sum(not held for held in (__import__("zlib").crc32(str(i).encode()) % 3 == 1 for i in range(60)))
        now = (q[0].tobytes(), q[1].tobytes(), [x.tobytes() for x in t[0]], t[1].tobytes())
        assert first is None or now == first
        first = now


def test_bytes_of_the_toxicity_sample_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 4000)
    docs = [(i, " ".join(f"{chr(97 + i % 26)}{chr(97 + k % 26)}{chr(97 + i // 26)}" for k in range(12)), "", "") for i in range(200)]
    docs.append((200, " ".join(f"{a}{b}z" for a in "abcdefghij" for b in "abcdefghijklmnopq"), "", ""))
    d, lab = spark.createDataFrame(docs, DOC), spark.createDataFrame([(i, 0, i % 2) for i in range(201)], LABELS)
    rows, _ = toxicity.training_rows(d, lab)
    assert 0 < sum(r.nbytes for r in rows) < 6000


def brute_toxicity(m, text):
    low, active, run = (text or "").lower(), set(), ""
    for ch in low + " ":
        if ch.isalpha() or ch.isalnum() and not ch.isdecimal() and not ch.isdigit() and ch != "_" and toxicity._WORD.match(ch):
            run += ch
            if len(run) < 64:
                continue
        if run:
            active.update(toxicity.codes(run))
        run = ""
    total = sum(m.weights[c] for c in sorted(active) if c in m.weights)
    p = [1 / (1 + math.exp(-(total - t))) for t in m.thresholds]
    return sum(p), sum(x >= 0.5 for x in p), p[0] >= 0.5


def test_toxicity_scores_equal_brute_force(spark):
    docs, labels = corpus(300)
    texts = TEXTS + [d[1] for d in docs[:60]] + ["idiotic " * 5, "x" * 70 + "idiotic"]
    df = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], DOC).repartition(3)
    m = toxicity.train(spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, LABELS))
    assert m.weights and len(m.thresholds) == toxicity.GRADES
    for r in toxicity.score(df, m).collect():
        severity, grade, toxic = brute_toxicity(m, texts[r.doc_id])
        assert abs(r.severity - severity) < 1e-9 and (r.grade, r.toxic) == (grade, toxic)


def test_toxicity_weights_are_a_minimum_of_the_loss():
    """The mean log loss of all thresholds, written out anew, rises or stays whichever way a fitted number is moved."""
    docs, labels = corpus(300)
    rows = [np.unique(np.array([c for w in toxicity.words(d[1]) for c in toxicity.codes(w)], np.int32)) for d in docs]
    toxic = np.array([t for *_, t in labels])
    m = toxicity.fit(rows, toxic, steps=3000, rate=0.05, shrink=1e-2)
    kept = toxicity.distinct_rows(rows)
    rows, toxic = [rows[i] for i in kept], toxic[kept]
    hits = {c: [0, 0] for c in m.weights}
    for r, t in zip(rows, toxic, strict=True):
        for c in set(r.tolist()) & hits.keys():
            hits[c][0] += 1
            hits[c][1] += t
    rate, n = toxic.mean(), len(rows)
    marks = {c for c, (k, h) in hits.items() if h >= 0.9 * k and (h - k * rate) / math.sqrt(k * rate * (1 - rate) * (1 - k / (n + 1)) + 1e-9) > 5}
    grades = [(1 + (e >= 3) + (e >= 6) if t else 0) for r, t in zip(rows, toxic, strict=True) for e in [len(marks & set(r.tolist()))]]

    def loss(weights, cuts):
        total = 0.0
        for r, g in zip(rows, grades, strict=True):
            z = sum(weights[c] for c in r.tolist() if c in weights)
            for k, t in enumerate(cuts):
                s = z - t if g > k else t - z
                total += math.log1p(math.exp(-s)) if s > -30 else -s
        return total / n + 1e-2 / 2 * sum(w * w for w in weights.values())

    best = loss(m.weights, m.thresholds)
    for c in list(m.weights)[:12]:
        for step in (-0.2, 0.2):
            assert loss({**m.weights, c: m.weights[c] + step}, m.thresholds) > best - 1e-3
    for k in range(toxicity.GRADES):
        for step in (-0.2, 0.2):
            assert loss(m.weights, [t + step * (j == k) for j, t in enumerate(m.thresholds)]) > best - 1e-3
