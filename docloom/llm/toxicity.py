"""Toxicity: cumulative-link ordinal regression from sparse text features to expected severity.

P(grade > k) = sigmoid(w x - t_k): the weights w are shared by all grades, the
thresholds t_k are ordered. Features are the words of a text and their first four
and five letters, each present or not; a run of over 64 letters counts as
consecutive parts of 64. Grades come from the binary labels: 0 for
rows that are not toxic; a toxic row has grade 1, 2 or 3 by how many different
words it has that mark toxic rows in the sample (under 3, 3 to 5, 6 or more). The
expected severity is the sum of P(grade > k); a document is toxic where
P(grade > 0) is at least one half.

The model is fitted on a bounded sample of labelled rows (at most about ``SAMPLE``
rows and ``SAMPLE_BYTES`` bytes, chosen by a hash of the id; near copies among them
count once, see distinct_rows()); its weights are a few thousand numbers. Every
document is scored whole, and no text is shuffled.

Cases: null and empty texts have no features and the severity of an empty text,
never toxic; repeated rows get equal scores; a labelled doc_id with several texts
is one row of the sample, the least; without labels of both kinds nothing
is toxic; an empty table gives an empty table; extra columns are ignored by
score() and kept by keep().
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import bounded_batches, settle, with_columns

SAMPLE, SPACE, FEATURES, MIN_ROWS, GRADES = 8000, 1 << 24, 512, 4, 3
#: Feature codes of the sample, at most about this many bytes; a row with a sixteenth of them is not in the sample.
SAMPLE_BYTES = 64 << 20
CACHE = 400_000
_WORD = re.compile(r"[^\W\d_]{1,64}")


def codes(w: str) -> tuple[int, ...]:
    """Hashed features of a word in lower case."""
    made = ("w" + w, "4" + w[:4], "5" + w[:5]) if len(w) > 5 else ("w" + w, "4" + w[:4]) if len(w) > 4 else ("w" + w,)
    return tuple(zlib.crc32(x.encode()) % SPACE for x in made)


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


@dataclass(frozen=True)
class Model:
    """weights by feature code; thresholds ascending. No thresholds: nothing is toxic."""

    weights: dict[int, float]
    thresholds: np.ndarray

    def exceed(self, total: float) -> np.ndarray:
        """P(grade > k) for k = 0, 1, ..."""
        return 1 / (1 + np.exp(-np.clip(total - self.thresholds, -40, 40)))


class Scorer:
    def __init__(self, model: Model):
        self.model, self.cache = model, {}

    def total(self, text: str | None) -> float:
        """Sum of the weights of the features that a text has."""
        cache, weights, active = self.cache, self.model.weights, set()
        if len(cache) > CACHE:
            cache.clear()
        for w in words(text):
            found = cache.get(w)
            if found is None:
                found = cache[w] = tuple(c for c in codes(w) if c in weights)
            if found:
                active.update(found)
        return sum(weights[c] for c in sorted(active))

    def __call__(self, text: str | None) -> tuple[float, int, bool]:
        """Expected severity, likeliest grade and whether the text is toxic."""
        p = self.model.exceed(self.total(text))
        return float(p.sum()), int((p >= 0.5).sum()), bool(len(p) and p[0] >= 0.5)


def distinct_rows(rows: list[np.ndarray], band: int = 4, most: float = 0.2) -> list[int]:
    """Places of rows that are no near copy of an earlier one, so that a group of copies counts once.

    A row's signature is its twelve smallest codes among those in at most a fifth of the rows; rows that
    share a third of it in one place count as copies.
    """
    codes_, counts = np.unique(np.concatenate(rows), return_counts=True) if rows else (np.empty(0), np.empty(0))
    common, kept, known = codes_[counts > max(10, most * len(rows))], [], set()
    for i, r in enumerate(rows):
        least = np.setdiff1d(r, common, assume_unique=True)[: 3 * band]
        bands = {(k, least[k : k + band].tobytes()) for k in range(0, len(least) - band + 1, band)} or {(-1, r.tobytes())}
        if not bands & known:
            kept.append(i)
        known |= bands
    return kept


def fit(rows: list[np.ndarray], toxic: np.ndarray, features: int = FEATURES, steps: int = 250, rate: float = 0.1, shrink: float = 1e-4) -> Model:
    """rows: feature codes of each document."""
    if not len(rows) or toxic.min() == toxic.max():
        return Model({}, np.empty(0))
    places = distinct_rows(rows)
    if 0 < toxic[places].sum() < len(places):
        rows, toxic = [rows[i] for i in places], toxic[places]
    flat = np.concatenate(rows)
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    seen, count = np.unique(flat, return_counts=True)
    seen, count = seen[count >= MIN_ROWS], count[count >= MIN_ROWS]
    often = np.isin(flat, seen)
    flat, owner = flat[often], owner[often]
    code = np.searchsorted(seen, flat)
    hits = np.bincount(code, weights=toxic[owner], minlength=len(seen))
    # Signed root of the chi-square statistic picks the features that tell toxic rows from others.
    rate_all, n = toxic.mean(), len(rows)
    strength = (hits - count * rate_all) / np.sqrt(count * rate_all * (1 - rate_all) * (1 - count / (n + 1)) + 1e-9)
    chosen = np.argsort(-np.abs(strength), kind="stable")[:features]
    place = np.full(len(seen), -1)
    place[chosen] = np.arange(len(chosen))
    inside = place[code] >= 0
    x = np.zeros((n, len(chosen)), np.float32)
    x[owner[inside], place[code[inside]]] = 1
    marks = (hits[chosen] >= 0.9 * count[chosen]) & (strength[chosen] > 5)
    evidence = x[:, marks].sum(axis=1)
    grade = np.where(toxic > 0, 1 + (evidence >= 3) + (evidence >= 6), 0)
    above = (grade[:, None] > np.arange(GRADES)).astype(np.float32)
    # Adam on the mean log loss of all thresholds; ordered thresholds are a first one and positive gaps.
    theta = np.concatenate([np.zeros(len(chosen)), [1.0], np.zeros(GRADES - 1)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, gaps = theta[: len(chosen)], np.exp(theta[len(chosen) + 1 :])
        cut = theta[len(chosen)] + np.append(0, np.cumsum(gaps))
        z = (x @ w.astype(np.float32))[:, None] - cut
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - above) / n
        by_cut = -error.sum(axis=0)
        g_gaps = gaps * np.cumsum(by_cut[::-1])[::-1][1:]
        grad = np.concatenate([x.T @ error.sum(axis=1).astype(np.float32) + shrink * w, [by_cut.sum()], g_gaps])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    cut = theta[len(chosen)] + np.append(0, np.cumsum(np.exp(theta[len(chosen) + 1 :])))
    return Model(dict(zip(seen[chosen].tolist(), theta[: len(chosen)].tolist(), strict=True)), cut)


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[np.ndarray], np.ndarray]:
    usable = labels.select("doc_id", "toxic").where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, sample / max(1, usable.count()))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    chosen = usable.where(place < int(share * 1_000_000))
    joined = with_columns(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")

    def run(batches):
        for b in batches:
            made = [np.unique(np.array([c for w in words(t) for c in codes(w)], np.int32)).tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary())], names=["doc_id", "toxic", "codes"])

    made = settle(joined.mapInArrow(run, "doc_id bigint, toxic int, codes binary").groupBy("doc_id").agg(F.min(F.struct("toxic", "codes")).alias("r")).select("doc_id", "r.*"))
    # Fewer rows where these are long, by the same hash, so that their bytes are bounded as well.
    size = F.octet_length("codes")
    made = made.where(size <= SAMPLE_BYTES // 16)
    total = made.agg(F.sum(size)).first()[0] or 0
    found = made.where(place < int(share * min(1.0, SAMPLE_BYTES / max(1, total)) * 1_000_000)).collect()
    found.sort(key=lambda r: r["doc_id"])
    return [np.frombuffer(r["codes"], np.int32) for r in found], np.array([r["toxic"] for r in found])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    bounded_batches(docs.sparkSession)
    return fit(*training_rows(docs, labels, sample))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, severity, grade and toxic for every document."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value)
        for b in batches:
            severity, grade, toxic = zip(*map(scorer, b.column(1).to_pylist()), strict=True) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(severity, pa.float64()), pa.array(grade, pa.int32()), pa.array(toxic, pa.bool_())], names=["doc_id", "severity", "grade", "toxic"])

    return with_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, severity double, grade int, toxic boolean")


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are not toxic, with the columns they came with."""
    bounded_batches(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        scorer = Scorer(shared.value)
        for b in batches:
            yield b.filter(pa.array([not scorer(t)[2] for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
