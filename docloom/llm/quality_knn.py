"""Quality classifier: similarity-weighted votes of the nearest labelled documents in a latent-semantic space.

A document is a bag of word shapes, hashed words and bucketed statistics
(length, repetition, line length); a word of over ``LONGEST`` characters counts as
consecutive parts of that length. A bounded sample of labelled rows
(``SAMPLE``, chosen by a hash of the id) gives inverse document frequencies, a
truncated singular value decomposition and labelled latent vectors; these, of
fixed size, go to every task. Every document is projected and compared with all
labelled vectors by blocked exact cosine products; its nearest labels vote with
their similarity as weight.

Cases: null and empty texts have only their length bucket and still get a score;
repeated rows get equal scores; ties between neighbours go by the order of the
sample, by doc_id; a labelled doc_id with several texts is one row of the sample,
the least of its packed rows; without usable labels every score is 0.5; an empty table
gives an empty table; extra columns are ignored, and labels, lang, source and
doc_id are never inputs of a score. A row without doc_id counts as held out.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import bounded_batches, with_columns

#: Labelled rows that a model is fitted on, at most about this many.
SAMPLE, DIMENSIONS, NEIGHBOURS, POWER = 4000, 64, 15, 4
SHAPES, WORDS, STATS = 1024, 1024, 64
WIDTH = SHAPES + WORDS + STATS
STAT_WEIGHT, CACHE, LONGEST = 4.0, 400_000, 64
_RUNS = re.compile(r"(.)\1+")
_CLASSES = re.compile(r"([A-ZÀ-Þ]+)|([^\W\d_]+)|(\d+)")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def shape(word: str) -> str:
    """Letters, digits and runs of a word in short: "That***" is "Aa*"."""
    return _RUNS.sub(r"\1", _CLASSES.sub(lambda m: "A" if m[1] else "a" if m[2] else "0", word))


class Features:
    """Counts of a text's features, as a dense row."""

    def __init__(self):
        self.cache: dict[str, int] = {}

    def code(self, word: str) -> int:
        return (zlib.crc32(shape(word).encode()) % SHAPES) * WORDS + zlib.crc32(word.lower().strip(".,;:!?").encode()) % WORDS

    def row(self, text: str | None) -> np.ndarray:
        text = text or ""
        words, cache = text.split(), self.cache
        if len(cache) > CACHE:
            cache.clear()
        try:
            codes = list(map(cache.__getitem__, words))
        except KeyError:
            if any(len(w) > LONGEST for w in words):  # such words are never in the cache
                words = [w[at : at + LONGEST] for w in words for at in range(0, len(w), LONGEST)]
            for w in set(words):
                if w not in cache:
                    cache[w] = self.code(w)
            codes = list(map(cache.__getitem__, words))
        out = np.zeros(WIDTH, np.float32)
        n = len(words)
        if n:
            c = np.array(codes, np.int64)
            out[:SHAPES] = np.bincount(c // WORDS, minlength=SHAPES)
            out[SHAPES : SHAPES + WORDS] = np.bincount(c % WORDS, minlength=WORDS)
            np.log1p(out, out=out)
        lines = text.split("\n")
        repeats = 1 - len(set(zip(words, words[1:], strict=False))) / max(n - 1, 1)
        stats = (min(int(math.log2(n + 1)), 15), 16 + min(int(repeats * 16), 15), 32 + min(int((1 - len(set(lines)) / len(lines)) * 16), 15), 48 + min(int(math.log2(len(text) / len(lines) + 1)), 15))
        out[[SHAPES + WORDS + s for s in stats]] = STAT_WEIGHT
        return out


#: Numbers are rounded to multiples of these, so that every sum of products is a whole number under 2**53 times
#: one unit: exact in doubles, in whatever order and block it is taken.
_ROW_UNIT, _UNIT = 2.0**-13, 2.0**-20


def _whole(x: np.ndarray, unit: float) -> np.ndarray:
    return np.rint(x.astype(np.float64) / unit)


@dataclass(frozen=True)
class Model:
    idf: np.ndarray  # (WIDTH,)
    basis: np.ndarray  # (WIDTH, DIMENSIONS), whole multiples of _UNIT
    vectors: np.ndarray  # labelled latent vectors of unit length, whole multiples of _UNIT
    labels: np.ndarray

    def project(self, rows: np.ndarray) -> np.ndarray:
        """Latent vectors of unit length, in whole multiples of _UNIT."""
        x = _whole(rows * self.idf, _ROW_UNIT) @ self.basis
        return _whole(x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9), _UNIT)

    def scores(self, rows: np.ndarray, neighbours: int = NEIGHBOURS, power: int = POWER) -> np.ndarray:
        n = len(self.labels)
        if not n:
            return np.full(len(rows), 0.5)
        cosine = (self.project(rows) @ self.vectors.T).astype(np.int64)
        # The cosine and the place in the sample in one number, so no two are equal and ties go to the earlier place.
        key = cosine * n + np.arange(n - 1, -1, -1)
        k = min(neighbours, n)
        key = np.sort(np.partition(key, n - k, axis=1)[:, n - k :], axis=1)[:, ::-1]
        weight = np.maximum((key // n) * _UNIT**2, 1e-3) ** power
        return (weight * self.labels[n - 1 - key % n]).sum(axis=1) / weight.sum(axis=1)


def fit(rows: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS, seed: int = 3) -> Model:
    """Latent space by subspace iteration on the weighted rows."""
    if not len(rows):
        return Model(np.ones(WIDTH, np.float32), np.zeros((WIDTH, 1)), np.empty((0, 1)), np.empty(0))
    idf = np.log((1 + len(rows)) / (1 + (rows > 0).sum(axis=0))).astype(np.float32) + 0.2
    x = rows * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    basis = np.random.default_rng(seed).normal(size=(WIDTH, min(dimensions, len(rows)))).astype(np.float32)
    for _ in range(8):
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    empty = Model(idf, _whole(basis, _UNIT), np.empty((0, 1)), np.empty(0))
    return Model(empty.idf, empty.basis, empty.project(rows), labels.astype(np.float64))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a bounded sample of rows that are not held out."""
    usable = labels.select("doc_id", "quality").where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = min(1.0, sample / max(1, usable.count()))
    chosen = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    joined = with_columns(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")

    def run(batches):
        features = Features()
        for b in batches:
            rows = pa.array([packed(features.row(t)) for t in b.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), rows], names=["doc_id", "quality", "row"])

    made = joined.mapInArrow(run, "doc_id bigint, quality int, row binary").groupBy("doc_id").agg(F.min(F.struct("quality", "row")).alias("r"))
    # One row an id: as many as the sample has, 1 or 2 kB each.
    found = sorted((r["doc_id"], r["r"]["quality"], bytes(r["r"]["row"])) for r in made.collect())
    rows = np.zeros((len(found), WIDTH), np.float32)
    for i, (_, _, raw) in enumerate(found):
        unpack(raw, rows[i])
    return rows, np.array([q for _, q, _ in found])


def packed(row: np.ndarray) -> bytes:
    """The places and values of a row that are not zero."""
    at = np.flatnonzero(row)
    return at.astype("<u2").tobytes() + row[at].astype("<f4").tobytes()


def unpack(raw: bytes, row: np.ndarray) -> None:
    n = len(raw) // 6
    row[np.frombuffer(raw, "<u2", n)] = np.frombuffer(raw, "<f4", n, 2 * n)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        features, m = Features(), shared.value
        for b in batches:
            texts, scores = b.column(1).to_pylist(), []
            for at in range(0, len(texts), 256):
                scores.append(m.scores(np.stack([features.row(t) for t in texts[at : at + 256]])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(scores))], names=["doc_id", "score"])

    scored = with_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return score(docs, fit(*training_rows(docs, labels, sample)))
