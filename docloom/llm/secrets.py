"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Two bigram models over characters, one of random strings and one of ordinary
identifiers, are trained from labelled samples. A run of key-like characters is
reported when the mean log-likelihood ratio per transition favours the random
model by more than a threshold. The fixed patterns stay as they are; the models
only add spans.

Cases: a null text counts as empty and has no spans; rows are independent, so
repeated rows give repeated results; an empty table gives an empty table; extra
columns are ignored; texts of any length are scanned whole. Offsets are code
points, ends exclusive.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.llm.common import bounded_batches, with_columns

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_HINTS = ("passw", "secret", "token", "key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"(?<!\w)[A-Za-z0-9+/_=-]{20,}(?!\w)")
MIN_VALUE = 6

#: Words that ordinary identifiers are made of.
IDENTIFIER_WORDS = """account action active address array base batch buffer build cache call check class client
close code column config connection content context control copy count create current data date default delete
description device directory document element enable encoding entry error event example field file filter first
format function group handler header height index info input instance item label language last length level limit
line list load local location manager map message method mode model module name network node number object offset
option order output package page parent parse path pattern payment position previous process product profile
property provider query queue range read record reference register remote report request resource response result
return route row schema screen search section select server service session shape size source start state status
stream string style table target task template test text theme thread time title total transaction type update
user value vector version view width window worker write""".split()
_SYLLABLES = """an ar be ber con de den der ed el en er es est for ge hea in ing ion is it la le lich lo ma men
ment mi mo na nd no on or ou para que ra re ri ro sa sch se so st sta ta te th tion to tra un ung ver vi with""".split()
_ALPHABETS = (
    "0123456789abcdef",
    "0123456789ABCDEF",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "abcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-",
)


def labelled_samples(n: int = 4000, seed: int = 7) -> list[tuple[str, int]]:
    """n random strings (1) and n ordinary identifiers (0), the same on every machine."""
    r, out = random.Random(seed), []
    for i in range(n):
        letters = _ALPHABETS[i % len(_ALPHABETS)]
        out.append(("".join(r.choice(letters) for _ in range(r.randint(20, 64))), 1))
    for i in range(n):
        words = [r.choice(IDENTIFIER_WORDS) for _ in range(r.randint(2, 6))]
        kind = i % 6
        if kind == 0:
            s = "_".join(words)
        elif kind == 1:
            s = words[0] + "".join(w.title() for w in words[1:])
        elif kind == 2:
            s = "-".join(words)
        elif kind == 3:
            s = "_".join(words).upper()
        elif kind == 4:
            s = "/".join(words) + str(r.randint(0, 2030))
        else:
            s = "".join(r.choice(_SYLLABLES) for _ in range(r.randint(6, 14)))
        out.append((s + (f"_{r.randint(0, 99)}" if r.random() < 0.2 else ""), 0))
    return out


_CODES = np.full(128, 0, dtype=np.int16)
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-", start=1):
    _CODES[ord(_c)] = _i
_N = 69


@dataclass(frozen=True)
class MarkovModels:
    """ratio[a, b]: log P(b | a) under the random model less that under the identifier model."""

    ratio: np.ndarray
    threshold: float

    def score(self, s: str) -> float:
        """Mean log-likelihood ratio per transition; over the threshold: random. Strings of under two characters: 0."""
        if len(s) < 2:
            return 0.0
        codes = _CODES[np.frombuffer(s.encode("ascii", "replace"), dtype=np.uint8) & 127]
        return float(self.ratio[codes[:-1], codes[1:]].mean())


def train(samples: list[tuple[str, int]], threshold: float = 0.35, smoothing: float = 0.5) -> MarkovModels:
    counts = np.full((2, _N, _N), smoothing)
    for s, label in samples:
        codes = _CODES[np.frombuffer(s.encode("ascii", "replace"), dtype=np.uint8) & 127]
        np.add.at(counts[label], (codes[:-1], codes[1:]), 1)
    logs = np.log(counts) - np.log(counts.sum(axis=2, keepdims=True))
    return MarkovModels(logs[1] - logs[0], threshold)


@functools.cache
def default_models() -> MarkovModels:
    return train(labelled_samples())


def _base(text: str) -> Iterator[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of the fixed patterns."""
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS) and ("=" in text or ":" in text):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= MIN_VALUE:
                yield m.start(), 0, m.end(), m.start(2)
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            yield m.start(), 1, m.end(), m.start()
    for m in HEX.finditer(text):
        yield m.start(), 2, m.end(), m.start()


def spans(text: str | None, models: MarkovModels | None = None) -> list[tuple[int, int, int, int]]:
    """All spans of a text as (start, kind, end, start of the value), by start and then kind."""
    if not text:
        return []
    models = models or default_models()
    found = list(_base(text))
    found += [(m.start(), 3, m.end(), m.start()) for m in CANDIDATE.finditer(text) if models.score(m.group()) > models.threshold]
    return sorted(found)


def redact(text: str | None, found: list[tuple[int, int, int, int]], mark: str = "[SECRET]") -> str | None:
    """The text with each secret value replaced; overlapping values count as one."""
    if not found or text is None:
        return text
    out, at = [], 0
    for lo, hi in sorted((v, e) for _, _, e, v in found):
        if hi <= at:
            continue
        if lo >= at:
            out += [text[at:lo], mark]
        at = hi
    return "".join([*out, text[at:]])


SPAN = "struct<kind:string,start:int,end:int,value_start:int>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and ``spans``, an array of structs in order of start and kind."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            found = [[{"kind": KINDS[k], "start": s, "end": e, "value_start": v} for s, k, e, v in spans(t)] for t in texts]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value_start", pa.int32())]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(found, kind)], names=["doc_id", "spans"])

    return with_columns(docs, id_col, text_col).mapInArrow(run, f"doc_id bigint, spans array<{SPAN}>")


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same columns and rows, with secret values masked in the text. Other columns are passed through."""
    bounded_batches(docs.sparkSession)
    schema, at = docs.schema, docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            texts = pa.array([redact(t, spans(t)) for t in b.column(at).to_pylist()], b.schema.field(at).type)
            yield b.set_column(at, b.schema.field(at), texts)

    return docs.mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of what scan() returns."""
    from pyspark.sql import functions as F

    def joined(keep):
        part = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        return F.concat_ws(",", F.transform(F.filter("spans", keep), part))

    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    base = joined(lambda s: s["kind"] != "markov")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base, 256).alias("base_sha256"), joined(lambda s: F.lit(True)).alias("spans"))


def digest_of(texts: list[str | None]) -> list[str]:
    """Brute-force form of base_sha256, for tests."""
    return [hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in sorted(_base(t or ""))).encode()).hexdigest() for t in texts]
