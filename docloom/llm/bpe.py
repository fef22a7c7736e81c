"""Byte-level BPE encoding and decoding by DuckDB recursive queries, per partition.

A text is cut into pieces by the tokenizer's pattern. Each distinct piece of a
batch that is no token itself becomes rows (word, position, token), one per byte; positions run on over a batch.
A recursive query joins adjacent rows with the table of merges, contracts each
word's leftmost pair of minimum rank, and ends when no word has a pair left. It
runs for at most ``ROUNDS`` contractions at a time, so its union stays small.
A long word is contracted in segments, which are joined where that gives the same
tokens, so its time grows with its length and not with the square. Decoding joins ids with the vocabulary and
aggregates their bytes in order.

Pieces already encoded stay in a bounded cache of the worker process.

Cases: null and empty texts have no ids; repeated rows are encoded again; an
empty table gives an empty table; extra columns are ignored; texts and pieces of
any length are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.llm.common import bounded_batches, with_columns

ROUNDS, WORD_BYTES, CACHE_PIECES = 24, 1 << 17, 200_000
#: Words of over LONG bytes are contracted in segments of SEGMENT bytes, which are then joined.
LONG, SEGMENT = 256, 64
#: White space, letters and numbers among the 256 characters of Latin-1.
_S, _L, _N = "\\t-\\r \\x85\\xa0", "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
#: The pattern's pieces in texts of those characters, which the standard library finds faster.
_LATIN = re.compile(f" ?[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


#: What cuts a text into pieces; a fixed value of the public vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


STEP = f"""
WITH RECURSIVE t AS (
  SELECT 0 AS step, w, g, tok, false AS done FROM words
  UNION ALL
  (WITH n AS (
    SELECT step, w, g, tok, lead(tok) OVER o AS next_tok, lead(w) OVER o AS next_w, lag(g) OVER o AS prior_g
    FROM t WHERE NOT done AND step < {ROUNDS} WINDOW o AS (ORDER BY g)
  ), j AS (
    SELECT n.*, m.made * {1 << 32} + g AS rank_g FROM n LEFT JOIN merges m ON m.pair = CASE WHEN w = next_w THEN tok * {1 << 20} + next_tok END
  ), b AS (
    SELECT w AS best_w, min(rank_g) AS best FROM j GROUP BY w
  )
  SELECT step + 1, w, g, CASE WHEN best % {1 << 32} = g THEN best // {1 << 32} ELSE tok END, best IS NULL
  FROM j JOIN b ON w = best_w WHERE best IS NULL OR prior_g IS NULL OR prior_g <> best % {1 << 32})
)
SELECT w, g, tok, done FROM t WHERE done OR step = {ROUNDS}
"""

DECODE = "SELECT d, unhex(string_agg(h, '' ORDER BY p)) AS bytes FROM ids JOIN vocabulary USING (tok) GROUP BY d"


class ByteBpe:
    """One DuckDB connection with the tables of a vocabulary."""

    def __init__(self, path: str, pattern: str | None = None):
        import duckdb
        import regex

        self.pattern, self.ranks = regex.compile(pattern or PATTERN), read_ranks(path)
        # Pieces and their ids in two generations: a full one becomes the old one, from which pieces in use come back.
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.latin = self.pattern.pattern == PATTERN
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "250MB"})
        self.con.execute("SET preserve_insertion_order = false")
        tok = np.array(list(self.ranks.values()), np.int64)
        self._table("vocabulary", {"tok": tok, "h": [k.hex() for k in self.ranks]})
        self.raw = {i: k for k, i in self.ranks.items()}
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.merges = False

    def _table(self, name: str, columns: dict) -> None:
        self.con.register("made", pa.table(columns))
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM made")
        self.con.unregister("made")

    def _pieces(self, text: str) -> list[str]:
        if self.latin:
            try:
                text.encode("latin-1")
                return _LATIN.findall(text)
            except UnicodeEncodeError:
                pass
        return self.pattern.findall(text)

    def _contract(self, words: list[bytes]) -> list[np.ndarray]:
        """Tokens of each word once no pair can be contracted."""
        if not self.merges:
            r = self.ranks
            pairs = [(r[k[:i]] * 2**20 + r[k[i:]], n) for k, n in r.items() for i in range(1, len(k)) if k[:i] in r and k[i:] in r]
            pair, made = np.array(pairs, np.int64).T
            self._table("merges", {"pair": pair, "made": made})
            self.merges = True
        sizes = np.array([len(w) for w in words])
        w = np.repeat(np.arange(len(words)), sizes)
        g = np.arange(len(w))
        tok = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        done: list = []
        while len(w):
            self.con.register("words", pa.table({"w": w, "g": g, "tok": tok}))
            got = self.con.execute(STEP).fetchnumpy()
            self.con.unregister("words")
            rest = ~got["done"]
            done.append([got[c][~rest] for c in ("w", "g", "tok")])
            w, g, tok = (np.asarray(got[c][rest]) for c in ("w", "g", "tok"))
        w, g, tok = (np.concatenate([d[i] for d in done]) for i in range(3))
        order = np.argsort(g, kind="stable")
        return np.split(tok[order].astype("<u4"), np.cumsum(np.bincount(w, minlength=len(words)))[:-1])

    def _learn(self, pieces: set[str]) -> None:
        """Put the ids of new pieces into the cache."""
        todo: list[str] = []
        for x in pieces:
            if (known := self.old.get(x)) is not None:
                self.cache[x] = known
            elif (r := self.ranks.get(x.encode())) is not None:
                self.cache[x] = np.uint32(r).tobytes()
            else:
                todo.append(x)
        short = [x.encode() for x in todo if len(x) <= LONG and len(x.encode()) <= LONG]
        long = [x.encode() for x in todo if len(x) > LONG or len(x.encode()) > LONG]
        for words, made in ((short, self._batched(short)), (long, self._joined(long))):
            for w, ids in zip(words, made, strict=True):
                self.cache[w.decode()] = ids.tobytes()

    def _batched(self, words: list[bytes]) -> list[np.ndarray]:
        """Tokens of each word, equal words once and words of like length together."""
        todo, at, found = sorted(set(words), key=lambda w: (len(w), w)), 0, {}
        while at < len(todo):
            start, size = at, 0
            while at < len(todo) and (at == start or size + len(todo[at]) <= WORD_BYTES):
                size += len(todo[at])
                at += 1
            found.update(zip(todo[start:at], self._contract(todo[start:at]), strict=True))
        return [found[w] for w in words]

    def _joined(self, words: list[bytes]) -> list[np.ndarray]:
        """Tokens of long words, from segments that are contracted apart and joined two by two.

        A list of tokens is what contraction gives exactly if the bytes of each two neighbours contract to these
        two: the first contraction over a border would else happen in the two alone as well. So two segments
        join by contracting a few tokens on both sides of the border anew; where the outermost of these come out
        as they were, all neighbours are such pairs. Where not, more tokens are taken.
        """
        if not words:
            return []
        cut = [[w[a : a + SEGMENT] for a in range(0, len(w), SEGMENT)] for w in words]
        made = iter(self._batched([x for c in cut for x in c]))
        parts = [[next(made) for _ in c] for c in cut]
        raw = self.raw
        while any(len(p) > 1 for p in parts):
            joined: dict[tuple[int, int], np.ndarray] = {}
            open_, k = [(w, i) for w, p in enumerate(parts) for i in range(0, len(p) - 1, 2)], 4
            while open_:
                sides = [(parts[w][i], parts[w][i + 1]) for w, i in open_]
                middle = self._batched([b"".join(raw[t] for t in (*a[-k:].tolist(), *b[:k].tolist())) for a, b in sides])
                rest = []
                for at, (a, b), m in zip(open_, sides, middle, strict=True):
                    if (k >= len(a) or m[0] == a[-k]) and (k >= len(b) or m[-1] == b[k - 1]):
                        joined[at] = np.concatenate([a[: max(0, len(a) - k)], m, b[k:]])
                    else:
                        rest.append(at)
                open_, k = rest, 2 * k
            parts = [[joined.get((w, i), p[i]) for i in range(0, len(p), 2)] for w, p in enumerate(parts)]
        return [p[0] for p in parts]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.cache) > CACHE_PIECES:
            self.old, self.cache = self.cache, {}
        parts = [self._pieces(t or "") for t in texts]
        new = set().union(*parts) - self.cache.keys()
        self._learn(new)
        get = self.cache.__getitem__
        out = [b"".join(map(get, p)) for p in parts]
        for x in new:
            if len(x) > 64:
                del self.cache[x]
        return out

    def decode(self, ids: list[bytes], rows: int = 500_000) -> list[bytes]:
        """Bytes of each list of ids. A text's ids are aggregated in runs of at most ``rows``."""
        out: list[list[bytes]] = [[] for _ in ids]
        runs, size = [], 0

        def flush():
            nonlocal runs, size
            if runs:
                tok = [np.frombuffer(x, "<u4") for _, x in runs]
                d = np.repeat(np.arange(len(runs)), [len(x) for x in tok])
                self.con.register("ids", pa.table({"d": d, "p": np.arange(len(d)), "tok": np.concatenate(tok).astype(np.int64)}))
                made = dict(self.con.execute(DECODE).fetchall())
                self.con.unregister("ids")
                for i, (k, _) in enumerate(runs):
                    out[k].append(made[i])
            runs, size = [], 0

        for k, x in enumerate(ids):
            for at in range(0, len(x), 4 * rows):
                part = x[at : at + 4 * rows]
                if size + len(part) // 4 > rows:
                    flush()
                runs.append((k, part))
                size += len(part) // 4
        flush()
        return [b"".join(x) for x in out]


_CODECS: dict[str, ByteBpe] = {}


def codec(path: str | None = None) -> ByteBpe:
    """One per worker process."""
    path = path or default_ranks()
    if path not in _CODECS:
        _CODECS[path] = ByteBpe(path)
    return _CODECS[path]


def encode(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """doc_id and ids, little-endian unsigned 32-bit integers."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        c = codec(ranks_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c.encode(b.column(1).to_pylist()), pa.binary())], names=["doc_id", "ids"])

    return with_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, ids binary")


def decode(encoded: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """doc_id, ids and the bytes they stand for."""
    bounded_batches(encoded.sparkSession)

    def run(batches):
        c = codec(ranks_path)
        for b in batches:
            ids = [x or b"" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array(c.decode(ids), pa.binary())], names=["doc_id", "ids", "bytes"])

    return with_columns(encoded, "doc_id", "ids").mapInArrow(run, "doc_id bigint, ids binary, bytes binary")


def round_trip(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """encode() and decode() in one pass, so that a task needs one worker and one set of tables."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        c = codec(ranks_path)
        for b in batches:
            ids = c.encode(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array(c.decode(ids), pa.binary())], names=["doc_id", "ids", "bytes"])

    return with_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, ids binary, bytes binary")


def reference_digest(path: str, texts: list[str | None]) -> list[tuple[int, str]]:
    """(n_tokens, ids_sha256) by the public library, for tests."""
    import public_tokenizers
    import tiktoken

    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    ids = [np.array(e.encode_ordinary(t or ""), "<u4") for t in texts]
    return [(len(x), hashlib.sha256(x.tobytes()).hexdigest()) for x in ids]
