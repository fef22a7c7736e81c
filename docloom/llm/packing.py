"""Packing: order-preserving dynamic programming over window cuts.

Documents are laid end to end in the order of their partition. A cut falls at the
end of a document (free) or of a sentence, whose truncation counts as much as a
64th of a window of padding. Only a passage of more than a quarter of a window
without such ends may be cut within, at steps of a 64th, which counts as much as
a quarter. The cost of a window is its padding plus the penalty of its
end:

    f(j) = penalty(j) + min over i, c(j) - c(i) <= W, of f(i) + W - (c(j) - c(i))

As f(i) + c(i) does not depend on j, a monotone queue holds the minimum and each
cut costs amortised constant time. Cuts are settled every ``SEGMENT`` tokens, so
memory is bounded whatever a partition holds.

Each partition packs its own documents. What is left of it, under a window, goes
on to a second pass, which packs the rests of ``RESTS`` partitions at a time in
the same way; only these rests are shuffled. The last sequence of such a group is
short, and ends with a document. sequence_id carries the partition's number, or
the group's, in its high bits.

Cases: a null text counts as empty; every document has its end-of-document id,
so each has a piece; repeated rows are packed again; an empty table gives an
empty table; extra columns are ignored; documents over a window are cut. A text
that spells an added token, such as <|endoftext|>, is plain text, so that no
document can forge an end; with added="ids" it is that token's id, as the
tokenizer does by itself.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import bounded_batches, settle, with_columns

WINDOW, END_ID = 4096, 2
#: Of a window: the penalties, the length of a passage that may be cut within, and the steps there.
SENTENCE_PENALTY, INNER_PENALTY, LONG, STEP = 1 / 64, 1 / 4, 1 / 4, 1 / 64
SEGMENT, RESTS = 1 << 20, 256
CACHE_WORDS = 800_000
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Letters and numbers of Latin-1 in lower case, for texts that its 256 characters can write.
_LETTER, _NUMBER = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
#: The pre-tokens of such a text: what the tokenizer's own pattern cuts, letters tried first.
_PRETOKEN = re.compile(f"[{_LETTER}]+|[{_NUMBER}]|'s|'t|'re|'ve|'m|'ll|'d|[^\\t-\\r \\x85\\xa0{_LETTER}{_NUMBER}]+")


class WordTokenizer:
    """Ids of texts under a word-level BPE, whose pre-tokens are encoded one by one.

    Ids of pre-tokens are kept in a bounded cache, so a frequent word is encoded
    once; the library encodes all others, many in one call. Latin-1 texts, which
    the tokenizer's normaliser only lower-cases, are cut here; others are cut at
    spaces and left to the library. Texts that may hold an added token, such as
    <|endoftext|>, go to the library whole, as it alone tells where these stand,
    unless added tokens are to be read as text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tk = Tokenizer.from_file(path)
        self.added = [a.content.lower() for a in self.tk.get_added_tokens_decoder().values()]
        self.cache: dict[str, bytes] = {}
        size = self.tk.get_vocab_size()
        self.sentence_end, self.word_end = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
        for token, i in self.tk.get_vocab().items():
            body = token.removesuffix("</w>")
            self.word_end[i] = token.endswith("</w>")
            self.sentence_end[i] = self.word_end[i] and body[-1:] in (".", "!", "?") and not any(c.isalnum() for c in body)

    def _learn(self, new: list[str]) -> None:
        """Ids of pre-tokens: encoded as one text, then parted at the tokens that end a word."""
        at = 0
        while at < len(new):
            part = new[at : at + 20_000]
            ids = np.array(self.tk.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = (np.flatnonzero(self.word_end[ids]) + 1).tolist()
            if len(ends) != len(part):
                raise ValueError("a pre-token was cut")
            raw, start = ids.tobytes(), 0
            for x, end in zip(part, ends, strict=True):
                self.cache[x] = raw[4 * start : 4 * end]
                start = end
            at += len(part)

    def encode(self, texts: list[str | None], end_id: int | None = None, added: str = "ids") -> list[np.ndarray]:
        """Ids of each text. ``added``: "ids" where a text that spells an added token has that token's id, "text" where it is text like any other."""
        self.tk.encode_special_tokens = added == "text"
        cache, tail = self.cache, b"" if end_id is None else np.uint32(end_id).tobytes()
        if len(cache) > CACHE_WORDS:
            cache.clear()
        lower = [(t or "").lower() for t in texts]
        whole = [added == "ids" and any(a in x for a in self.added) for x in lower]
        parts = [_PRETOKEN.findall(x) if not w and _latin(t or "") else None for t, x, w in zip(texts, lower, whole, strict=True)]
        new = list(set().union(*filter(None, parts)) - cache.keys())
        self._learn(new)
        get, out = cache.__getitem__, []
        for t, p, w in zip(texts, parts, whole, strict=True):
            if p is None:
                found = self.tk.encode_batch_fast([t] if w else t.replace("\n", " ").split(" "), add_special_tokens=False)
                out.append(np.array([i for e in found for i in e.ids] + [end_id] * (end_id is not None), dtype="<u4"))
            else:
                out.append(np.frombuffer(b"".join([*map(get, p), tail]), dtype="<u4"))
        for x in new:
            if len(x) > 64:
                del cache[x]
        return out


def _latin(t: str) -> bool:
    try:
        t.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str | None = None) -> WordTokenizer:
    """One per worker process."""
    path = path or default_tokenizer()
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def cuts(ends: np.ndarray, cost: np.ndarray, start: int, window: int, last: bool) -> list[int]:
    """The positions at which windows end, from the candidates ``ends`` (ascending, gaps of at most a window).

    With ``last``, the final position is reached and its window costs nothing;
    else the cut of least cost within a window of it is the last, and what follows is left.
    """
    c, pen = [start, *ends.tolist()], [0, *cost.tolist()]
    f, back = [0] * len(c), [0] * len(c)
    queue: deque[tuple[int, int]] = deque([(start, 0)])  # (f(i) + c(i), i), increasing in both
    head, pop, push = queue.popleft, queue.pop, queue.append
    for j in range(1, len(c)):
        at = c[j]
        least = at - window
        while c[queue[0][1]] < least:
            head()
        g, i = queue[0]
        back[j] = i
        f[j] = v = pen[j] + g + window - at
        v += at
        while queue and queue[-1][0] >= v:
            pop()
        push((v, j))
    j = len(c) - 1
    if last:
        out = [c[j]]
        reach = [i for i in range(max(0, int(np.searchsorted(c, c[j] - window))), j)]
        j = min(reach, key=lambda i: f[i] + c[i])
    else:
        out = []
        near = range(int(np.searchsorted(c, c[j] - window)), j + 1)
        j = min(near, key=lambda i: (f[i], -i))
    while j:
        out.append(c[j])
        j = back[j]
    return out[::-1]


class Packer:
    """Takes documents' ids in order and returns pieces once their windows are settled."""

    def __init__(self, sentence_end: np.ndarray, first_sequence: int = 0, window: int = WINDOW, segment: int = SEGMENT):
        self.sentence_end, self.sequence, self.window, self.segment = sentence_end, first_sequence, window, segment
        self.docs: deque[tuple[int | None, int, np.ndarray]] = deque()  # id, position in the stream, ids
        self.start = self.end = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> list[tuple]:
        self.docs.append((doc_id, self.end, ids))
        self.end += len(ids)
        return self.settle(False) if self.end - self.start >= self.segment else []

    def _candidates(self) -> tuple[np.ndarray, np.ndarray]:
        where, cost, fill = [], [], max(1, int(STEP * self.window))
        for _, at, ids in self.docs:
            ends = np.append(np.flatnonzero(self.sentence_end[ids[:-1]]) + 1, len(ids))
            pen = np.full(len(ends), SENTENCE_PENALTY * self.window)
            pen[-1] = 0
            gaps = np.diff(ends, prepend=0)
            if gaps.max() > LONG * self.window:
                wide = np.flatnonzero(gaps > LONG * self.window)
                more = np.concatenate([np.arange(ends[i] - gaps[i] + fill, ends[i], fill) for i in wide])
                ends, pen = np.append(ends, more), np.append(pen, np.full(len(more), INNER_PENALTY * self.window))
                order = np.argsort(ends, kind="stable")
                ends, pen = ends[order], pen[order]
            where.append(ends + at)
            cost.append(pen)
        where, cost = np.concatenate(where), np.concatenate(cost)
        keep = np.append(where[1:] != where[:-1], True) & (where > self.start)
        return where[keep], cost[keep]

    def settle(self, last: bool) -> list[tuple]:
        if self.end == self.start:
            return []
        rows, at = [], self.start
        for end in cuts(*self._candidates(), self.start, self.window, last):
            rows += self._window(at, end)
            at = end
        self.start = at
        while self.docs and self.docs[0][1] + len(self.docs[0][2]) <= at:
            self.docs.popleft()
        return rows

    def rest(self) -> list[tuple]:
        """(doc_id, start, ids, doc_tokens) of what is not settled yet, in order."""
        left = [(doc_id, max(0, self.start - at), ids) for doc_id, at, ids in self.docs]
        return [(doc_id, a, ids[a:], len(ids)) for doc_id, a, ids in left if a < len(ids)]

    def _window(self, lo: int, hi: int) -> list[tuple]:
        rows = []
        while self.docs and self.docs[0][1] + len(self.docs[0][2]) <= lo:
            self.docs.popleft()
        for doc_id, at, ids in self.docs:
            if at >= hi:
                break
            a, b = max(lo, at), min(hi, at + len(ids))
            rows.append((doc_id, a - at, b - a, zlib.crc32(ids[a - at : b - at].tobytes()), len(ids), self.sequence, a - lo))
        self.sequence += 1
        return rows


def _batch(rows: list[tuple], names: list[str], rests: bool = False) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.binary()] * rests
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def pack(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", added: str = "text") -> DataFrame:
    """The pieces of all documents; see SCHEMA, and WordTokenizer.encode() for ``added``."""
    bounded_batches(docs.sparkSession)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches):
        from pyspark import TaskContext

        tk, partition = tokenizer(tokenizer_path), TaskContext.get().partitionId()
        packer = Packer(tk.sentence_end, partition << 40, window)
        for b in batches:
            rows = []
            for i, ids in zip(b.column(0).to_pylist(), tk.encode(b.column(1).to_pylist(), END_ID, added), strict=True):
                rows += packer.add(i, ids)
            if rows:
                yield _batch([(*r, None) for r in rows], [*names, "rest"], True)
        if rows := packer.settle(False):
            yield _batch([(*r, None) for r in rows], [*names, "rest"], True)
        if rows := [(doc_id, start, len(ids), 0, n, partition, k, ids.tobytes()) for k, (doc_id, start, ids, n) in enumerate(packer.rest())]:
            yield _batch(rows, [*names, "rest"], True)

    def run_rests(batches):
        tk, group, packer, pieces = tokenizer(tokenizer_path), None, None, []

        def placed(rows):
            return [(pieces[k][0], pieces[k][1] + start, n, crc, pieces[k][2], sequence, offset) for k, start, n, crc, _, sequence, offset in rows]

        for b in batches:
            rows = []
            for g, doc_id, start, n, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if g != group:
                    rows += placed(packer.settle(True)) if packer else []
                    group, packer, pieces = g, Packer(tk.sentence_end, (1 << 62) + (g << 40), window), []
                pieces.append((doc_id, start, n))
                rows += placed(packer.add(len(pieces) - 1, np.frombuffer(ids, "<u4")))
            if rows:
                yield _batch(rows, names)
        if packer and (rows := placed(packer.settle(True))):
            yield _batch(rows, names)

    # Written, as what is settled and what is left come from one pass over the texts.
    first = settle(with_columns(docs, id_col, text_col).mapInArrow(run, SCHEMA + ", rest binary"))
    rests = first.where("rest IS NOT NULL").select(F.floor(F.col("sequence_id") / RESTS).alias("group"), "doc_id", "start", "doc_tokens", "rest", "sequence_id", "offset")
    rests = rests.repartition("group").sortWithinPartitions("group", "sequence_id", "offset").select("group", "doc_id", "start", "doc_tokens", "rest")
    return first.where("rest IS NULL").select(*names).unionByName(rests.mapInArrow(run_rests, SCHEMA))
