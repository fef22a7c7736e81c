"""Markdown inventories of bracketed variables, document by document.

The same inventories as sections.render() gives from hits and snippet_index(), in
one pass: blocks are dealt by document and sorted, and a worker goes through each
document's blocks once. So one exchange moves each text once, and no bracket, hit,
range or section is ever a row. A task holds the blocks and the inventory of one
document, which is a row of the result anyway.

Cases: blocks without a kind have no fields; null texts and cells have no hits and
no text; a document without an id has no inventory of variables, as null ids join
with nothing; blocks without an index are passed over; blocks that share an index
are blocks of their own, in order of their texts.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.brackets import LONG
from docloom.operators.sections import DISPLAY, HEAD, KIND_LABELS, SLUG
from docloom.session import bounded_batches

#: Characters of inventories that are gathered before they leave a worker.
GATHERED = 1 << 22
_BRACKET, _OTHER = re.compile(r"[\[\]]"), re.compile("[^A-Za-z0-9]+")
#: What (?U)\s matches in Java.
_SPACES = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_SEPARATORS = re.compile(r"[\x1c-\x1f]")


def collapse(s: str) -> str:
    """Runs of white space as one space, none at the ends; split() alone would also take the four separators."""
    return _SPACES.sub(" ", s).strip(" ") if _SEPARATORS.search(s) else " ".join(s.split())


def slug(text: str) -> str:
    """As sections.slug(); what a long text's first part fills needs no more of it."""
    dashed = _OTHER.sub("-", text[:HEAD]).lower().removeprefix("-")
    if len(dashed) <= SLUG:
        dashed = _OTHER.sub("-", text).lower().removeprefix("-")
    return dashed.removesuffix("-")[:SLUG].removesuffix("-") or "span"


def display_cell(parts: Iterable[str]) -> str:
    """A span, given in parts, for a table cell. Parts past what the cell shows are not read."""
    held, size, checked = [], 0, False
    for p in parts:
        held.append(p)
        size += len(p)
        if size >= HEAD and not checked:
            checked = True
            if len(collapse("".join(held)[:HEAD])) > DISPLAY:
                break
    c = "".join(held)
    head = collapse(c[:HEAD])
    plain = (head if len(head) > DISPLAY else collapse(c)).replace("`", "'")
    short = plain[:DISPLAY] + "…" if len(plain) > DISPLAY else plain
    return "`" + short.replace("|", "\\|") + "`"


def _parts(text: str, start: int, end: int) -> Iterator[str]:
    """A part of a text: first what a cell may show, then the rest."""
    yield text[start : min(end, start + HEAD)]
    if end > start + HEAD:
        yield text[start + HEAD : end]


def field_places(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of pairs and lone brackets of a field; a lone one reaches to its line's end or start."""
    out, opened = [], []
    breaks = [m.start() for m in re.finditer("\n", text)] if "\n" in text else []
    for m in _BRACKET.finditer(text):
        at = m.start()
        if text[at] == "[":
            opened.append(at)
        elif opened:
            start = opened.pop()
            out.append((start, at + 1, "paired_long" if at + 1 - start > LONG else "paired"))
        else:
            k = bisect(breaks, at)
            out.append((breaks[k - 1] + 1 if k else 0, at + 1, "lone_close"))
    for at in opened:
        k = bisect(breaks, at)
        out.append((at, breaks[k] if k < len(breaks) else len(text), "lone_open"))
    return out


def table_markdown(rows: list | None) -> str:
    width = max((len(r) for r in rows or () if r is not None), default=0)
    if not width:
        return ""
    cell = lambda r, i: collapse(r[i]).replace("|", "\\|") if r is not None and i < len(r) and r[i] is not None else ""
    lines = ["| " + " | ".join(cell(r, i) for i in range(width)) + " |\n" for r in rows]
    return lines[0] + "|" + " --- |" * width + "\n" + "".join(lines[1:]) + "\n"


def block_markdown(kind: str | None, level: int | None, text: str | None, rows: list | None) -> str:
    if kind == "table":
        return table_markdown(rows)
    if text is None:
        return ""
    return ("#" * min(max(1 if level is None else level, 1), 6) + " " if kind == "heading" else "") + text + "\n\n"


def _flat(block: tuple) -> str | None:
    """A block's text, tables as rows of cells."""
    if block[1] != "table":
        return block[3]
    return None if block[4] is None else "\n".join(" | ".join(c for c in r if c is not None) for r in block[4] if r is not None)


def _fields(block: tuple) -> Iterator[tuple[int, int, str]]:
    if block[1] == "table":
        for r, row in enumerate(block[4] or ()):
            for c, cell in enumerate(row or ()):
                if cell is not None:
                    yield r, c, cell
    elif block[1] is not None and block[3] is not None:
        yield -1, -1, block[3]


def _crossing(blocks: list[tuple], first: int, start: int, last: int, end: int) -> Iterator[str]:
    """The parts of a span from a block to a later one; ``first`` is the place of the first block."""
    some = False
    for k in range(first, len(blocks)):
        if blocks[k][0] > last:
            return
        if (t := _flat(blocks[k])) is None:
            continue
        if some:
            yield "\n\n"
        some = True
        yield from _parts(t, start if blocks[k][0] == blocks[first][0] else 0, min(end, len(t)) if blocks[k][0] == last else len(t))


def markdown(blocks: list[tuple]) -> str:
    """The inventory of one document from its blocks (block_index, kind, level, text, rows) in order."""
    # Hits: [block_index, start, cell_row, cell_col, kind, end, end_block, text of the field, place of the block].
    hits, lone = [], []
    for at, b in enumerate(blocks):
        for row, col, text in _fields(b):
            if "[" not in text and "]" not in text:
                continue
            for start, end, kind in field_places(text):
                hit = [b[0], start, row, col, kind, end, b[0], text, at]
                hits.append(hit)
                if kind.startswith("lone"):
                    lone.append(hit)
    lone.sort(key=lambda h: (h[0], h[2], h[3], h[1], h[5]))
    opened, gone = [], set()
    for h in lone:
        if h[4] == "lone_open":
            opened.append(h)
        elif opened and (o := opened.pop())[0] < h[0]:
            o[4], o[5], o[6] = "paired_cross_paragraph", h[5], h[0]
            gone.add(id(h))
    hits = [h for h in hits if id(h) not in gone] if gone else hits

    out = ["# Detected variables\n\n"]
    if not hits:
        return out[0] + "_No bracketed variables detected._\n"
    # Ranges, numbered in order of their first hits.
    hits.sort(key=lambda h: h[:5])
    ranges: dict[tuple[int, int], list] = {}
    for h in hits:
        guessed = h[4] not in ("paired", "paired_long")
        r = ranges.setdefault((h[0], h[6]), [h[:5], h[4] == "paired_cross_paragraph", False, h[8]])
        r[2] |= guessed
    out.append("## Snippet index\n\n| ID | Block(s) | Review | File |\n|----|----------|--------|------|\n")
    known: dict[tuple[int, int], tuple[str, str]] = {}
    taken: tuple[set, set] = (set(), set())
    last: tuple[dict, dict] = ({}, {})
    slugs: dict[int, str] = {}
    for n, (key, (_, cross, review, place)) in enumerate(sorted(ranges.items(), key=lambda x: (x[1][0], x[0][1])), 1):
        first, end = key
        while place and blocks[place - 1][0] == first:
            place -= 1
        while place < len(blocks) and blocks[place][0] <= end and blocks[place][1] in (None, "table"):
            place += 1
        if place < len(blocks) and blocks[place][0] <= end:
            if place not in slugs:
                slugs[place] = slug(blocks[place][3] or "")
            s = slugs[place]
        else:
            s = "span"
        k = last[cross].get(s, 0) + 1
        while (name := s if k == 1 else f"{s}-{k}") in taken[cross]:
            k += 1
        last[cross][s] = k
        taken[cross].add(name)
        path = f"snippets/{'cross-paragraph/' if cross else ''}{name}.md"
        link = f"[{path}]({path})"
        known[key] = f"S{n}", link
        out.append(f"| S{n} | {first if first == end else f'{first}–{end}'} | {'⚠' if review else ''} | {link} |\n")
    out.append("\n")

    lines: dict[int, list[tuple]] = {}
    for h in hits:
        name, link = known[h[0], h[6]]
        kind = h[4]
        cell = display_cell(_crossing(blocks, h[8], h[1], h[6], h[5]) if kind == "paired_cross_paragraph" else _parts(h[7], h[1], h[5]))
        status = "confident" if kind in ("paired", "paired_long") else "⚠ GUESSED"
        lines.setdefault(h[0], []).append((h[1], h[2], h[3], kind, f"| {name} | {cell} | {KIND_LABELS[kind]} | {status} | {link} |\n"))
    at = 0
    while at < len(blocks):
        # A section: a heading and what follows it up to the next; blocks before the first heading stand alone.
        to, headed = at + 1, blocks[at][1] == "heading"
        while to < len(blocks) and ((headed and blocks[to][1] != "heading") or blocks[to][0] == blocks[at][0]):
            to += 1
        of = list(dict.fromkeys(b[0] for b in blocks[at:to] if b[0] in lines))
        if of:
            out += [block_markdown(*b[1:]) for b in blocks[at:to]]
            out.append("**Variables in this section:**\n\n| ID | Snippet | Kind | Status | File |\n|----|---------|------|--------|------|\n")
            out += [x[-1] for i in of for x in sorted(lines[i])]
            out.append("\n")
        at = to
    return "".join(out)


def inventories(blocks: DataFrame) -> DataFrame:
    """One Markdown inventory per document: (doc_id, markdown) of blocks (doc_id, block_index, kind, level, text, rows)."""
    bounded_batches(blocks.sparkSession)
    kind = blocks.schema["doc_id"].dataType.simpleString()

    def run(batches):
        doc, held, made, size, schema = None, [], [], 0, None

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([d for d, _ in made], schema), pa.array([m for _, m in made], pa.string())], names=["doc_id", "markdown"])

        def close():
            held.sort(key=lambda b: (b[0], b[3] or ""))
            made.append((doc, markdown(held)))
            return len(made[-1][1])

        for b in batches:
            schema = b.schema.field(0).type
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[0] != doc:
                    if doc is not None:
                        size += close()
                    if size >= GATHERED:
                        yield batch()
                        made, size = [], 0
                    doc, held = r[0], []
                if r[1] is not None:
                    held.append(r[1:])
        if doc is not None:
            close()
        if made:
            yield batch()

    dealt = blocks.where("doc_id is not null").select("doc_id", "block_index", "kind", F.col("level").cast("int").alias("level"), "text", "rows")
    done = dealt.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, f"doc_id {kind}, markdown string")
    none = blocks.where("doc_id is null").select("doc_id").distinct().withColumn("markdown", F.lit(markdown([])))
    return done.unionByName(none)
