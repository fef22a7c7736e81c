"""Styled blocks of docx files: effective properties from the style sheet, and the formats of lists.

A file is a zip of XML, so Python opens it; its style sheet, some hundred entries,
is folded there too, once per file and not per block, and no join is needed.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from itertools import batched
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from docloom.sources.documents import NS, _flag, _number, _run_text, _value, heading_level

RUN = "font:string,size_half_pt:int,bold:boolean,italic:boolean,underline:string,color:string,strike:boolean,caps:boolean,char_spacing:int"
RUN_NAMES = [c.split(":")[0] for c in RUN.split(",")]
PARA = "alignment string, indent_left int, indent_right int, indent_hanging int, indent_first_line int, space_before int, space_after int, line int"
PARA_NAMES = [c.split(" ")[0] for c in PARA.split(", ")]
STYLED = (
    f"path string, block_index int, page int, kind string, level tinyint, in_table boolean, text string, style_name string, {PARA}, num_id bigint, ilvl bigint, "
    f"number_kind string, level_text string, numbering_unresolved boolean, style_unresolved boolean, font string, size_half_pt int, bold boolean, italic boolean, underline string, color string, "
    f"segments array<struct<text:string,style:struct<{RUN}>>>"
)


def _attribute(props: ET.Element | None, name: str, *keys: str) -> str | None:
    """The first of an element's attributes that is there."""
    found = props.find(NS + name) if props is not None else None
    return next((found.get(NS + k) for k in keys if found is not None and found.get(NS + k) is not None), None)


def run_properties(props: ET.Element | None) -> dict:
    """What a run, a style or the defaults set of a run's look; null where not set."""
    return {
        "font": _attribute(props, "rFonts", "ascii"), "size_half_pt": _number(_value(props, "sz")), "bold": _flag(props, "b"), "italic": _flag(props, "i"), "underline": _value(props, "u"),
        "color": _value(props, "color"), "strike": _flag(props, "strike"), "caps": _flag(props, "caps"), "char_spacing": _number(_value(props, "spacing")),
    }


def paragraph_properties(props: ET.Element | None) -> dict:
    """What a paragraph or a style sets of alignment, indents and spacing. A hanging indent rules out one of the first line."""
    n = lambda element, *keys: _number(_attribute(props, element, *keys))
    hanging = n("ind", "hanging")
    return {
        "alignment": _value(props, "jc"), "indent_left": n("ind", "left", "start"), "indent_right": n("ind", "right", "end"), "indent_hanging": hanging,
        "indent_first_line": n("ind", "firstLine") if hanging is None else None, "space_before": n("spacing", "before"), "space_after": n("spacing", "after"), "line": n("spacing", "line"),
    }


def fold(layers: list[dict], names: list[str]) -> dict:
    """Each property from the last layer that sets it."""
    return {n: next((x[n] for x in reversed(layers) if x.get(n) is not None), None) for n in names}


class Sheet:
    """A file's styles, defaults and lists. The first of entries with the same id counts."""

    def __init__(self, styles: ET.Element | None, lists: ET.Element | None) -> None:
        every = lambda root, tag: root.iter(NS + tag) if root is not None else ()
        defaults = styles.find(f"{NS}docDefaults/{NS}rPrDefault/{NS}rPr") if styles is not None else None
        self.defaults = run_properties(defaults)
        self.styles, self.abstract, self.formats = {}, {}, {}
        for s in every(styles, "style"):
            entry = {"run": run_properties(s.find(NS + "rPr")), "para": paragraph_properties(s.find(NS + "pPr")), "based_on": _value(s, "basedOn")}
            self.styles.setdefault(s.get(NS + "styleId"), entry)
        for n in every(lists, "num"):
            self.abstract.setdefault(_number(n.get(NS + "numId")), _number(_value(n, "abstractNumId")))
        for a in every(lists, "abstractNum"):
            for lv in a.findall(NS + "lvl"):
                place = (_number(a.get(NS + "abstractNumId")), _number(lv.get(NS + "ilvl")))
                self.formats.setdefault(place, (_value(lv, "numFmt") or "decimal", _value(lv, "lvlText") or ""))
        self._chains: dict[str, tuple[list[dict], bool]] = {}

    def chain(self, style_id: str | None) -> tuple[list[dict], bool]:
        """A style's layers from its root on, and whether it or an ancestor is missing; a cycle ends where it closes."""
        if style_id is None:
            return [], False
        if style_id not in self._chains:
            seen, at = {}, style_id
            while at is not None and at not in seen and at in self.styles:
                seen[at] = self.styles[at]
                at = seen[at]["based_on"]
            self._chains[style_id] = (list(seen.values())[::-1], at is not None and at not in self.styles)
        return self._chains[style_id]

    def run(self, props: ET.Element | None, paragraph_style: str | None) -> tuple[dict, bool]:
        """Defaults, then the paragraph's style, the run's own style and what the run itself sets."""
        of_para, broken = self.chain(paragraph_style)
        of_run, broken_too = self.chain(_value(props, "rStyle"))
        return fold([self.defaults, *[s["run"] for s in of_para + of_run], run_properties(props)], RUN_NAMES), broken or broken_too

    def paragraph(self, props: ET.Element | None, style: str | None) -> tuple[dict, bool]:
        """The paragraph's style and what the paragraph itself sets; the defaults of paragraphs are left out."""
        layers, broken = self.chain(style)
        return fold([*[s["para"] for s in layers], paragraph_properties(props)], PARA_NAMES), broken

    def list_format(self, num_id: int, ilvl: int) -> tuple[str, str] | None:
        return self.formats.get((self.abstract[num_id], ilvl)) if num_id in self.abstract else None


def _segments(runs: list[tuple[str, dict]]) -> list[dict]:
    """Runs joined where they look the same; blank ones join the one before, empty ones go."""
    out: list[dict] = []
    for text, look in runs:
        if text and out and (out[-1]["style"] == look or not text.strip()):
            out[-1]["text"] += text
        elif text:
            out.append({"text": text, "style": look})
    return out


def _block(p: ET.Element, in_table: bool, sheet: Sheet) -> dict | None:
    runs = [(r, _run_text(r)) for r in p.findall(NS + "r")]
    text = "".join(t for _, t in runs)
    if not text.strip():
        return None
    props = p.find(NS + "pPr")
    style = _value(props, "pStyle")
    looks = [(t, *sheet.run(r.find(NS + "rPr"), style)) for r, t in runs if t]
    parts = _segments([(t, look) for t, look, _ in looks])
    longest = max(parts, key=lambda s: len(s["text"]))["style"]  # the first of equals
    effective, broken = sheet.paragraph(props, style)
    level = heading_level(style)
    num_id, ilvl = _number(_value(props, "numPr", "numId")), _number(_value(props, "numPr", "ilvl"))
    shape = sheet.list_format(num_id, ilvl or 0) if num_id is not None else None
    kind = "heading" if level is not None else "list_item" if num_id is not None else "table_cell" if in_table else "paragraph"
    return effective | {n: longest[n] for n in ("font", "size_half_pt", "bold", "italic", "underline", "color")} | {
        "kind": kind, "level": level, "in_table": in_table, "text": text, "style_name": style, "num_id": num_id, "ilvl": ilvl, "number_kind": shape and shape[0], "level_text": shape and shape[1],
        "numbering_unresolved": num_id is not None and shape is None, "style_unresolved": broken or any(b for _, _, b in looks), "segments": parts,
    }


def _breaks(p: ET.Element) -> tuple[bool, bool]:
    """Whether a paragraph starts a page, and whether a break in it ends one."""
    return bool(_flag(p.find(NS + "pPr"), "pageBreakBefore")), any(b.get(NS + "type") == "page" for r in p.findall(NS + "r") for b in r.findall(NS + "br"))


def parse_styled(data: bytes) -> Iterator[dict]:
    """The blocks of a file in order: its paragraphs and those of its tables' cells, blank ones left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        there = set(z.namelist())
        part: Callable[[str], ET.Element | None] = lambda n: ET.fromstring(z.read(n)) if n in there else None
        sheet = Sheet(part("word/styles.xml"), part("word/numbering.xml"))
        body = ET.fromstring(z.read("word/document.xml")).find(NS + "body")
    index, page = 0, 1
    for x in body if body is not None else ():
        alone = x.tag == NS + "p"
        before, after = _breaks(x) if alone else (False, False)
        page += before
        held = [x] if alone else x.findall(f"{NS}tr/{NS}tc/{NS}p") if x.tag == NS + "tbl" else []
        for p in held:
            block = _block(p, not alone, sheet)
            if block is not None:
                yield {"block_index": index, "page": page, **block}
                index += 1
        page += after


def read_styled(spark: SparkSession, path: str) -> DataFrame:
    """Styled blocks of docx files, as the style operators take them; doc_id is a hash of the path.

    A file without a style sheet or lists has no inherited properties; a style or a list that is named but
    missing leaves its block unresolved. A worker holds one file at a time, and hands on 1,000 blocks at once.
    """

    schema = to_arrow_schema(StructType.fromDDL(STYLED))

    def run(batches):
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                for rows in batched(({"path": name, **x} for x in parse_styled(content.as_py())), 1000):
                    yield pa.RecordBatch.from_pylist(list(rows), schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "content")
    return files.mapInArrow(run, STYLED).withColumn("doc_id", F.xxhash64("path"))
