"""Documents from files: plain text and docx, dispatched by extension; page selections and party lists."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.fields import paragraphs

NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DOCX = (
    "path string, block_index int, kind string, level tinyint, text string, rows array<array<string>>, style_name string, alignment string, "
    "indent_left int, indent_hanging int, num_id bigint, ilvl bigint, break_before boolean, breaks_after int, "
    "runs array<struct<text:string,font:string,size_half_pt:bigint,bold:boolean,italic:boolean,underline:string>>"
)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def checked(paths: DataFrame) -> DataFrame:
    """Paths with their format; another extension, or none, is an error."""
    ext = extension(F.col("path"))
    wrong = F.when(ext == "", F.raise_error(F.concat(F.lit("no extension: "), F.col("path")))).otherwise(F.raise_error(F.concat(F.lit("unsupported format: "), ext)))
    return paths.withColumn("format", F.when(ext.isin("txt", "docx"), ext).otherwise(wrong.cast("string")))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of plain text files; doc_id is a hash of the path."""
    docs = spark.read.text(path, wholetext=True).select(F.xxhash64(F.col("_metadata.file_path")).alias("doc_id"), F.col("value").alias("text"))
    return paragraphs(docs)


def _value(parent: ET.Element | None, *names: str) -> str | None:
    """The val attribute at the end of a path of elements."""
    for n in names:
        parent = parent.find(NS + n) if parent is not None else None
    return parent.get(NS + "val") if parent is not None else None


def _flag(props: ET.Element | None, name: str) -> bool | None:
    found = props.find(NS + name) if props is not None else None
    return None if found is None else found.get(NS + "val") not in ("0", "false", "none")


def _number(s: str | None) -> int | None:
    return int(s) if s is not None and re.fullmatch(r"-?\d+", s) else None


def _run_text(run: ET.Element) -> str:
    """Text as it stands, tabs as tabs, breaks as line ends."""
    marks = {NS + "tab": "\t", NS + "br": "\n", NS + "cr": "\n"}
    return "".join((x.text or "") if x.tag == NS + "t" else marks.get(x.tag, "") for x in run)


def heading_level(style: str | None) -> int | None:
    """As style.heading_level(), for the reader."""
    low = (style or "").lower()
    m = re.match(r"heading\s*([0-9]*)", low)
    n = 1 if low == "title" else int(m[1] or 1) if m else 256
    return min(max(n, 1), 6) if n <= 255 else None


def _paragraph(p: ET.Element) -> dict:
    """A paragraph's text and properties. Only its own runs are read: text in links and insertions is not."""
    props, runs, pages = p.find(NS + "pPr"), [], 0
    for r in p.findall(NS + "r"):
        rp = r.find(NS + "rPr")
        fonts = rp.find(NS + "rFonts") if rp is not None else None
        runs.append({
            "text": _run_text(r), "font": fonts.get(NS + "ascii") if fonts is not None else None, "size_half_pt": _number(_value(rp, "sz")),
            "bold": _flag(rp, "b"), "italic": _flag(rp, "i"), "underline": _value(rp, "u"),
        })
        pages = pages or int(any(b.get(NS + "type") == "page" for b in r.findall(NS + "br")))  # one page on, however many breaks
    indent = props.find(NS + "ind") if props is not None else None
    side = lambda k: _number(indent.get(NS + k)) if indent is not None else None
    style = _value(props, "pStyle")
    num = _number(_value(props, "numPr", "numId"))
    return {
        "text": "".join(r["text"] for r in runs), "style_name": style, "alignment": _value(props, "jc"), "indent_left": side("left"), "indent_hanging": side("hanging"),
        "num_id": num, "ilvl": _number(_value(props, "numPr", "ilvl")), "level": heading_level(style), "break_before": bool(_flag(props, "pageBreakBefore")), "breaks_after": pages, "runs": runs,
    }


def parse_docx(data: bytes) -> list[dict]:
    """Blocks of a docx file's body: paragraphs that are not empty, all headings, all tables."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(NS + "body")
    out, before, after = [], 0, 0
    empty = {"level": None, "text": None, "rows": None, "style_name": None, "alignment": None, "indent_left": None, "indent_hanging": None, "num_id": None, "ilvl": None, "runs": []}
    for x in body:
        if x.tag == NS + "p":
            p = _paragraph(x)
            before += p["break_before"]
            if p["text"].strip() == "" and p["level"] is None:
                after += p["breaks_after"]  # a dropped paragraph's breaks still count
                continue
            kind = "heading" if p["level"] is not None else "list_item" if p["num_id"] is not None else "paragraph"
            out.append(empty | p | {"kind": kind, "page": 1 + before + after})
            after += p["breaks_after"]
        elif x.tag == NS + "tbl":
            rows = [["\n".join(_paragraph(p)["text"] for p in c.findall(NS + "p")) for c in r.findall(NS + "tc")] for r in x.findall(NS + "tr")]
            out.append(empty | {"kind": "table", "rows": rows, "break_before": False, "breaks_after": 0, "page": 1 + before + after})
    return [{"block_index": i, **b} for i, b in enumerate(out)]


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of docx files, with their page numbers and properties. The format is a zip of XML, which only Python code can open here."""
    columns = [c.strip().split(" ")[0] for c in re.split(r", (?![^<]*>)", DOCX)] + ["page"]

    def run(batches):
        import pandas as pd

        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                rows = [{"path": name, **x} for x in parse_docx(content)]
                if rows:
                    yield pd.DataFrame(rows)[columns].astype(object).where(lambda d: d.notna(), None)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "content")
    return files.mapInPandas(run, DOCX + ", page int").withColumn("doc_id", F.xxhash64("path"))


def parse_pages(text: str) -> list[tuple[int, int]]:
    """"2-3,5" as ranges; zero, reversed, empty and other parts are errors."""
    out = []
    for part in text.split(","):
        m = re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?", part)
        lo, hi = (int(m[1]), int(m[2] or m[1])) if m else (0, 0)
        if not m or lo < 1 or hi < lo:
            raise ValueError(f"not a page or range: {part!r}")
        out.append((lo, hi))
    return out


def on_pages(ranges: list[tuple[int, int]], page: str = "page") -> Column:
    out = F.lit(False)
    for lo, hi in ranges:
        out |= F.col(page).between(lo, hi)
    return out


def check_pages(blocks: DataFrame, ranges: list[tuple[int, int]]) -> None:
    """An error if a document has no pages, or fewer than the selection names; documents are judged one by one."""
    each = blocks.groupBy("doc_id").agg(F.max("page").alias("last"))
    least, documents, paged = each.agg(F.min("last"), F.count("*"), F.count("last")).first()
    if documents == 0 or paged < documents:
        raise ValueError("this input has no pages")
    if least < max(hi for _, hi in ranges):
        raise ValueError(f"pages up to {max(hi for _, hi in ranges)} are selected, but there are {least}")


def parse_parties(spec: str, read=None) -> list[str]:
    """Names from "a, b" or from the file that "@path" names, parted by commas or line ends."""
    text = (read or (lambda p: open(p).read()))(spec[1:]) if spec.startswith("@") else spec
    return [n.strip() for n in re.split(r"[,\n]", text) if n.strip()]
