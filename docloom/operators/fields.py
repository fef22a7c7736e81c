"""Blocks, the fields in them, their neighbours, and content ids of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCKS = "doc_id bigint, block_index int, kind string, level tinyint, text string, rows array<array<string>>"
ORDER = ("doc_id", "block_index", "cell_row", "cell_col")


def paragraphs(docs: DataFrame) -> DataFrame:
    """Blocks of plain texts: split at blank lines, line breaks kept inside, no headings; empty texts have none."""
    clean = F.regexp_replace("text", "\r\n", "\n")
    runs = F.split(clean, r"(?U)\n(?:[\s&&[^\n]]*\n)+")
    trimmed = F.transform(runs, lambda r: F.regexp_replace(r, r"(?U)^(?:[\s&&[^\n]]*\n)+|(?:\n[\s&&[^\n]]*)+$", ""))
    kept = F.filter(trimmed, lambda r: F.regexp_replace(r, r"(?U)\s", "") != "")
    none = F.lit(None)
    return docs.select("doc_id", F.posexplode(kept).alias("block_index", "text")).select(
        "doc_id", "block_index", F.lit("paragraph").alias("kind"), none.cast("tinyint").alias("level"), "text", none.cast("array<array<string>>").alias("rows")
    )


def fields(blocks: DataFrame) -> DataFrame:
    """One row per heading, paragraph or table cell, tables row by row. cell_row and cell_col are null outside tables."""
    none = F.lit(None).cast("int")
    place = lambda r, c, text: F.struct(r.cast("int").alias("cell_row"), c.cast("int").alias("cell_col"), text.alias("text"))
    cells = F.flatten(F.transform("rows", lambda row, r: F.transform(F.coalesce(row, F.array().cast("array<string>")), lambda cell, c: place(r, c, cell))))
    # Blocks without a kind, and rows without cells, have no fields.
    each = F.when(F.col("kind") == "table", cells).when(F.col("kind").isNotNull(), F.array(place(none, none, F.col("text"))))
    rows = blocks.select("doc_id", "block_index", "kind", "level", F.explode(each).alias("f"))
    kind = F.when(F.col("kind") == "table", "table_cell").otherwise(F.col("kind"))
    return rows.select("doc_id", "block_index", "f.cell_row", "f.cell_col", kind.alias("kind"), F.when(F.col("kind") == "heading", F.col("level")).alias("heading_level"), "f.text")


def flow_neighbours(blocks: DataFrame) -> DataFrame:
    """Blocks with the texts above and below; null at the document's edges and beside tables."""
    flow = F.when(F.col("kind") != "table", F.col("text"))
    w = Window.partitionBy("doc_id").orderBy("block_index")
    return blocks.withColumn("above", F.lag(flow).over(w)).withColumn("below", F.lead(flow).over(w))


def table_neighbours(blocks: DataFrame) -> DataFrame:
    """Cells with those above and below, the column's header (null in row 0) and the row's label (null in column 0)."""
    tables = blocks.where("kind = 'table'").select("doc_id", "block_index", "rows", F.posexplode("rows").alias("cell_row", "_cells"))
    cells = tables.select("doc_id", "block_index", "rows", "cell_row", "_cells", F.posexplode("_cells").alias("cell_col", "text"))
    at = lambda r, c: F.get(F.get(F.col("rows"), r), c)
    r, c = F.col("cell_row"), F.col("cell_col")
    return cells.select(
        "doc_id", "block_index", "cell_row", "cell_col", "text",
        F.when(r > 0, at(r - 1, c)).alias("above"), at(r + 1, c).alias("below"),
        F.when(r > 0, at(F.lit(0), c)).alias("col_header"), F.when(c > 0, F.get(F.col("_cells"), F.lit(0))).alias("row_label"),
    )


def _hex(c: Column) -> Column:
    return F.hex(F.encode(c, "UTF-8"))


def content_ids(blocks: DataFrame) -> DataFrame:
    """content_id of each document: the first 8 bytes of SHA-256 over its tagged blocks, in hex."""
    cells = F.transform("rows", lambda row: F.concat(F.array_join(F.transform(row, lambda cell: F.concat(_hex(cell), F.lit("00"))), ""), F.lit("0A")))
    tagged = (
        F.when(F.col("kind") == "heading", F.concat(F.lit("01"), F.lpad(F.hex("level"), 2, "0"), _hex(F.col("text"))))
        .when(F.col("kind") == "table", F.concat(F.lit("03"), F.array_join(cells, "")))
        .otherwise(F.concat(F.lit("02"), _hex(F.col("text"))))
    )
    parts = F.sort_array(F.collect_list(F.struct("block_index", F.concat(tagged, F.lit("FF")).alias("h"))))
    whole = F.array_join(F.transform(parts, lambda p: p["h"]), "")
    return blocks.groupBy("doc_id").agg(F.substring(F.sha2(F.unhex(whole), 256), 1, 16).alias("content_id"))


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def _bytes_within(text: Column, radius: int, from_end: bool) -> Column:
    """How many characters at one end of a text cover ``radius`` bytes; the character that the bound cuts counts."""
    few = F.right(text, F.lit(radius)) if from_end else F.left(text, F.lit(radius))
    cut = (lambda k: F.right(few, k)) if from_end else (lambda k: F.left(few, k))
    ok = F.filter(F.sequence(F.lit(0), F.length(few)), lambda k: (k == 0) | (F.octet_length(cut(F.greatest(k - 1, F.lit(0)))) < radius))
    return F.when(F.octet_length(few) <= radius, F.length(few)).otherwise(F.array_max(ok))


def sentence_window(text: Column, start: Column, end: Column, radius: int = 160) -> Column:
    """The sentence around a span, at most ``radius`` bytes to each side."""
    before, after = F.left(text, start), F.substr(text, end + 1)
    left, right = F.right(before, _bytes_within(before, radius, True)), F.left(after, _bytes_within(after, radius, False))
    return collapse(F.concat(F.regexp_extract(left, r"[^.!?\n]*\z", 0), F.substr(text, start + 1, end - start), F.regexp_extract(right, r"^[^.!?\n]*[.!?\n]?", 0)))


def block_window(text: Column, start: Column, end: Column, radius: int = 1200) -> Column:
    """The blank-line-delimited paragraph around a span, at most ``radius`` bytes to each side."""
    before, after = F.left(text, start), F.substr(text, end + 1)
    left, right = F.right(before, _bytes_within(before, radius, True)), F.left(after, _bytes_within(after, radius, False))
    return collapse(F.concat(F.substring_index(left, "\n\n", -1), F.substr(text, start + 1, end - start), F.substring_index(right, "\n\n", 1)))


def first_window(text: Column, needle: Column, window=sentence_window) -> Column:
    """A window around a value's first occurrence; empty where it has none."""
    at = F.call_function("position", needle, text)
    return F.when((at > 0) & (needle != ""), window(text, at - 1, at - 1 + F.length(needle))).otherwise(F.lit(""))
