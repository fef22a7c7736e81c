"""Sections, snippet files and Markdown rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators import censor
from docloom.operators.fields import collapse
from docloom.session import settle

SLUG, DISPLAY, HEAD = 50, 60, 256
KIND_LABELS = {"paired": "paired", "paired_long": "paired (long)", "paired_cross_paragraph": "paired (cross-paragraph)", "lone_open": "lone [", "lone_close": "lone ]"}


def with_section(blocks: DataFrame) -> DataFrame:
    """Blocks with ``section``: a heading's block index up to the next heading; blocks before the first stand alone."""
    w = Window.partitionBy("doc_id").orderBy("block_index").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.max(F.when(F.col("kind") == "heading", F.col("block_index"))).over(w)
    return blocks.withColumn("section", F.coalesce(heading, "block_index"))


def sections(blocks: DataFrame, hits: DataFrame) -> DataFrame:
    """One row per section: its heading, blocks and hits. A hit across blocks belongs to the block it starts in."""
    by_block = hits.groupBy("doc_id", "block_index").agg(F.count("*").alias("n"))
    rows = with_section(blocks).join(by_block, ["doc_id", "block_index"], "left")
    first = F.col("block_index") == F.col("section")
    return rows.groupBy("doc_id", "section").agg(
        F.max(F.when(first & (F.col("kind") == "heading"), F.col("level"))).alias("level"),
        F.max(F.when(first & (F.col("kind") == "heading"), F.col("text"))).alias("heading"),
        F.count("*").alias("n_blocks"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_hits"),
    )


def slug(text: Column) -> Column:
    """ASCII letters and digits in lower case joined by dashes, at most 50 characters; "span" if none."""
    dashed = F.regexp_replace(F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", "-")), "^-|-$", "")
    cut = F.regexp_replace(F.left(dashed, F.lit(SLUG)), "-$", "")
    return F.when(cut == "", "span").otherwise(cut)


def ranges(hits: DataFrame) -> DataFrame:
    """One row per distinct (block, end block) of a document, numbered S1, S2, ... in order of hits."""
    order = F.struct("block_index", "start", "cell_row", "cell_col", "kind")
    found = hits.groupBy("doc_id", "block_index", "end_block").agg(
        F.min(order).alias("_at"), F.max(F.when(F.col("status") == "guessed", 1).otherwise(0)).alias("_g"), F.min_by("kind", order).alias("_k")
    )
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("_at", "end_block"))
    return found.select("doc_id", "block_index", "end_block", n.alias("n"), F.concat(F.lit("S"), n).alias("id"), (F.col("_g") == 1).alias("needs_review"), (F.col("_k") == "paired_cross_paragraph").alias("is_cross"))


def slices(fields: DataFrame, hits: DataFrame, names: list[str] | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """The fields of each range, censored as if the range were a document: its placeholders count from 001.

    (doc_id, id, first_block, last_block) and the columns of fields. Only fields in a range are searched, each
    once however many ranges cover it, and settled with their spans and ranges. Spans, without texts, are
    numbered per range by windows; the names then come back to their fields, whose texts move once.
    """
    each = ranges(hits).select("doc_id", F.struct("id", F.col("block_index").alias("first_block"), F.col("end_block").alias("last_block")).alias("_range"))
    covered = each.withColumn("block_index", F.explode(F.sequence("_range.first_block", "_range.last_block")))
    covered = covered.groupBy("doc_id", "block_index").agg(F.collect_list("_range").alias("_ranges"))
    found = settle(censor.detect(fields.join(covered, ["doc_id", "block_index"]), names, allowed).withColumn("_row", F.monotonically_increasing_id()))
    spans = found.where("size(spans) > 0").select("_row", "doc_id", "block_index", "cell_row", "cell_col", "_ranges", F.explode("spans").alias("s"))
    spans = spans.select("_row", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.value").alias("value"), F.col("s.value_type").alias("value_type"), censor.position(True, F.col("s.start")).alias("at"), "doc_id", "_ranges")
    spans = spans.withColumn("_range", F.explode("_ranges")).drop("_ranges").repartition("doc_id", "_range.id")
    put = censor.numbered(spans.withColumn("_id", F.col("_range.id")), ["doc_id", "_id"])
    put = put.groupBy("_row", "_range").agg(F.sort_array(F.collect_list(F.struct("start", "end", "placeholder"))).alias("p"))
    names_of = put.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("_range", "p"))).alias("_put"))
    columns = [c for c in fields.columns if c != "doc_id"]
    rows = found.join(names_of, "_row", "left").withColumn("_range", F.explode("_ranges"))
    rows = rows.withColumn("_p", F.coalesce(F.expr("_put[_range]"), F.expr("cast(array() as array<struct<start:int,end:int,placeholder:string>>)")))
    text = F.expr(censor.substitute_sql("_p"))
    return rows.select("doc_id", "_range.*", *[text.alias(c) if c == "text" else F.col(c) for c in columns])


def with_previews(hits: DataFrame, slices: DataFrame) -> DataFrame:
    """Hits whose ``span_text`` is censored where they cross paragraphs: from the first [ of the first block to the
    last ] of the last, paragraphs between whole, one line; headings and tables are passed over."""
    first, last = F.col("block_index") == F.col("first_block"), F.col("block_index") == F.col("last_block")
    opened = F.instr("text", "[")
    closed = F.instr(F.reverse("text"), "]")
    part = F.when(first, F.substr("text", F.greatest(opened, F.lit(1)))).when(last & (closed > 0), F.left("text", F.length("text") - closed + 1)).otherwise(F.col("text"))
    rows = slices.where("kind = 'paragraph' and last_block > first_block").select("doc_id", "first_block", "last_block", F.struct("block_index", part.alias("t")).alias("p"))
    line = F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["t"]), " ")
    lines = rows.groupBy("doc_id", F.col("first_block").alias("block_index"), F.col("last_block").alias("end_block")).agg(line.alias("_line"))
    shown = F.when(F.col("kind") == "paired_cross_paragraph", F.coalesce("_line", F.lit(""))).otherwise(F.col("span_text"))
    joined = hits.join(lines, ["doc_id", "block_index", "end_block"], "left")
    return joined.select(*[shown.alias(c) if c == "span_text" else c for c in hits.columns])


def snippet_index(hits: DataFrame, blocks: DataFrame, slices: DataFrame | None = None) -> DataFrame:
    """Snippet files of a document: id, range, whether to review, and a path with a unique slug per folder.

    A slug is made of the range's first text, censored where ``slices`` are given, so that no path tells a value.
    A slug that is taken gets the first free of -2, -3, ... in order of ranges. Most slugs are no other
    slug with a number, and then their count is their number, by a window. Only where a slug stands beside
    one that it could be a suffixed form of (pay and pay-2) does the order of the whole family count.
    """
    found = ranges(hits)
    # A range's text is that of its first block that is no table: within one block the block itself.
    if slices is None:
        flow = F.when(F.col("kind") != "table", F.struct(F.col("block_index").alias("at"), slug(F.coalesce("text", F.lit(""))).alias("slug")))
        onwards = Window.partitionBy("doc_id").orderBy(F.desc("block_index")).rowsBetween(Window.unboundedPreceding, 0)
        opening = blocks.select("doc_id", "block_index", flow.alias("o")).select("doc_id", "block_index", F.last("o", ignorenulls=True).over(onwards).alias("o"))
        opening = opening.groupBy("doc_id", "block_index").agg(F.min("o").alias("o"))
        texts = found.join(opening, ["doc_id", "block_index"], "left").withColumn("slug", F.when(F.col("o.at") <= F.col("end_block"), F.col("o.slug"))).drop("o")
    else:
        opening = slices.where("kind <> 'table_cell'").select("doc_id", "id", "block_index", slug(F.coalesce("text", F.lit(""))).alias("slug"))
        texts = found.join(opening.groupBy("doc_id", "id").agg(F.min_by("slug", "block_index").alias("slug")), ["doc_id", "id"], "left")
    named = texts.withColumn("slug", F.coalesce("slug", F.lit("span"))).withColumn("family", F.regexp_replace("slug", "(?:-[0-9]+)+$", ""))
    folder = ["doc_id", "is_cross"]
    mixed = (F.min("slug").over(Window.partitionBy(*folder, "family")) != F.max("slug").over(Window.partitionBy(*folder, "family"))).alias("mixed")
    rows = settle(named.select("*", mixed))
    k = F.row_number().over(Window.partitionBy(*folder, "slug").orderBy("n"))
    plain = rows.where("not mixed").withColumn("name", F.when(k == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), k)))
    # A family in order: the names taken so far, and for each slug the last number it was given.
    order = F.sort_array(F.collect_list(F.struct("n", "slug", "block_index", "end_block", "id", "needs_review")))
    last = "coalesce(a.last[r.slug], 0)"
    free = f"element_at(filter(sequence({last} + 1, {last} + size(a.taken) + 1), k -> not map_contains_key(a.taken, if(k = 1, r.slug, concat(r.slug, '-', k)))), 1)"
    name = "if(k = 1, r.slug, concat(r.slug, '-', k))"
    step = (
        f"transform(array({free}), k -> named_struct('taken', map_concat(a.taken, map({name}, true)), "
        f"'last', map_concat(map_filter(a.last, (x, y) -> x <> r.slug), map(r.slug, k)), "
        f"'out', concat(a.out, array(named_struct('name', {name}, 'r', r)))))[0]"
    )
    item = "struct<n:int,slug:string,block_index:int,end_block:int,id:string,needs_review:boolean>"
    zero = f"named_struct('taken', cast(map() as map<string,boolean>), 'last', cast(map() as map<string,int>), 'out', cast(array() as array<struct<name:string,r:{item}>>))"
    families = rows.where("mixed").groupBy(*folder, "family").agg(order.alias("_r"))
    named_families = families.select(*folder, F.explode(F.expr(f"aggregate(_r, {zero}, (a, r) -> {step}, a -> a.out)")).alias("x")).select(*folder, "x.name", "x.r.*")
    columns = [*folder, "name", "block_index", "end_block", "id", "needs_review"]
    every = plain.select(*columns).unionByName(named_families.select(*columns))
    path = F.concat(F.when(F.col("is_cross"), "snippets/cross-paragraph/").otherwise("snippets/"), F.col("name"), F.lit(".md"))
    return every.select("doc_id", "id", "block_index", "end_block", "needs_review", path.alias("path"))


def escape_cell(c: Column) -> Column:
    return F.replace(collapse(c), F.lit("|"), F.lit("\\|"))


def display_cell(c: Column) -> Column:
    """A span for a table cell: one line, at most 60 characters, in an inline code mark. What a long span's first part fills needs no more of it."""
    head = collapse(F.left(c, F.lit(HEAD)))
    plain = F.replace(F.when(F.length(head) > DISPLAY, head).otherwise(collapse(c)), F.lit("`"), F.lit("'"))
    short = F.when(F.length(plain) > DISPLAY, F.concat(F.left(plain, F.lit(DISPLAY)), F.lit("…"))).otherwise(plain)
    return F.concat(F.lit("`"), F.replace(short, F.lit("|"), F.lit("\\|")), F.lit("`"))


def table_markdown(rows: Column) -> Column:
    """A grid with the first row as header; ragged rows are filled up. Empty tables are empty."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.coalesce(escape_cell(F.get(r, i)), F.lit(""))), " | "), F.lit(" |\n"))
    lines = F.transform(rows, line)
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), width), F.lit("\n"))
    grid = F.concat(F.get(lines, 0), rule, F.array_join(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), ""), F.lit("\n"))
    return F.when(F.coalesce(width, F.lit(0)) > 0, grid).otherwise(F.lit(""))


def block_markdown() -> Column:
    heading = F.concat(F.repeat(F.lit("#"), F.least(F.greatest(F.col("level").cast("int"), F.lit(1)), F.lit(6))), F.lit(" "), F.col("text"), F.lit("\n\n"))
    return F.when(F.col("kind") == "heading", heading).when(F.col("kind") == "table", table_markdown(F.col("rows"))).otherwise(F.concat("text", F.lit("\n\n")))


def block_label(start: str = "block_index", end: str = "end_block") -> Column:
    return F.when(F.col(start) == F.col(end), F.col(start).cast("string")).otherwise(F.concat(F.col(start).cast("string"), F.lit("–"), F.col(end).cast("string")))


def render(blocks: DataFrame, hits: DataFrame, snippets: DataFrame) -> DataFrame:
    """One Markdown inventory per document: a snippet index, then each section with hits and the table of its variables."""
    label = F.create_map(*[F.lit(x) for kv in KIND_LABELS.items() for x in kv])
    link = F.concat(F.lit("["), F.col("path"), F.lit("]("), F.col("path"), F.lit(")"))
    file = F.coalesce(link, F.lit(""))
    cells = hits.withColumn("cell", display_cell(F.col("span_text"))).drop("span_text")
    joined = cells.join(snippets, ["doc_id", "block_index", "end_block"], "left")
    status = F.when(F.col("status") == "guessed", "⚠ GUESSED").otherwise("confident")
    row = F.concat(F.lit("| "), F.coalesce("id", F.lit("")), F.lit(" | "), "cell", F.lit(" | "), label[F.col("kind")], F.lit(" | "), status, F.lit(" | "), file, F.lit(" |\n"))
    lines = joined.select("doc_id", "block_index", F.struct("block_index", "start", "cell_row", "cell_col", "kind").alias("at"), row.alias("row"))
    sectioned = with_section(blocks)
    by_section = lines.join(sectioned.select("doc_id", "block_index", "section"), ["doc_id", "block_index"]).groupBy("doc_id", "section").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "row"))), lambda r: r["row"]), "").alias("inventory"))
    body = sectioned.join(by_section.select("doc_id", "section"), ["doc_id", "section"], "left_semi").groupBy("doc_id", "section").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_index", block_markdown().alias("m")))), lambda r: r["m"]), "").alias("body"))
    head = "**Variables in this section:**\n\n| ID | Snippet | Kind | Status | File |\n|----|---------|------|--------|------|\n"
    entries = body.join(by_section, ["doc_id", "section"]).select("doc_id", F.struct("section", F.concat("body", F.lit(head), "inventory", F.lit("\n")).alias("m")).alias("e"))
    entries = entries.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("e")), lambda e: e["m"]), "").alias("entries"))
    review = F.when(F.col("needs_review"), "⚠").otherwise("")
    index_row = F.concat(F.lit("| "), F.col("id"), F.lit(" | "), block_label(), F.lit(" | "), review, F.lit(" | "), link, F.lit(" |\n"))
    index = snippets.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.substr("id", F.lit(2)).cast("int").alias("n"), index_row.alias("r")))), lambda r: r["r"]), "").alias("index"))
    index = index.withColumn("index", F.concat(F.lit("## Snippet index\n\n| ID | Block(s) | Review | File |\n|----|----------|--------|------|\n"), "index", F.lit("\n")))
    docs = blocks.select("doc_id").distinct().join(index, "doc_id", "left").join(entries, "doc_id", "left")
    return docs.select("doc_id", F.concat(F.lit("# Detected variables\n\n"), F.coalesce("index", F.lit("")), F.coalesce("entries", F.lit("_No bracketed variables detected._\n"))).alias("markdown"))


def snippet_documents(slices: DataFrame, snippets: DataFrame, main_name: str) -> DataFrame:
    """The Markdown of each snippet file, from the censored fields of its range; tables are left out."""
    rows = slices.where("kind <> 'table_cell'")
    heading = F.concat(F.repeat(F.lit("#"), F.least(F.greatest(F.col("heading_level").cast("int"), F.lit(1)), F.lit(6))), F.lit(" "), F.col("text"), F.lit("\n\n"))
    part = F.when(F.col("kind") == "heading", heading).otherwise(F.concat("text", F.lit("\n\n")))
    body = rows.groupBy("doc_id", "id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_index", part.alias("m")))), lambda r: r["m"]), "").alias("body"))
    joined = snippets.join(body, ["doc_id", "id"], "left")
    cross = F.col("path").contains("cross-paragraph/")
    back = F.when(cross, f"../../{main_name}").otherwise(f"../{main_name}")
    plain = F.concat(F.lit("# "), "id", F.lit(" — snippet, block "), block_label(), F.lit("\n\n> Back to inventory: [`"), back, F.lit("`]("), back, F.lit(")\n\n---\n\n"))
    wide = F.concat(F.lit("# "), "id", F.lit(" — cross-paragraph span, blocks "), block_label(), F.lit(" (⚠ review)\n\n> Back to inventory: [`"), back, F.lit("`]("), back, F.lit(") · kind: paired (cross-paragraph) · status: ⚠ GUESSED\n\nThis span crosses paragraphs; confirm that it is one variable.\n\n---\n\n"))
    return joined.select("doc_id", "id", "path", F.concat(F.when(cross, wide).otherwise(plain), F.coalesce("body", F.lit(""))).alias("markdown"))
