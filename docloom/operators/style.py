"""Style analytics over styled blocks: profiles, role norms, relative features and notes.

A styled block has doc_id, block_index, kind, level, in_table, text, style_name,
alignment, indent_left, indent_hanging, num_id, ilvl, font, size_half_pt, bold,
italic, underline, segments (array of text and style) and style_unresolved.
Aggregates are per document; the deterministic mode takes the smallest of the
most frequent values, with null first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROLE = ["doc_id", "kind", "level"]


def signature() -> Column:
    return F.struct("style_name", "font", "size_half_pt", F.coalesce("bold", F.lit(False)).alias("bold"), F.coalesce("italic", F.lit(False)).alias("italic"), "alignment")


def modes(rows: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """The most frequent value per key, ties to the smallest, in two aggregates that combine before they shuffle."""
    counts = rows.groupBy(*keys, value.alias("_v")).agg(F.count("*").alias("_n"))
    top = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col("_v").alias("v"))).alias("_b"))
    return top.select(*keys, F.col("_b.v").alias(name), (-F.col("_b.n")).alias(f"{name}_count"))


def style_counts(blocks: DataFrame) -> DataFrame:
    """Blocks per paragraph style and their rank: most frequent first, ties by style, null first."""
    counts = blocks.groupBy("doc_id", "style_name").agg(F.count("*").alias("n"))
    w = Window.partitionBy("doc_id").orderBy(F.col("n").desc(), F.col("style_name").asc_nulls_first())
    return counts.withColumn("rank", F.row_number().over(w))


def profile(blocks: DataFrame) -> DataFrame:
    """(doc_id, total_blocks, dominant_font, dominant_size): modes over blocks that have them."""
    total = blocks.groupBy("doc_id").agg(F.count("*").alias("total_blocks"))
    font = modes(blocks.where("font is not null"), ["doc_id"], F.col("font"), "dominant_font").drop("dominant_font_count")
    size = modes(blocks.where("size_half_pt is not null"), ["doc_id"], F.col("size_half_pt"), "dominant_size").drop("dominant_size_count")
    return total.join(font, "doc_id", "left").join(size, "doc_id", "left")


def indent_norms(blocks: DataFrame) -> DataFrame:
    return modes(blocks.where("ilvl is not null"), ["doc_id", "ilvl"], F.coalesce("indent_left", F.lit(0)), "left_norm").drop("left_norm_count")


def role_norms(blocks: DataFrame) -> DataFrame:
    """Per document and role: the modal signature, the number of blocks and where the role first appears."""
    norm = modes(blocks, ROLE, signature(), "norm")
    seen = blocks.groupBy(*ROLE).agg(F.count("*").alias("peers"), F.min("block_index").alias("first_index"))
    same = norm["doc_id"] == seen["doc_id"]
    for k in ROLE[1:]:
        same &= norm[k].eqNullSafe(seen[k])
    return seen.join(norm.drop("norm_count"), same).select(seen["doc_id"], seen["kind"], seen["level"], "peers", "first_index", "norm")


def relative_features(blocks: DataFrame) -> DataFrame:
    """Blocks against their document's profile; null is unknown. Style, font and role of unresolved blocks are unknown."""
    rows = blocks.withColumn("_sig", signature())
    by_style = rows.groupBy("doc_id", "style_name").agg(F.count("*").alias("_style_n"))
    roles = role_norms(blocks).select(F.col("doc_id").alias("_d"), F.col("kind").alias("_k"), F.col("level").alias("_l"), F.col("norm").alias("_norm"))
    levels = indent_norms(blocks)
    joined = rows.join(profile(blocks), "doc_id")
    s = by_style.select(F.col("doc_id").alias("_sd"), F.col("style_name").alias("_sn"), "_style_n")
    joined = joined.join(s, (joined["doc_id"] == s["_sd"]) & joined["style_name"].eqNullSafe(s["_sn"]))
    joined = joined.join(roles, (joined["doc_id"] == roles["_d"]) & (joined["kind"] == roles["_k"]) & joined["level"].eqNullSafe(roles["_l"]))
    joined = joined.join(levels, ["doc_id", "ilvl"], "left")
    known = ~F.col("style_unresolved")
    return joined.select(
        "doc_id", "block_index", (F.col("_style_n") / F.col("total_blocks")).cast("float").alias("style_doc_freq"),
        F.when(known & F.col("font").isNotNull(), F.col("font") == F.col("dominant_font")).alias("font_matches_doc_dominant"),
        F.when(known & F.col("size_half_pt").isNotNull(), F.col("size_half_pt") == F.col("dominant_size")).alias("size_matches_doc_dominant"),
        F.when(known, F.col("_sig").eqNullSafe(F.col("_norm"))).alias("matches_role_peers"),
        F.when(F.col("ilvl").isNotNull(), F.coalesce("indent_left", F.lit(0)) - F.col("left_norm")).cast("float").alias("indent_vs_ilvl_norm"),
    )


def role_label() -> Column:
    return (
        F.when(F.col("kind") == "heading", F.coalesce(F.concat(F.lit("H"), F.col("level").cast("string")), F.lit("headings")))
        .when(F.col("kind") == "paragraph", "body").when(F.col("kind") == "list_item", "list items").otherwise("table cells")
    )


def _others(blocks: DataFrame, column: str) -> DataFrame:
    """Per role and own value: the most frequent value among the *other* blocks of the role, and its count.

    Leaving one block out lowers only its own value's count, so the two best values of a role decide;
    values are few per role, and blocks are never joined with blocks.
    """
    key = ["doc_id", "kind", "_level"]
    rows = blocks.withColumn("_level", F.coalesce("level", F.lit(-1)))
    counts = rows.where(F.col(column).isNotNull()).groupBy(*key, F.col(column).alias("v")).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy(F.col("n").desc(), "v")))
    best = ranked.where("r <= 2").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("r", "n", "v"))).alias("b"))
    own = counts.join(best, key)
    # The rest of the own value against the best other value.
    rest = F.struct((F.lit(1) - F.col("n")).alias("k"), F.col("v").alias("v"))
    other = F.filter("b", lambda x: x["v"] != F.col("v"))
    rival = F.when(F.size(other) > 0, F.struct((-other[0]["n"]).alias("k"), other[0]["v"].alias("v")))
    mine = F.when(F.col("n") > 1, rest)
    common = F.when(mine.isNull(), rival).when(rival.isNull(), mine).otherwise(F.least(mine, rival))
    return own.select(*key, F.col("v").alias(column), common["v"].alias(f"{column}_common"), (-common["k"]).alias(f"{column}_count"))


def points(size: Column) -> Column:
    half = (size / 2).cast("double")
    return F.when(size % 2 == 0, (size / 2).cast("bigint").cast("string")).otherwise(half.cast("string"))


def deviation_notes(blocks: DataFrame) -> DataFrame:
    """Notes on how a block differs from the other blocks of its role; blocks without notes are left out."""
    key = ["doc_id", "kind", "_level"]
    rows = blocks.withColumn("_level", F.coalesce("level", F.lit(-1)))
    peers = rows.groupBy(*key).agg((F.count("*") - 1).alias("_peers"))
    joined = rows.join(peers, key).join(_others(blocks, "font"), [*key, "font"], "left").join(_others(blocks, "size_half_pt"), [*key, "size_half_pt"], "left")
    of = lambda c: F.concat(F.col(f"{c}_count").cast("string"), F.lit(" of "), F.col("_peers").cast("string"), F.lit(" other "), role_label(), F.lit(" use "))
    font = F.when(F.col("font_common") != F.col("font"), F.concat(F.lit("font "), F.col("font"), F.lit(" — "), of("font"), F.col("font_common")))
    size = F.when(F.col("size_half_pt_common") != F.col("size_half_pt"), F.concat(F.lit("size "), points(F.col("size_half_pt")), F.lit("pt — "), of("size_half_pt"), points(F.col("size_half_pt_common")), F.lit("pt")))
    own = "style" in blocks.schema["segments"].dataType.elementType.names
    bold = F.size(F.filter("segments", lambda s: F.coalesce((s["style"] if own else s)["bold"], F.lit(False))))
    mixed = F.when(F.size("segments") >= 2, F.concat(bold.cast("string"), F.lit(" of "), F.size("segments").cast("string"), F.lit(" segments bold")))
    notes = joined.select("doc_id", "block_index", F.array_join(F.array_compact(F.array(font, size, mixed)), "; ").alias("notes"))
    return notes.where("notes <> ''")


def positional_notes(blocks: DataFrame) -> DataFrame:
    """Blocks that interrupt a list, and list levels that jump by more than one."""
    w = Window.partitionBy("doc_id").orderBy("block_index")
    num = F.when(F.col("kind") == "list_item", F.col("num_id"))
    level = F.when(F.col("kind") == "list_item", F.coalesce("ilvl", F.lit(0)))
    rows = blocks.select("doc_id", "block_index", "kind", num.alias("num"), level.alias("lvl"))
    for name in ("num", "lvl"):
        rows = rows.withColumn(f"prev_{name}", F.lag(name).over(w))
    rows = rows.withColumn("next_num", F.lead("num").over(w))
    lead = F.when(F.col("kind") == "heading", "heading inside").otherwise("paragraph interrupts")
    inside = F.when(F.col("kind").isin("paragraph", "heading") & (F.col("prev_num") == F.col("next_num")), F.concat(lead, F.lit(" list "), F.col("prev_num").cast("string"), F.lit(" (between two list items)")))
    jump = F.when(F.col("prev_num").eqNullSafe(F.col("num")) & (F.col("lvl") > F.col("prev_lvl") + 1), F.concat(F.lit("list level jumps "), F.col("prev_lvl").cast("string"), F.lit("→"), F.col("lvl").cast("string")))
    return rows.select("doc_id", "block_index", F.array_join(F.array_compact(F.array(inside, jump)), "; ").alias("notes")).where("notes <> ''")


def neighbour_context(blocks: DataFrame) -> DataFrame:
    """The trimmed text, kind and (for list items) numbering of the blocks before and after."""
    w = Window.partitionBy("doc_id").orderBy("block_index")
    rows = blocks.select("doc_id", "block_index", F.trim(F.regexp_replace("text", r"^\s+|\s+$", "")).alias("t"), "kind", F.when(F.col("kind") == "list_item", F.struct("num_id", "ilvl")).alias("numbering"))
    out = rows.select("doc_id", "block_index", *[f(c).over(w).alias(f"{p}_{n}") for p, f in (("prev", F.lag), ("next", F.lead)) for c, n in (("t", "text"), ("kind", "kind"), ("numbering", "numbering"))])
    return out.withColumn("prev_text", F.coalesce("prev_text", F.lit(""))).withColumn("next_text", F.coalesce("next_text", F.lit("")))


def segments(runs: DataFrame) -> DataFrame:
    """Runs of a block, in order, joined where their style is equal; blank runs join the one before, empty ones go.

    runs: doc_id, block_index, run_index, text, style (a struct). Islands of equal style by a running count of changes.
    """
    some = runs.where("text <> ''")
    w = Window.partitionBy("doc_id", "block_index").orderBy("run_index")
    blank = F.trim(F.regexp_replace("text", r"\s", "")) == ""
    rows = some.withColumn("_s", F.when(~blank, F.col("style"))).withColumn("_last", F.last("_s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    first = F.row_number().over(w) == 1
    new = F.when(first, 1).when(blank, 0).when(F.col("_last").isNull() | ~F.col("_last").eqNullSafe(F.col("style")), 1).otherwise(0)
    rows = rows.withColumn("_new", new).withColumn("segment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run_index", "text"))), lambda r: r["text"]), "")
    return rows.groupBy("doc_id", "block_index", "segment").agg(joined.alias("text"), F.min_by("style", "run_index").alias("style"))


def dominant_segment(blocks: DataFrame) -> DataFrame:
    """The longest segment of a block, the first of equals, and whether the block is mixed."""
    indexed = F.transform("segments", lambda s, i: F.struct(F.length(s["text"]).alias("n"), (-i).alias("i"), s.alias("s")))
    return blocks.select("doc_id", "block_index", F.array_max(indexed)["s"]["text"].alias("dominant"), (F.size("segments") >= 2).alias("mixed"))


def role(heading_level: Column, num_id: Column, in_table: Column) -> Column:
    """heading, then list item, then table cell, else paragraph."""
    return F.when(heading_level.isNotNull(), "heading").when(num_id.isNotNull(), "list_item").when(in_table, "table_cell").otherwise("paragraph")


def heading_level(style_id: Column) -> Column:
    """title is 1; heading and then, spaces aside, the digits that follow at once: their number, from 1 to 6, and 1 without digits; others, and numbers over 255, are null."""
    low = F.lower(style_id)
    digits = F.regexp_extract(low, r"(?U)^heading\s*([0-9]*)", 1)
    n = F.when(digits == "", 1).when(F.length(F.ltrim(digits, F.lit("0"))) < 4, digits.try_cast("bigint"))
    return F.when(low == "title", 1).when(low.startswith("heading") & (n <= 255), F.least(F.greatest(n, F.lit(1)), F.lit(6))).cast("tinyint")


def inches(twips: Column) -> Column:
    """Twips as inches with at most two decimals. Halves that are exact in binary go to the even digit, others up."""
    value = twips / 1440.0
    s = F.format_string("%.2f", F.when(twips % 180 == 0, F.bround(value, 2)).otherwise(value))
    return F.when(twips.isNotNull(), F.concat(F.regexp_replace(F.regexp_replace(s, r"0+$", ""), r"\.$", ""), F.lit('"')))


def preview(text: Column, most: int = 100) -> Column:
    """The text on one line, cut off after ``most`` characters."""
    line = F.array_join(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""), " ")
    return F.when(F.length(line) > most, F.concat(F.left(line, F.lit(most)), F.lit("…"))).otherwise(line)


def _joined(separator: str, *parts: Column) -> Column:
    """What is there of the parts, or null."""
    some = F.array_compact(F.array(*parts))
    return F.when(F.size(some) > 0, F.array_join(some, separator))


def _optional(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def run_summary(run: Column, fields: list[str]) -> Column:
    """A run's effective styling in short; ``fields`` are those that the struct has."""
    has = lambda n: run[n] if n in fields else F.lit(None)
    flag = lambda n: F.when(has(n).cast("boolean"), n)
    spacing = has("char_spacing").cast("int")
    return F.coalesce(
        _joined(
            ", ", has("font").cast("string"), F.concat(points(has("size_half_pt").cast("int")), F.lit("pt")), flag("bold"), flag("italic"), F.when(has("underline").isNotNull(), "underline"),
            flag("strike"), flag("caps"), F.when(spacing != 0, F.concat(F.lit("spacing "), F.when(spacing > 0, "+").otherwise(""), spacing.cast("string"))),
        ),
        F.lit("(inherited)"),
    )


def review_lines(blocks: DataFrame) -> DataFrame:
    """What a reviewer sees of each block: a preview, the line of its list or indent, and the lines of its style.

    A block in a list has a marker (a bullet, or the number format and its template), its level and indent;
    another block its indent alone. A block of two or more segments has a line for each, another one line with
    the paragraph style and the run's styling. Columns that blocks lack count as null.
    """
    opt = lambda n, k: _optional(blocks, n, k)
    inch = lambda label, n: F.concat(F.lit(f"{label} "), inches(opt(n, "int")))
    indent = _joined(", ", inch("left", "indent_left"), inch("hanging", "indent_hanging"), inch("first-line", "indent_first_line"), inch("right", "indent_right"))
    kind, template = opt("number_kind", "string"), opt("level_text", "string")
    marker = F.when(F.lower(kind) == "bullet", "bullet").when(kind.isNotNull(), F.concat(kind, F.lit(' ("'), F.coalesce(template, F.lit("")), F.lit('")'))).otherwise("(format unresolved)")
    listed = opt("num_id", "bigint").isNotNull() | F.coalesce(opt("numbering_unresolved", "boolean"), F.lit(False))
    in_list = F.concat(F.lit("   list: "), _joined(" · ", marker, F.concat(F.lit("level "), opt("ilvl", "bigint").cast("string")), F.concat(F.lit("indent "), indent)))
    place = F.when(listed, in_list).otherwise(F.concat(F.lit("   indent: "), indent))
    element = blocks.schema["segments"].dataType.elementType
    own = "style" in element.names
    fields = element["style"].dataType.names if own else element.names
    summary = lambda s: run_summary(s["style"] if own else s, fields)
    each = F.concat(F.lit("   segments:\n"), F.array_join(F.transform("segments", lambda s: F.concat(F.lit('     • "'), preview(s["text"]), F.lit('" — '), summary(s))), "\n"))
    named = F.coalesce(F.concat(opt("style_name", "string"), F.lit(" → ")), F.lit(""))
    single = F.concat(F.lit("   style: "), named, F.when(F.size("segments") > 0, summary(F.get(F.col("segments"), 0))).otherwise("(inherited)"))
    unknown = F.coalesce(opt("style_unresolved", "boolean"), F.lit(False))
    style = F.when(unknown, "   style: unknown (could not resolve the style)").when(F.size("segments") >= 2, each).otherwise(single)
    return blocks.select("doc_id", "block_index", preview(F.col("text")).alias("preview"), _joined("\n", place, style).alias("lines"))


def resolve_chain(styles: DataFrame) -> DataFrame:
    """(doc_id, style_id, ancestor, distance) over ``based_on``; a cycle ends where it closes, as does a missing style.

    styles: doc_id, style_id, based_on. A document's style sheet, some hundred entries, becomes one map, in
    which each style walks up; so any depth takes a single exchange.
    """
    sheets = styles.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("style_id", "based_on"))).alias("sheet"))
    rows = sheets.select("doc_id", "sheet", F.explode(F.map_keys("sheet")).alias("style_id"))
    up = "sheet[element_at(a, -1)]"
    walk = F.expr(f"aggregate(sequence(1, size(sheet)), array(style_id), (a, i) -> if({up} is null or array_contains(a, {up}) or not map_contains_key(sheet, {up}), a, concat(a, array({up}))))")
    return rows.select("doc_id", "style_id", F.posexplode(walk).alias("distance", "ancestor"))


def fold_properties(chain: DataFrame, properties: DataFrame, names: list[str]) -> DataFrame:
    """Each style's effective properties: the nearest ancestor's value of each."""
    joined = chain.join(properties.withColumnRenamed("style_id", "ancestor"), ["doc_id", "ancestor"])
    return joined.groupBy("doc_id", "style_id").agg(*[F.min_by(F.when(F.col(n).isNotNull(), F.col(n)), F.when(F.col(n).isNotNull(), F.col("distance"))).alias(n) for n in names])


def numbering(blocks: DataFrame, nums: DataFrame, levels: DataFrame) -> DataFrame:
    """Blocks with the format of their list level, over num_id -> abstract_id -> (abstract_id, ilvl); unresolved if missing."""
    joined = blocks.join(nums.select("doc_id", "num_id", "abstract_id"), ["doc_id", "num_id"], "left")
    lv = levels.select("doc_id", "abstract_id", F.col("ilvl").alias("_ilvl"), "number_kind", "level_text")
    same = [joined["doc_id"] == lv["doc_id"], joined["abstract_id"] == lv["abstract_id"], F.coalesce(joined["ilvl"], F.lit(0)) == lv["_ilvl"]]
    out = joined.join(lv, same, "left").drop(lv["doc_id"]).drop(lv["abstract_id"]).drop("_ilvl", "abstract_id")
    return out.withColumn("numbering_unresolved", F.col("num_id").isNotNull() & F.col("number_kind").isNull())


def pages(blocks: DataFrame) -> DataFrame:
    """Blocks with ``page``: one more for each break before a block, and for each break after an earlier block."""
    w = Window.partitionBy("doc_id").orderBy("block_index")
    before = F.sum(F.col("break_before").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.coalesce(F.sum("breaks_after").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return blocks.withColumn("page", (1 + before + after).cast("int"))
