"""Queries of style analytics, review decisions and models, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import features
from docloom.functions.spans import VALUE_TYPES
from docloom.operators import model, records, review, style
from docloom.plans import fixtures as X



def style_counts(spark, sf_dir):
    return style.style_counts(X.styled(spark, sf_dir))


def style_profile(spark, sf_dir):
    return style.profile(X.styled(spark, sf_dir))


def indent_norms(spark, sf_dir):
    return style.indent_norms(X.styled(spark, sf_dir))


def role_norms(spark, sf_dir):
    r = style.role_norms(X.styled(spark, sf_dir))
    return r.select("doc_id", "kind", "level", "peers", "first_index", *[F.col(f"norm.{c}").alias(c) for c in ("style_name", "font", "size_half_pt", "bold", "italic", "alignment")])


def relative_features(spark, sf_dir):
    r = style.relative_features(X.styled(spark, sf_dir))
    return r.withColumn("style_doc_freq", F.round(F.col("style_doc_freq").cast("double"), 5)).withColumn("indent_vs_ilvl_norm", F.col("indent_vs_ilvl_norm").cast("double"))


def deviation_notes(spark, sf_dir):
    return style.deviation_notes(X.styled(spark, sf_dir))


def positional_notes(spark, sf_dir):
    return style.positional_notes(X.styled(spark, sf_dir))


def neighbour_context(spark, sf_dir):
    n = style.neighbour_context(X.styled(spark, sf_dir))
    return n.select("doc_id", "block_index", "prev_text", "next_text", "prev_kind", "next_kind", F.col("prev_numbering.num_id").alias("prev_num"), F.col("next_numbering.ilvl").alias("next_ilvl"))


def dominant_segments(spark, sf_dir):
    return style.dominant_segment(X.styled(spark, sf_dir))


def run_segments(spark, sf_dir):
    runs = X.styled(spark, sf_dir).select("doc_id", F.lit(0).alias("block_index"), F.col("block_index").alias("run_index"), F.when(F.col("block_index") % 6 == 0, " ").when(F.col("block_index") % 15 == 0, "").otherwise(F.concat(F.lit("r"), "block_index")).alias("text"), F.struct((F.col("block_index") % 4 == 0).alias("bold")).alias("style"))
    return style.segments(runs).select("doc_id", "segment", "text", F.col("style.bold").alias("bold"))


def style_chains(spark, sf_dir):
    """Styles named by orders, each based on the order before it of its customer, but for every third."""
    o = X.from_orders(spark, sf_dir, X.STYLED)
    from pyspark.sql import Window

    prior = F.lag("block_index").over(Window.partitionBy("doc_id").orderBy("block_index"))
    styles = o.select("doc_id", F.col("block_index").alias("style_id"), F.when(F.col("block_index") % 3 != 0, prior).alias("based_on"))
    chain = style.resolve_chain(styles)
    props = o.select("doc_id", F.col("block_index").alias("style_id"), "font", "indent_left")
    return style.fold_properties(chain, props, ["font", "indent_left"])


def heading_levels(spark, sf_dir):
    ids = X.from_orders(spark, sf_dir, X.STYLED).select("doc_id", "block_index", F.when(F.col("block_index") % 4 == 0, "Title").when(F.col("block_index") % 4 == 1, "heading").otherwise(F.concat(F.lit("Heading"), F.col("block_index") % 300)).alias("style_id"))
    return ids.select("doc_id", "block_index", "style_id", style.heading_level(F.col("style_id")).cast("int").alias("level"))


#: What review_lines() reads beyond the styled blocks, in SQL that both engines read alike.
REVIEW = f"""
SELECT *, CASE WHEN block_index % 14 = 0 THEN 360 END AS indent_hanging, CASE WHEN block_index % 16 = 0 THEN -180 END AS indent_first_line, CASE WHEN block_index % 22 = 0 THEN 1000 END AS indent_right,
  CASE WHEN ilvl IS NULL THEN NULL WHEN num_id = 1 THEN 'bullet' ELSE 'decimal' END AS number_kind, CASE WHEN ilvl IS NOT NULL THEN '%1.' END AS level_text,
  CASE WHEN block_index % 19 = 0 THEN 'single' END AS underline, block_index % 21 = 0 AS strike, block_index % 23 = 0 AS caps, CASE WHEN block_index % 25 < 2 THEN CAST(block_index % 25 * 20 - 10 AS INT) END AS char_spacing
FROM ({X.STYLED})"""


def style_review_lines(spark, sf_dir):
    b = X.from_orders(spark, sf_dir, REVIEW)
    names = ("font", "size_half_pt", "bold", "italic", "underline", "strike", "caps", "char_spacing")
    own = F.struct(*names)
    plain = F.struct(*[F.lit(None).cast(b.schema[n].dataType).alias(n) for n in names])
    one, two = F.struct("text", own.alias("style")), F.struct(F.lit("b\n c").alias("text"), plain.alias("style"))
    b = b.withColumn("segments", F.when(F.col("is_mixed"), F.array(one, two)).when(F.col("block_index") % 27 == 0, F.slice(F.array(one), 1, 0)).otherwise(F.array(one)))
    return style.review_lines(b)


def heading_forms(spark, sf_dir):
    """Style ids with text after the number, without a number, with spaces, and of other styles."""
    n = lambda m: (F.col("block_index") % m).cast("string")
    forms = (F.lit("TITLE"), F.concat(F.lit("Heading"), n(9), F.lit("Char")), F.lit("HeadingFoo"), F.concat(F.lit("heading  "), n(9)), F.lit("Subtitle"), F.concat(F.lit("Heading"), n(400)), F.lit("My heading 2"))
    ids = X.from_orders(spark, sf_dir, X.STYLED).select("doc_id", "block_index", F.get(F.array(*forms), F.col("block_index") % 7).alias("style_id"))
    return ids.select("doc_id", "block_index", "style_id", style.heading_level(F.col("style_id")).cast("int").alias("level"))


def review_sql() -> str:
    """review_lines() over the same blocks, written from its rules."""
    inch = lambda label, c: f"'{label} ' || CASE WHEN {c} % 1440 = 0 THEN CAST({c} // 1440 AS VARCHAR) ELSE rtrim(printf('%.2f', {c} / 1440.0), '0') END || chr(34)"
    indent = f"nullif(concat_ws(', ', {inch('left', 'indent_left')}, {inch('hanging', 'indent_hanging')}, {inch('first-line', 'indent_first_line')}, {inch('right', 'indent_right')}), '')"
    size = "CASE WHEN size_half_pt % 2 = 0 THEN CAST(size_half_pt // 2 AS VARCHAR) ELSE (size_half_pt // 2) || '.5' END || 'pt'"
    summary = f"""coalesce(nullif(concat_ws(', ', font, {size}, CASE WHEN bold THEN 'bold' END, CASE WHEN italic THEN 'italic' END, CASE WHEN underline IS NOT NULL THEN 'underline' END, CASE WHEN strike THEN 'strike' END,
      CASE WHEN caps THEN 'caps' END, CASE WHEN char_spacing <> 0 THEN 'spacing ' || printf('%+d', char_spacing) END), ''), '(inherited)')"""
    return f"""
    WITH b AS (SELECT *, {indent} AS indent, {summary} AS own FROM ({REVIEW})),
    l AS (SELECT *, CASE WHEN num_id IS NOT NULL THEN '   list: ' || concat_ws(' · ', CASE number_kind WHEN 'bullet' THEN 'bullet' WHEN 'decimal' THEN 'decimal ("%1.")' ELSE '(format unresolved)' END, 'level ' || ilvl, 'indent ' || indent)
        ELSE '   indent: ' || indent END AS place,
      CASE WHEN style_unresolved THEN '   style: unknown (could not resolve the style)'
        WHEN is_mixed THEN '   segments:' || chr(10) || '     • "' || trim(text) || '" — ' || own || chr(10) || '     • "b c" — (inherited)'
        ELSE '   style: ' || coalesce(style_name || ' → ', '') || CASE WHEN block_index % 27 = 0 THEN '(inherited)' ELSE own END END AS style FROM b)
    SELECT doc_id, block_index, trim(text) AS preview, concat_ws(chr(10), place, style) AS lines FROM l"""


def learned_store(spark, sf_dir):
    return review.tally(X.log(spark, sf_dir).where("reviewed"))


def allowed_values(spark, sf_dir):
    return review.allowed_values(review.tally(X.log(spark, sf_dir)))


def rejected_minus_confirmed(spark, sf_dir):
    return review.rejected_values(X.log(spark, sf_dir))


def effective_allowed(spark, sf_dir):
    log = X.log(spark, sf_dir)
    return review.effective_allowed(review.allowed_values(review.tally(log)), review.rejected_values(log))


def review_counts(spark, sf_dir):
    return review.review_counts(X.log(spark, sf_dir))


def default_decisions(spark, sf_dir):
    log = X.log(spark, sf_dir)
    items = log.groupBy("doc_id", "value").agg(F.min("detected_type").alias("detected_type"))
    labels = log.where("reviewed").groupBy("doc_id", "value").agg(F.max("verdict").alias("verdict")).withColumn("final_type", F.lit(None).cast("string"))
    return review.group_decisions(items, labels)


def page_scope(spark, sf_dir):
    log = X.log(spark, sf_dir).withColumn("block_index", (F.col("seq") % 12).cast("int"))
    occurrence = F.struct("block_index", F.lit(0).alias("start"), F.lit(1).alias("end"))
    items = log.groupBy("doc_id", "value").agg(F.collect_list(occurrence).alias("occurrences"))
    pages = log.select("doc_id", "block_index", F.floor(F.col("block_index") / 3).cast("int").alias("page")).distinct()
    return review.scope_items(items, pages, [(1, 1), (3, 9)]).select("doc_id", "value", "in_scope")


def decision_records(spark, sf_dir):
    log = X.log(spark, sf_dir).withColumn("final_type", F.col("detected_type"))
    return review.decision_records(log, 1700000000).select("seq", "value", "verdict", "final_type", "schema", "timestamp")


VERDICTS = f"""
SELECT doc_id, block_index, CASE WHEN block_index % 4 = 1 THEN 'weird' ELSE 'fine' END AS verdict, CASE WHEN block_index % 8 < 4 THEN 'other' ELSE 'bad-indent-level' END AS category, concat('n', block_index) AS note
FROM ({X.STYLED}) WHERE block_index % 3 <> 0"""


def styling_log(spark, sf_dir):
    """Log rows of verdicts on two thirds of the styled blocks."""
    r = records.styling_records(X.styled(spark, sf_dir), X.from_orders(spark, sf_dir, VERDICTS), "orders")
    return r.select(
        "schema", "source", "doc_id", "block_index", "block_kind", F.col("heading_level").cast("int").alias("heading_level"), "in_table", "text", F.col("para.style_name").alias("style_name"), F.col("para.numbering.num_id").alias("num_id"),
        F.col("para.numbering.ilvl").alias("ilvl"), F.col("para.indent.left").alias("indent_left"), F.col("run.bold").alias("bold"), F.size("segments").alias("n_segments"), "style_unresolved", "numbering_unresolved", "verdict", "category", "note",
        F.round(F.col("relative.style_doc_freq").cast("double"), 5).alias("style_doc_freq"), F.col("relative.matches_role_peers").alias("matches_role_peers"), F.col("context.prev_text").alias("prev_text"), F.col("context.next_kind").alias("next_kind"),
        F.col("context.next_numbering.ilvl").alias("next_ilvl"),
    )


def _styling_log_sql(relative: str, near: str) -> str:
    return f"""
    SELECT CAST(5 AS INT) AS schema, 'orders' AS source, CAST(b.doc_id AS VARCHAR) AS doc_id, b.block_index, b.kind AS block_kind, b.level AS heading_level, b.kind = 'table_cell' AS in_table, b.text, b.style_name, CAST(b.num_id AS BIGINT) AS num_id,
      CAST(b.ilvl AS BIGINT) AS ilvl, b.indent_left, b.bold, CAST(CASE WHEN b.is_mixed THEN 2 ELSE 1 END AS INT) AS n_segments, b.style_unresolved, false AS numbering_unresolved, v.verdict, CASE WHEN v.verdict = 'weird' THEN v.category END AS category,
      CASE WHEN v.verdict = 'weird' THEN v.note END AS note, r.style_doc_freq, r.matches_role_peers, n.prev_text, n.next_kind, CAST(n.next_ilvl AS BIGINT) AS next_ilvl
    FROM ({X.STYLED}) b JOIN ({VERDICTS}) v USING (doc_id, block_index) JOIN ({relative}) r USING (doc_id, block_index) JOIN ({near}) n USING (doc_id, block_index)"""


def _decisions(spark, sf_dir):
    log = X.log(spark, sf_dir)
    kinds = F.when(F.col("seq") % 2 == 0, F.array(F.lit("paragraph"))).otherwise(F.array(F.lit("heading"), F.lit("list_item")))
    langs = F.when(F.col("seq") % 3 == 0, F.array(F.lit("en"), F.lit("de"))).otherwise(F.array(F.lit("fr")))
    near = F.struct(F.when(F.col("seq") % 2 == 0, "a").alias("above"), F.lit("b").alias("below"), F.lit(None).cast("string").alias("col_header"), F.when(F.col("seq") % 5 == 0, "r").alias("row_label"))
    return log.withColumns({"block_kinds": kinds, "langs": langs, "neighbors": near}).withColumn("features", features.censor_features())


def _totals(rows):
    return rows.select(F.posexplode("features").alias("at", "x")).groupBy("at").agg(F.round(F.sum("x"), 4).alias("total"))


def censor_features(spark, sf_dir):
    return _totals(_decisions(spark, sf_dir))


def _styling_records(spark, sf_dir):
    b = X.styled(spark, sf_dir)
    rel = style.relative_features(b).select("doc_id", "block_index", F.struct("style_doc_freq", "font_matches_doc_dominant", "size_matches_doc_dominant", "matches_role_peers", "indent_vs_ilvl_norm").alias("relative"))
    none = F.lit(None).cast("string")
    rows = b.join(rel, ["doc_id", "block_index"]).select(
        "doc_id", "block_index", F.col("kind").alias("block_kind"), F.col("level").alias("heading_level"), (F.col("kind") == "table_cell").alias("in_table"), "text", "segments", "style_unresolved",
        F.lit(False).alias("numbering_unresolved"), none.alias("numbering_format"), "relative",
        F.struct(F.struct("num_id", "ilvl").alias("numbering"), F.struct(F.col("indent_left").alias("left"), F.lit(None).cast("int").alias("hanging")).alias("indent"), "alignment").alias("para"),
        F.struct("font", "size_half_pt", "bold", "italic", none.alias("underline")).alias("run"),
    )
    return rows.withColumn("features", features.styling_features())


def styling_features(spark, sf_dir):
    return _totals(_styling_records(spark, sf_dir))


def normalizer_stats(spark, sf_dir):
    rows = X.log(spark, sf_dir).select(F.array(F.col("price") / 1000, F.col("occurrences").cast("double"), F.lit(3.0)).alias("features"))
    n = model.normaliser(rows)
    return n.select("at", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


def _labelled(spark, sf_dir):
    log = X.log(spark, sf_dir)
    return log.select(F.lit("censor").alias("task"), "seq", (F.col("verdict") == "reject").cast("int").alias("label"), F.round(F.col("price") % 997 / 1000, 3).alias("proba"))


def fold_assignment(spark, sf_dir):
    return model.folds(_labelled(spark, sf_dir)).select("seq", "label", "k", "fold")


def threshold_tuning(spark, sf_dir):
    return model.thresholds(_labelled(spark, sf_dir)).select("task", F.round("threshold", 6).alias("threshold"), F.round("accuracy", 9).alias("accuracy"))


def prequential_meter(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    log = e.select(
        F.col("event_type").alias("task"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 7 != 0, F.col("user_id") % 3 == 0).alias("predicted"), (F.col("user_id") % 4 == 0).alias("actual"),
        F.when(F.col("event_id") % 2 == 0, "x").alias("predicted_reason"), F.when(F.col("user_id") % 8 == 0, "x").otherwise("y").alias("actual_reason"),
    )
    m = model.meter(log)
    return m.withColumn("balanced_accuracy", F.round("balanced_accuracy", 9)).withColumn("line", F.regexp_extract(model.meter_text(), r"positives .*$", 0)).drop("line")


def logistic_regression(spark, sf_dir):
    """Verdicts of the decision log: models, thresholds and suggestions on all rows."""
    rows = _decisions(spark, sf_dir).select(F.lit("censor").alias("task"), "seq", "features", (F.col("verdict") == "confirm").cast("int").alias("label"), F.when(F.col("verdict") == "confirm", F.col("detected_type")).alias("reason"))
    models, tuned, heads = model.train(rows)
    scored = model.score(rows.withColumn("fold", F.lit(0)), models)
    return model.suggestions(scored, model.multiclass(rows, heads), tuned).withColumn("line", model.suggestion_line())


def queries() -> dict:
    named = (
        style_counts, style_profile, indent_norms, role_norms, relative_features, deviation_notes, positional_notes, neighbour_context, dominant_segments, run_segments, style_chains,
        heading_levels, heading_forms, style_review_lines, learned_store, allowed_values, rejected_minus_confirmed, effective_allowed, review_counts, default_decisions, page_scope, decision_records, styling_log,
        censor_features, styling_features, normalizer_stats, fold_assignment, threshold_tuning, prequential_meter, logistic_regression,
    )
    return {f.__name__: f for f in named}


def _surface_sql(text: str) -> list[str]:
    return [
        f"least(length({text}), 200) / 200.0", f"CASE WHEN length({text}) = 0 THEN 0 ELSE length(regexp_replace({text}, '[^0-9]', '', 'g')) / CAST(length({text}) AS DOUBLE) END",
        f"CAST(regexp_matches({text}, '\\p{{L}}') AND NOT regexp_matches({text}, '\\p{{Ll}}') AS DOUBLE)", f"CAST(regexp_matches({text}, '^\\s*[0-9]') AS DOUBLE)",
        f"least(len(regexp_extract_all({text}, '\\S+')), 20) / 20.0", f"CAST(regexp_matches({text}, '[!-/:-@\\[-`{{-~]') AS DOUBLE)",
    ]


def _bits(*tests: str) -> list[str]:
    return [f"CAST(coalesce({t}, false) AS DOUBLE)" for t in tests]


def _totals_sql(parts: list[str], source: str) -> str:
    return f"SELECT CAST(i - 1 AS INT) AS at, round(sum(x), 4) AS total FROM (SELECT unnest(f) AS x, generate_subscripts(f, 1) AS i FROM (SELECT [{', '.join(f'CAST({p} AS DOUBLE)' for p in parts)}] AS f FROM ({source}))) GROUP BY i"


_ROLES = "IS NOT DISTINCT FROM"
_RELATIVE = f"""
  b AS MATERIALIZED ({X.STYLED}),
  tot AS (SELECT doc_id, count(*) AS total FROM b GROUP BY doc_id),
  fo AS (SELECT doc_id, font AS dominant_font FROM (SELECT doc_id, font, count(*) AS n FROM b WHERE font IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, font) = 1),
  si AS (SELECT doc_id, size_half_pt AS dominant_size FROM (SELECT doc_id, size_half_pt, count(*) AS n FROM b WHERE size_half_pt IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, size_half_pt) = 1),
  st AS (SELECT doc_id, style_name, count(*) AS n FROM b GROUP BY ALL),
  rn AS MATERIALIZED (SELECT * FROM (SELECT doc_id, kind, level, style_name, font, size_half_pt, bold, italic, alignment, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc_id, kind, level) AS peers, min(min(block_index)) OVER (PARTITION BY doc_id, kind, level) AS first_index FROM b GROUP BY doc_id, kind, level, style_name, font, size_half_pt, bold, italic, alignment)
    QUALIFY row_number() OVER (PARTITION BY doc_id, kind, level ORDER BY n DESC, style_name NULLS FIRST, font NULLS FIRST, size_half_pt NULLS FIRST, bold, italic, alignment NULLS FIRST) = 1),
  inn AS (SELECT doc_id, ilvl, l AS left_norm FROM (SELECT doc_id, ilvl, coalesce(indent_left, 0) AS l, count(*) AS n FROM b WHERE ilvl IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id, ilvl ORDER BY n DESC, l) = 1),
  rel AS MATERIALIZED (SELECT b.*, CAST(CAST(st.n / CAST(total AS DOUBLE) AS FLOAT) AS DOUBLE) AS freq, CASE WHEN NOT style_unresolved AND b.font IS NOT NULL THEN b.font = dominant_font END AS font_ok, CASE WHEN NOT style_unresolved AND b.size_half_pt IS NOT NULL THEN b.size_half_pt = dominant_size END AS size_ok,
    CASE WHEN NOT style_unresolved THEN (b.style_name {_ROLES} rn.style_name AND b.font {_ROLES} rn.font AND b.size_half_pt {_ROLES} rn.size_half_pt AND b.bold = rn.bold AND b.italic = rn.italic AND b.alignment {_ROLES} rn.alignment) END AS peers_ok,
    CASE WHEN b.ilvl IS NOT NULL THEN CAST(coalesce(indent_left, 0) - left_norm AS DOUBLE) END AS indent_gap
    FROM b JOIN tot USING (doc_id) LEFT JOIN fo USING (doc_id) LEFT JOIN si USING (doc_id) JOIN st ON st.doc_id = b.doc_id AND st.style_name {_ROLES} b.style_name
    JOIN rn ON rn.doc_id = b.doc_id AND rn.kind = b.kind AND rn.level {_ROLES} b.level LEFT JOIN inn ON inn.doc_id = b.doc_id AND inn.ilvl = b.ilvl)"""


def _note_sql(column: str, label: str, shown: str, unit: str) -> str:
    """Leave-one-out majority by brute force: each block against all other blocks of its role."""
    return f"""SELECT a.doc_id, a.block_index, '{label} ' || {shown.format('a.' + column)} || '{unit} — ' || n || ' of ' || peers || ' other ' || lab || ' use ' || {shown.format('common')} || '{unit}' AS note FROM (
      SELECT a.doc_id, a.block_index, o.{column} AS common, count(*) AS n FROM b a JOIN b o ON o.doc_id = a.doc_id AND o.kind = a.kind AND o.level {_ROLES} a.level AND o.block_index <> a.block_index WHERE o.{column} IS NOT NULL GROUP BY a.doc_id, a.block_index, o.{column}
      QUALIFY row_number() OVER (PARTITION BY a.doc_id, a.block_index ORDER BY count(*) DESC, o.{column}) = 1) c JOIN labelled a USING (doc_id, block_index) WHERE a.{column} IS NOT NULL AND common <> a.{column}"""


def oracle_sql() -> dict[str, str]:
    sig = "style_name, font, size_half_pt, bold, italic, alignment"
    listed = ", ".join(f"'{t}'" for t in VALUE_TYPES)
    label_of = "CASE kind WHEN 'heading' THEN coalesce('H' || level, 'headings') WHEN 'paragraph' THEN 'body' WHEN 'list_item' THEN 'list items' ELSE 'table cells' END"
    points = "(CASE WHEN {0} % 2 = 0 THEN CAST({0} // 2 AS VARCHAR) ELSE CAST({0} / 2.0 AS VARCHAR) END)"
    even, odd = "seq % 2 = 0", "seq % 2 <> 0"
    method = "CASE WHEN starts_with(method, 'regex:') THEN 'regex' ELSE method END"
    censor = [
        *_bits(*[f"detected_type = '{t}'" for t in VALUE_TYPES], f"detected_type NOT IN ({listed})", *[f"{method} = '{m}'" for m in features.METHODS], f"{method} NOT IN ('party-list', 'regex', 'heuristic', 'manual')"),
        *_bits(even, odd, odd, "false", "scope = 'occurrence'", "heading_level IS NOT NULL", "heading_level = 1", "heading_level = 2", "heading_level = 3", "heading_level > 3", "seq % 3 = 0", "seq % 3 <> 0", "seq % 3 = 0"),
        "least(occurrences, 50) / 50.0", f"CASE WHEN {even} THEN 0.25 ELSE 0.5 END", *_bits(even, "true", "false", "seq % 5 = 0"), *_surface_sql("value"), *_bits("contains(value, '@')"),
    ]
    styling = [
        "freq", "1", *_bits("font_ok", "NOT font_ok", "size_ok", "NOT size_ok", "peers_ok", "NOT peers_ok"), "coalesce(indent_gap, 0)", *_bits("indent_gap IS NOT NULL"),
        *_bits("kind = 'paragraph'", "kind = 'heading'", "kind = 'list_item'", "kind = 'table_cell'", "kind = 'table_cell'", "level = 1", "level = 2", "level = 3", "level > 3", "style_unresolved", "false"),
        "CASE WHEN is_mixed THEN 0.1 ELSE 0.05 END", *_bits("is_mixed", "false", "num_id IS NOT NULL"), "coalesce(indent_left, 0) / 1440.0", *_bits("false", "alignment = 'left'", "false", "false", "false", "bold", "italic", "false"),
        "coalesce(size_half_pt, 0)", *_bits("size_half_pt IS NOT NULL", "font IS NOT NULL"), *_surface_sql("text"),
    ]
    labelled = f"SELECT seq, CASE WHEN verdict = 'reject' THEN 1 ELSE 0 END AS label, round(price % 997 / 1000, 3) AS proba FROM ({X.LOG})"
    runs = f"SELECT doc_id, block_index AS i, CASE WHEN block_index % 6 = 0 THEN ' ' ELSE 'r' || block_index END AS t, block_index % 6 = 0 AS blank, block_index % 4 = 0 AS bold FROM ({X.STYLED}) WHERE NOT (block_index % 15 = 0 AND block_index % 6 <> 0)"
    tally = f"SELECT value, detected_type AS type, count(*) FILTER (verdict = 'reject') AS allow, count(*) FILTER (verdict = 'confirm') AS deny FROM ({X.LOG}) {{}} GROUP BY value, detected_type"
    allowed = f"SELECT DISTINCT value FROM ({tally.format('')}) WHERE allow > 0 AND deny = 0"
    rejected = f"SELECT value FROM ({X.LOG}) WHERE verdict = 'reject' EXCEPT SELECT value FROM ({X.LOG}) WHERE verdict = 'confirm'"
    out = {
        "style_counts": f"SELECT doc_id, style_name, n, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, style_name NULLS FIRST) AS INT) AS rank FROM (SELECT doc_id, style_name, count(*) AS n FROM ({X.STYLED}) GROUP BY ALL)",
        "style_profile": f"WITH {_RELATIVE} SELECT doc_id, total AS total_blocks, dominant_font, dominant_size FROM tot LEFT JOIN fo USING (doc_id) LEFT JOIN si USING (doc_id)",
        "indent_norms": f"WITH {_RELATIVE} SELECT * FROM inn",
        "role_norms": f"WITH {_RELATIVE} SELECT doc_id, kind, level, CAST(peers AS BIGINT) AS peers, first_index, {sig} FROM rn",
        "relative_features": f"WITH {_RELATIVE} SELECT doc_id, block_index, round(freq, 5) AS style_doc_freq, font_ok AS font_matches_doc_dominant, size_ok AS size_matches_doc_dominant, peers_ok AS matches_role_peers, indent_gap AS indent_vs_ilvl_norm FROM rel",
        "deviation_notes": f"""WITH b AS MATERIALIZED ({X.STYLED}), labelled AS (SELECT *, {label_of} AS lab, count(*) OVER (PARTITION BY doc_id, kind, level) - 1 AS peers FROM b),
            n AS (SELECT 1 AS o, * FROM ({_note_sql('font', 'font', '{}', '')}) UNION ALL SELECT 2, * FROM ({_note_sql('size_half_pt', 'size', points, 'pt')}) UNION ALL SELECT 3, doc_id, block_index, '1 of 2 segments bold' FROM b WHERE is_mixed)
            SELECT doc_id, block_index, string_agg(note, '; ' ORDER BY o) AS notes FROM n GROUP BY ALL""",
        "positional_notes": f"""WITH r AS (SELECT doc_id, block_index, kind, CASE WHEN kind = 'list_item' THEN num_id END AS num, CASE WHEN kind = 'list_item' THEN coalesce(ilvl, 0) END AS lvl FROM ({X.STYLED})),
            w AS (SELECT *, lag(num) OVER q AS pn, lead(num) OVER q AS nn, lag(lvl) OVER q AS pl FROM r WINDOW q AS (PARTITION BY doc_id ORDER BY block_index)),
            s AS (SELECT doc_id, block_index, CASE WHEN kind IN ('paragraph', 'heading') AND pn = nn THEN CASE kind WHEN 'heading' THEN 'heading inside' ELSE 'paragraph interrupts' END || ' list ' || pn || ' (between two list items)'
              WHEN pn IS NOT DISTINCT FROM num AND lvl > pl + 1 THEN 'list level jumps ' || pl || '→' || lvl END AS notes FROM w) SELECT * FROM s WHERE notes IS NOT NULL""",
        "neighbour_context": f"SELECT doc_id, block_index, coalesce(lag(trim(text)) OVER w, '') AS prev_text, coalesce(lead(trim(text)) OVER w, '') AS next_text, lag(kind) OVER w AS prev_kind, lead(kind) OVER w AS next_kind, lag(CASE WHEN kind = 'list_item' THEN num_id END) OVER w AS prev_num, lead(CASE WHEN kind = 'list_item' THEN ilvl END) OVER w AS next_ilvl FROM ({X.STYLED}) WINDOW w AS (PARTITION BY doc_id ORDER BY block_index)",
        "dominant_segments": f"SELECT doc_id, block_index, CASE WHEN is_mixed THEN 'a' ELSE text END AS dominant, is_mixed AS mixed FROM ({X.STYLED})",
        "run_segments": f"""WITH r AS ({runs}), p AS (SELECT *, last_value(CASE WHEN NOT blank THEN bold END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM r),
            n AS (SELECT *, sum(CASE WHEN k = 1 THEN 1 WHEN blank THEN 0 WHEN prior IS DISTINCT FROM bold THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS segment FROM p)
            SELECT doc_id, CAST(segment AS BIGINT) AS segment, string_agg(t, '' ORDER BY i) AS text, arg_min(bold, i) AS bold FROM n GROUP BY doc_id, segment""",
        "style_chains": f"""WITH RECURSIVE s AS MATERIALIZED (SELECT doc_id, block_index AS style_id, CASE WHEN block_index % 3 <> 0 THEN lag(block_index) OVER (PARTITION BY doc_id ORDER BY block_index) END AS based_on, font, indent_left FROM ({X.STYLED})),
            c AS (SELECT doc_id, style_id, style_id AS ancestor, 0 AS distance, based_on AS nxt FROM s UNION ALL SELECT c.doc_id, c.style_id, s.style_id, distance + 1, s.based_on FROM c JOIN s ON s.doc_id = c.doc_id AND s.style_id = c.nxt),
            p AS (SELECT c.*, font, indent_left FROM c JOIN s ON s.doc_id = c.doc_id AND s.style_id = c.ancestor)
            SELECT doc_id, style_id, arg_min(font, distance) FILTER (font IS NOT NULL) AS font, arg_min(indent_left, distance) FILTER (indent_left IS NOT NULL) AS indent_left FROM p GROUP BY ALL""",
        "heading_levels": f"SELECT doc_id, block_index, CASE block_index % 4 WHEN 0 THEN 'Title' WHEN 1 THEN 'heading' ELSE 'Heading' || (block_index % 300) END AS style_id, CASE WHEN block_index % 4 < 2 THEN 1 WHEN block_index % 300 <= 255 THEN CAST(least(greatest(block_index % 300, 1), 6) AS INT) END AS level FROM ({X.STYLED})",
        "heading_forms": f"""SELECT doc_id, block_index, CASE block_index % 7 WHEN 0 THEN 'TITLE' WHEN 1 THEN 'Heading' || (block_index % 9) || 'Char' WHEN 2 THEN 'HeadingFoo' WHEN 3 THEN 'heading  ' || (block_index % 9) WHEN 4 THEN 'Subtitle' WHEN 5 THEN 'Heading' || (block_index % 400) ELSE 'My heading 2' END AS style_id,
            CASE block_index % 7 WHEN 0 THEN 1 WHEN 1 THEN CAST(least(greatest(block_index % 9, 1), 6) AS INT) WHEN 2 THEN 1 WHEN 3 THEN CAST(least(greatest(block_index % 9, 1), 6) AS INT) WHEN 5 THEN CASE WHEN block_index % 400 < 256 THEN CAST(least(greatest(block_index % 400, 1), 6) AS INT) END END AS level FROM ({X.STYLED})""",
        "style_review_lines": review_sql(),
        "learned_store": tally.format("WHERE reviewed"),
        "allowed_values": allowed,
        "rejected_minus_confirmed": rejected,
        "effective_allowed": f"{allowed} UNION ({rejected})",
        "review_counts": f"SELECT count(*) FILTER (verdict = 'confirm') AS kept, count(*) FILTER (verdict = 'reject') AS rejected, count(*) FILTER (reviewed) AS reviewed FROM ({X.LOG})",
        "default_decisions": f"""SELECT i.doc_id, i.value, detected_type, coalesce(v, 'confirm') AS verdict, CASE WHEN coalesce(v, 'confirm') = 'confirm' THEN detected_type END AS final_type, 'group' AS scope, v IS NOT NULL AS reviewed
            FROM (SELECT doc_id, value, min(detected_type) AS detected_type FROM ({X.LOG}) GROUP BY ALL) i LEFT JOIN (SELECT doc_id, value, max(verdict) AS v FROM ({X.LOG}) WHERE reviewed GROUP BY ALL) l ON l.doc_id = i.doc_id AND l.value = i.value""",
        "page_scope": f"SELECT doc_id, value, bool_or(p = 1 OR p BETWEEN 3 AND 9) AS in_scope FROM (SELECT *, (seq % 12) // 3 AS p FROM ({X.LOG})) GROUP BY ALL",
        "decision_records": f"SELECT seq, value, verdict, CASE WHEN verdict = 'confirm' THEN detected_type END AS final_type, CAST(6 AS INT) AS schema, CAST(1700000000 AS BIGINT) AS timestamp FROM ({X.LOG}) WHERE reviewed",
        "censor_features": _totals_sql(censor, X.LOG),
        "styling_features": f"WITH {_RELATIVE} {_totals_sql(styling, 'SELECT * FROM rel')}",
        "normalizer_stats": f"SELECT CAST(i - 1 AS INT) AS at, round(avg(x), 4) AS mean, round(CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END, 4) AS std FROM (SELECT unnest(f) AS x, generate_subscripts(f, 1) AS i FROM (SELECT [price / 1000, CAST(occurrences AS DOUBLE), 3.0::DOUBLE] AS f FROM ({X.LOG}))) GROUP BY i",
        "fold_assignment": f"WITH l AS ({labelled}), k AS (SELECT CAST(least(5, count(*) FILTER (label = 1), count(*) FILTER (label = 0)) AS INT) AS k FROM l) SELECT seq, label, k, CASE WHEN k >= 2 THEN CAST((row_number() OVER (PARTITION BY label ORDER BY seq) - 1) % k AS INT) ELSE 0 END AS fold FROM l, k",
        "threshold_tuning": f"""WITH l AS ({labelled}), t AS (SELECT proba AS th, min(seq) AS s FROM l GROUP BY proba UNION ALL SELECT 0.5, 9223372036854775807),
            a AS (SELECT th, min(s) AS s, (count(*) FILTER (label = 1 AND proba >= th) / CAST(nullif(count(*) FILTER (label = 1), 0) AS DOUBLE) + count(*) FILTER (label = 0 AND proba < th) / CAST(nullif(count(*) FILTER (label = 0), 0) AS DOUBLE)) / 2 AS acc FROM (SELECT th, min(s) AS s FROM t GROUP BY th), l GROUP BY th)
            SELECT 'censor' AS task, round(th, 6) AS threshold, round(acc, 9) AS accuracy FROM a WHERE acc >= (SELECT max(acc) FROM a) - 1e-12 ORDER BY round(abs(th - 0.5), 12), s LIMIT 1""",
        "prequential_meter": """WITH l AS (SELECT event_type AS task, event_id AS seq, user_id % 3 = 0 AS p, user_id % 4 = 0 AS a, event_id % 2 = 0 AS r, user_id % 8 = 0 AS x FROM events WHERE event_id % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 100),
            s AS (SELECT task, count(*) AS rows, count(*) FILTER (a) AS positives, count(*) FILTER (NOT a) AS negatives, count(*) FILTER (a AND p) AS positive_hits, count(*) FILTER (NOT a AND NOT p) AS negative_hits, count(*) FILTER (a AND p AND r) AS reasons, count(*) FILTER (a AND p AND r AND x) AS reason_hits FROM l GROUP BY task)
            SELECT *, CASE WHEN rows >= 100 AND positives >= 5 AND negatives > 0 THEN round((positive_hits / CAST(positives AS DOUBLE) + negative_hits / CAST(negatives AS DOUBLE)) / 2, 9) END AS balanced_accuracy FROM s""",
    }
    return out | {"styling_log": _styling_log_sql(out["relative_features"], out["neighbour_context"])}
