"""Queries of blocks, neighbours, brackets, sections and languages, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import brackets, fields, inventory, language, sections, style
from docloom.plans import fixtures as X
from docloom.plans import spans as P
from docloom.session import settle

FIELD = ["doc_id", "block_index", "cell_row", "cell_col", "kind", "text"]


def blocks_from_text(spark, sf_dir):
    docs = X.documents(spark, sf_dir).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\r\n \n")).alias("text"))
    return fields.paragraphs(docs).select("doc_id", "block_index", "text")


def fields_of_blocks(spark, sf_dir):
    f = fields.fields(X.drafts(spark, sf_dir))
    return f.select("doc_id", "block_index", F.coalesce("cell_row", F.lit(-1)).alias("cell_row"), F.coalesce("cell_col", F.lit(-1)).alias("cell_col"), "kind", "text")


def doc_id_hash(spark, sf_dir):
    return fields.content_ids(X.drafts(spark, sf_dir))


def neighbors_flow(spark, sf_dir):
    return fields.flow_neighbours(X.drafts(spark, sf_dir)).select("doc_id", "block_index", "above", "below")


def neighbors_table(spark, sf_dir):
    return fields.table_neighbours(X.nation_tables(spark, sf_dir)).drop("block_index")


def bracket_hits(spark, sf_dir):
    return brackets.field_hits(fields.fields(X.drafts(spark, sf_dir))).withColumnsRenamed({"start": "start_at", "end": "end_at"})


def bracket_balance(spark, sf_dir):
    b = brackets.balance(fields.fields(X.drafts(spark, sf_dir)))
    return b.select("doc_id", F.col("open").alias("n_open"), F.col("close").alias("n_close"), "balanced")


def _places(spark, sf_dir):
    """Blocks, their fields, and the places of their hits, found once."""
    blocks = X.drafts(spark, sf_dir)
    f = fields.fields(blocks)
    return blocks, f, settle(brackets.places(f))


def cross_block_hits(spark, sf_dir):
    h = brackets.hits(*_places(spark, sf_dir))
    return h.select("doc_id", "block_index", "cell_row", "cell_col", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "end_block", "kind", "status", F.length("span_text").alias("n_chars"), F.md5("span_text").alias("digest"))


def document_sections(spark, sf_dir):
    blocks = X.drafts(spark, sf_dir)
    return sections.sections(blocks, brackets.places(fields.fields(blocks)))


def snippet_index(spark, sf_dir):
    blocks = X.drafts(spark, sf_dir)
    return sections.snippet_index(brackets.places(fields.fields(blocks)), blocks)


def markdown_inventory(spark, sf_dir):
    return inventory.inventories(X.drafts(spark, sf_dir)).select("doc_id", F.length("markdown").alias("n_chars"), F.md5("markdown").alias("digest"))


def inventory_texts(spark, sf_dir):
    """The whole inventories; markdown_inventory gives their digests."""
    return inventory.inventories(X.drafts(spark, sf_dir))


def snippet_files(spark, sf_dir):
    """Snippet files of the drafts, censored range by range."""
    blocks, f, places = _places(spark, sf_dir)
    s = settle(sections.slices(f, places))
    files = sections.snippet_documents(s, sections.snippet_index(places, blocks, s), "drafts.md")
    return files.select("doc_id", "id", "path", F.length("markdown").alias("n_chars"), F.md5("markdown").alias("digest"))


def cross_previews(spark, sf_dir):
    """Spans across paragraphs as the inventory shows them. Only their ranges are cut out; a range is censored by itself."""
    _, f, places = _places(spark, sf_dir)
    crossing = places.where("kind = 'paired_cross_paragraph'")
    shown = sections.with_previews(crossing.withColumn("span_text", F.lit("")), sections.slices(f, crossing))
    return shown.select("doc_id", "block_index", F.col("start").alias("start_at"), "end_block", F.length("span_text").alias("n_chars"), F.md5("span_text").alias("digest"))


def table_markdown(spark, sf_dir):
    return X.nation_tables(spark, sf_dir).select("doc_id", sections.table_markdown(F.col("rows")).alias("markdown"))


def span_cells(spark, sf_dir):
    """Spans as they are shown in table cells, and slugs."""
    blocks = X.drafts(spark, sf_dir).where("kind <> 'table'")
    return blocks.select("doc_id", "block_index", sections.display_cell(F.col("text")).alias("cell"), sections.slug(F.col("text")).alias("slug"))


def dominant_language(spark, sf_dir):
    docs = X.documents(spark, sf_dir).select(F.col("source").alias("doc_id"), F.when(F.col("lang") != "es", F.col("lang")).alias("lang"))
    return language.dominant(docs)


def document_languages(spark, sf_dir):
    return language.document_languages(X.documents(spark, sf_dir).select(F.col("source").alias("doc_id"), "lang"))


def language_tags(spark, sf_dir):
    tagged = language.tag(X.lines(spark, sf_dir))
    return tagged.select("doc_id", "block_index", "lang", F.round(F.col("confidence").cast("double"), 4).alias("confidence"))


def page_numbers(spark, sf_dir):
    blocks = X.from_orders(spark, sf_dir, X.STYLED).select("doc_id", "block_index", (F.col("block_index") % 6 == 0).alias("break_before"), F.when(F.col("block_index") % 5 == 0, 1).otherwise(0).alias("breaks_after"))
    return style.pages(blocks).select("doc_id", "block_index", "page")


_MARKS = f"""
  f AS MATERIALIZED ({X.DRAFT_FIELDS_SQL}),
  c AS (SELECT doc_id, block_index, cell_row, cell_col, text, unnest(range(1, length(text) + 1)) AS i FROM f WHERE contains(text, '[') OR contains(text, ']')),
  marks AS (SELECT doc_id, block_index, cell_row, cell_col, text, i - 1 AS p, CASE WHEN substr(text, i, 1) = '[' THEN 1 ELSE -1 END AS d FROM c WHERE substr(text, i, 1) IN ('[', ']')),
  deep AS (SELECT *, sum(d) OVER (PARTITION BY doc_id, block_index, cell_row, cell_col ORDER BY p) AS depth FROM marks),
  low AS (SELECT *, least(0, min(depth) OVER (PARTITION BY doc_id, block_index, cell_row, cell_col ORDER BY p)) AS least_depth FROM deep),
  was AS (SELECT *, coalesce(lag(least_depth) OVER (PARTITION BY doc_id, block_index, cell_row, cell_col ORDER BY p), 0) AS before FROM low),
  lv AS (SELECT *, d < 0 AND depth < before AS lone_close, depth - least_depth + CASE WHEN d < 0 THEN 1 ELSE 0 END AS lvl FROM was),
  nx AS (SELECT *, lead(d) OVER w AS nd, lead(p) OVER w AS np FROM lv WHERE NOT lone_close WINDOW w AS (PARTITION BY doc_id, block_index, cell_row, cell_col, lvl ORDER BY p)),
  h AS MATERIALIZED (
    SELECT doc_id, block_index, cell_row, cell_col, text, p AS start_at, CASE WHEN nd = -1 THEN np + 1 ELSE length(text) END AS end_at,
      CASE WHEN nd = -1 THEN CASE WHEN np + 1 - p > 120 THEN 'paired_long' ELSE 'paired' END ELSE 'lone_open' END AS kind FROM nx WHERE d > 0
    UNION ALL SELECT doc_id, block_index, cell_row, cell_col, text, 0, p + 1, 'lone_close' FROM lv WHERE lone_close),
  hits AS MATERIALIZED (SELECT doc_id, block_index, cell_row, cell_col, CAST(start_at AS INT) AS start_at, CAST(end_at AS INT) AS end_at, kind, CASE WHEN kind IN ('paired', 'paired_long') THEN 'confident' ELSE 'guessed' END AS status,
    substr(text, CAST(start_at + 1 AS BIGINT), CAST(end_at - start_at AS BIGINT)) AS span_text FROM h)"""
_CROSS = f"""{_MARKS},
  lone AS (SELECT *, CASE WHEN kind = 'lone_open' THEN 1 ELSE -1 END AS d, row_number() OVER (PARTITION BY doc_id ORDER BY block_index, cell_row, cell_col, start_at, end_at) AS o FROM hits WHERE kind LIKE 'lone%'),
  ld AS (SELECT *, sum(d) OVER (PARTITION BY doc_id ORDER BY o) AS depth FROM lone),
  ll AS (SELECT *, least(0, min(depth) OVER (PARTITION BY doc_id ORDER BY o)) AS least_depth FROM ld),
  lw AS (SELECT *, coalesce(lag(least_depth) OVER (PARTITION BY doc_id ORDER BY o), 0) AS before FROM ll),
  lx AS (SELECT *, depth - least_depth + CASE WHEN d < 0 THEN 1 ELSE 0 END AS lvl FROM lw WHERE NOT (d < 0 AND depth < before)),
  ln AS (SELECT *, lead(d) OVER w AS nd, lead(block_index) OVER w AS nb, lead(end_at) OVER w AS ne, lead(o) OVER w AS no FROM lx WINDOW w AS (PARTITION BY doc_id, lvl ORDER BY o)),
  pairs AS MATERIALIZED (SELECT doc_id, block_index, cell_row, cell_col, start_at, nb AS end_block, ne AS end_at, o, no FROM ln WHERE d = 1 AND nd = -1 AND nb > block_index),
  b AS MATERIALIZED (SELECT doc_id, block_index AS bi, text AS flat FROM ({X.DRAFTS_SQL})),
  joined AS (SELECT p.doc_id, p.block_index, cell_row, cell_col, start_at, end_block, end_at, string_agg(CASE WHEN bi = p.block_index THEN substr(flat, CAST(start_at + 1 AS BIGINT)) WHEN bi = end_block THEN substr(flat, 1, CAST(end_at AS BIGINT)) ELSE flat END, chr(10) || chr(10) ORDER BY bi) AS span_text
    FROM pairs p JOIN b ON b.doc_id = p.doc_id AND bi BETWEEN p.block_index AND end_block GROUP BY ALL),
  used AS (SELECT doc_id, o FROM pairs UNION ALL SELECT doc_id, no FROM pairs),
  every AS MATERIALIZED (
    SELECT doc_id, block_index, cell_row, cell_col, start_at, end_at, block_index AS end_block, kind, status, span_text FROM hits WHERE kind NOT LIKE 'lone%'
    UNION ALL SELECT doc_id, block_index, cell_row, cell_col, start_at, end_at, block_index, kind, status, span_text FROM lone ANTI JOIN used USING (doc_id, o)
    UNION ALL SELECT doc_id, block_index, cell_row, cell_col, start_at, end_at, end_block, 'paired_cross_paragraph', 'guessed', span_text FROM joined),
  d AS MATERIALIZED ({X.DRAFTS_SQL})"""
_SLUG = r"regexp_replace(left(regexp_replace(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', '-', 'g')), '^-|-$', '', 'g'), 50), '-$', '')"
_COLLAPSE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


def _slices_sql() -> str:
    """CTEs that end in ``part``: the text of each block of each range, censored per range. A cell is a block of its own number."""
    cell = f"SELECT doc_id, CAST(block_index AS BIGINT) * 100000 + cell_col + 1 AS block_index, text FROM ({X.DRAFT_FIELDS_SQL})"
    free = "SELECT c.* FROM (%s) c WHERE NOT EXISTS (SELECT 1 FROM hits p WHERE p.kind LIKE 'paired%%' AND p.doc_id = c.doc_id AND p.block_index = c.block_index // 100000 AND p.cell_col = c.block_index %% 100000 - 1 AND c.start_at < p.end_at AND p.start_at < c.end_at)"
    return f"""{_CROSS}, {P.resolved_ctes(free % P.candidates_oracle(fields=cell))},
      g AS (SELECT doc_id, block_index, end_block, min({{'s': start_at, 'r': cell_row, 'c': cell_col, 'k': kind}}) AS f, bool_or(status = 'guessed') AS needs_review FROM every GROUP BY ALL),
      i AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_index, f, end_block) AS n, f.k = 'paired_cross_paragraph' AS is_cross FROM g),
      fresh AS MATERIALIZED (SELECT i.n, r.* FROM i JOIN resolved r ON r.doc_id = i.doc_id AND r.block_index // 100000 BETWEEN i.block_index AND i.end_block),
      seen AS (SELECT doc_id, n, value, arg_min(value_type, k) AS value_type, min(k) AS k FROM (SELECT *, block_index * 1000000 - start_at AS k FROM fresh) GROUP BY doc_id, n, value),
      named AS MATERIALIZED (SELECT doc_id, n, value, 'REDACTED_' || upper(value_type) || '_' || CASE WHEN m < 1000 THEN lpad(CAST(m AS VARCHAR), 3, '0') ELSE CAST(m AS VARCHAR) END AS placeholder
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, n, value_type ORDER BY k) AS m FROM seen)),
      put AS (SELECT s.doc_id, s.n, s.block_index // 100000 AS block_index, f.text, start_at, end_at, placeholder, coalesce(lag(end_at) OVER (PARTITION BY s.doc_id, s.n, s.block_index ORDER BY start_at), 0) AS prior
        FROM fresh s JOIN named USING (doc_id, n, value) JOIN d f ON f.doc_id = s.doc_id AND f.block_index = s.block_index // 100000 AND f.kind <> 'table'),
      done AS (SELECT doc_id, n, block_index, string_agg(substr(text, CAST(prior + 1 AS BIGINT), CAST(start_at - prior AS BIGINT)) || placeholder, '' ORDER BY start_at) AS head, max(end_at) AS last FROM put GROUP BY doc_id, n, block_index),
      part AS MATERIALIZED (SELECT i.doc_id, i.n, i.is_cross, i.block_index AS first_block, i.end_block, d.block_index, d.kind, d.level, CASE WHEN head IS NULL THEN text ELSE head || substr(text, CAST(last + 1 AS BIGINT)) END AS text
        FROM i JOIN d ON d.doc_id = i.doc_id AND d.kind <> 'table' AND d.block_index BETWEEN i.block_index AND i.end_block LEFT JOIN done ON done.doc_id = i.doc_id AND done.n = i.n AND done.block_index = d.block_index)"""


def _inventory_sql(snippets: str) -> str:
    """The Markdown inventory of each document of the drafts, from its parts in order."""
    n = "chr(10)"
    cell = f"'`' || replace(CASE WHEN length(c) > 60 THEN left(c, 60) || '…' ELSE c END, '|', '\\|') || '`'"
    kinds = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in sections.KIND_LABELS.items())
    grid = f"'| ' || array_to_string(list_transform(string_split(text, ' | '), lambda x: replace({_COLLAPSE.format('x')}, '|', '\\|')), ' | ') || ' |' || {n} || '|' || repeat(' --- |', len(string_split(text, ' | '))) || {n} || {n}"
    return f"""WITH {_CROSS}, snip AS MATERIALIZED ({snippets}),
      place AS (SELECT *, coalesce(max(CASE WHEN kind = 'heading' THEN block_index END) OVER (PARTITION BY doc_id ORDER BY block_index), block_index) AS section FROM d),
      line AS (SELECT e.doc_id, section, e.block_index, start_at, cell_row, cell_col, e.kind, '| ' || s.id || ' | ' || {cell} || ' | ' || CASE e.kind {kinds} END || ' | ' || CASE status WHEN 'guessed' THEN '⚠ GUESSED' ELSE 'confident' END || ' | [' || path || '](' || path || ') |' || {n} AS row
        FROM (SELECT *, replace({_COLLAPSE.format('span_text')}, '`', '''') AS c FROM every) e JOIN snip s USING (doc_id, block_index, end_block) JOIN (SELECT doc_id, block_index, section FROM place) p USING (doc_id, block_index)),
      inventory AS (SELECT doc_id, section, string_agg(row, '' ORDER BY block_index, start_at, cell_row, cell_col, kind, row) AS rows FROM line GROUP BY ALL),
      body AS (SELECT doc_id, section, string_agg(CASE kind WHEN 'heading' THEN repeat('#', level) || ' ' || text || {n} || {n} WHEN 'table' THEN {grid} ELSE text || {n} || {n} END, '' ORDER BY block_index) AS body FROM place GROUP BY ALL),
      entries AS (SELECT doc_id, string_agg(body || '**Variables in this section:**' || {n} || {n} || '| ID | Snippet | Kind | Status | File |' || {n} || '|----|---------|------|--------|------|' || {n} || rows || {n}, '' ORDER BY section) AS entries FROM inventory JOIN body USING (doc_id, section) GROUP BY doc_id),
      listed AS (SELECT doc_id, string_agg('| ' || id || ' | ' || block_index || CASE WHEN end_block > block_index THEN '–' || end_block ELSE '' END || ' | ' || CASE WHEN needs_review THEN '⚠' ELSE '' END || ' | [' || path || '](' || path || ') |' || {n}, '' ORDER BY CAST(substr(id, 2) AS INT)) AS listed FROM snip GROUP BY doc_id),
      m AS (SELECT doc_id, '# Detected variables' || {n} || {n} || coalesce('## Snippet index' || {n} || {n} || '| ID | Block(s) | Review | File |' || {n} || '|----|----------|--------|------|' || {n} || listed || {n}, '') || coalesce(entries, '_No bracketed variables detected._' || {n}) AS markdown
        FROM (SELECT DISTINCT doc_id FROM d) LEFT JOIN listed USING (doc_id) LEFT JOIN entries USING (doc_id))
      SELECT doc_id, markdown FROM m"""


def _marker_counts() -> str:
    listed = lambda ws: ", ".join(f"'{w}'" for w in ws)
    return ", ".join(f"len(list_filter(w, lambda x: x IN ({listed(ws)}))) AS n_{lang}" for lang, ws in language.MARKERS.items())


def oracle_sql() -> dict[str, str]:
    langs = sorted(language.MARKERS, reverse=True)  # of equal counts the larger code wins
    best = f"greatest({', '.join('n_' + x for x in langs)})"
    total = " + ".join(f"n_{x}" for x in langs)
    chosen = " ".join(f"WHEN n_{x} = {best} THEN '{x}'" for x in langs)
    out = {
        "blocks_from_text": f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY block_index) - 1 AS INT) AS block_index, text FROM ({X.LINES_SQL}) WHERE trim(text) <> ''",
        "fields_of_blocks": X.DRAFT_FIELDS_SQL,
        "doc_id_hash": f"""SELECT doc_id, left(sha256(unhex(string_agg(h || 'FF', '' ORDER BY block_index))), 16) AS content_id FROM (
            SELECT doc_id, block_index, CASE kind WHEN 'heading' THEN '01' || lpad(CAST(level AS VARCHAR), 2, '0') || hex(encode(text)) WHEN 'table' THEN '03' || list_aggregate(list_transform(string_split(text, ' | '), lambda c: hex(encode(c)) || '00'), 'string_agg', '') || '0A' ELSE '02' || hex(encode(text)) END AS h FROM ({X.DRAFTS_SQL})) GROUP BY doc_id""",
        "neighbors_flow": f"SELECT doc_id, block_index, lag(t) OVER w AS above, lead(t) OVER w AS below FROM (SELECT doc_id, block_index, CASE WHEN kind <> 'table' THEN text END AS t FROM ({X.DRAFTS_SQL})) WINDOW w AS (PARTITION BY doc_id ORDER BY block_index)",
        "neighbors_table": f"""SELECT doc_id, CAST(r - 1 AS INT) AS cell_row, CAST(c - 1 AS INT) AS cell_col, rows[r][c] AS text, CASE WHEN r > 1 THEN rows[r - 1][c] END AS above, CASE WHEN r < len(rows) THEN rows[r + 1][c] END AS below,
            CASE WHEN r > 1 THEN rows[1][c] END AS col_header, CASE WHEN c > 1 THEN rows[r][1] END AS row_label FROM (SELECT doc_id, rows, r, unnest([1, 2, 3]) AS c FROM (SELECT doc_id, rows, unnest(range(1, len(rows) + 1)) AS r FROM ({X.NATIONS_SQL})))""",
        "bracket_hits": f"WITH {_MARKS} SELECT * FROM hits",
        "bracket_balance": f"SELECT doc_id, CAST(sum(length(text) - length(replace(text, '[', ''))) AS BIGINT) AS n_open, CAST(sum(length(text) - length(replace(text, ']', ''))) AS BIGINT) AS n_close, n_open = n_close AS balanced FROM ({X.DRAFT_FIELDS_SQL}) GROUP BY doc_id",
        "cross_block_hits": f"WITH {_CROSS} SELECT doc_id, block_index, cell_row, cell_col, start_at, end_at, end_block, kind, status, CAST(length(span_text) AS INT) AS n_chars, md5(span_text) AS digest FROM every",
        "document_sections": f"""WITH {_CROSS}, s AS (SELECT *, coalesce(max(CASE WHEN kind = 'heading' THEN block_index END) OVER (PARTITION BY doc_id ORDER BY block_index), block_index) AS section FROM d),
            n AS (SELECT doc_id, block_index, count(*) AS n FROM every GROUP BY ALL)
            SELECT doc_id, section, max(CASE WHEN block_index = section AND kind = 'heading' THEN level END) AS level, max(CASE WHEN block_index = section AND kind = 'heading' THEN text END) AS heading, count(*) AS n_blocks, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_hits FROM s LEFT JOIN n USING (doc_id, block_index) GROUP BY doc_id, section""",
        "snippet_index": f"""WITH {_CROSS}, g AS (SELECT doc_id, block_index, end_block, min({{'s': start_at, 'r': cell_row, 'c': cell_col, 'k': kind}}) AS f, bool_or(status = 'guessed') AS needs_review FROM every GROUP BY ALL),
            i AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_index, f, end_block) AS n, f.k = 'paired_cross_paragraph' AS is_cross FROM g),
            t AS (SELECT i.doc_id, i.block_index, end_block, n, needs_review, is_cross, arg_min(text, d.block_index) AS text FROM i LEFT JOIN d ON d.doc_id = i.doc_id AND d.kind <> 'table' AND d.block_index BETWEEN i.block_index AND end_block GROUP BY ALL),
            u AS (SELECT *, CASE WHEN {_SLUG} = '' THEN 'span' ELSE {_SLUG} END AS slug FROM t),
            v AS (SELECT *, row_number() OVER (PARTITION BY doc_id, is_cross, slug ORDER BY n) AS k FROM u)
            SELECT doc_id, 'S' || n AS id, block_index, end_block, needs_review, 'snippets/' || CASE WHEN is_cross THEN 'cross-paragraph/' ELSE '' END || slug || CASE WHEN k > 1 THEN '-' || k ELSE '' END || '.md' AS path FROM v""",
        "snippet_files": f"""WITH RECURSIVE {_slices_sql()},
            body AS (SELECT doc_id, n, arg_min(text, block_index) AS text, string_agg(CASE WHEN kind = 'heading' THEN repeat('#', level) || ' ' ELSE '' END || text || chr(10) || chr(10), '' ORDER BY block_index) AS body FROM part GROUP BY doc_id, n),
            u AS (SELECT i.*, text, body, CASE WHEN {_SLUG} = '' THEN 'span' ELSE {_SLUG} END AS slug FROM i LEFT JOIN body USING (doc_id, n)),
            v AS (SELECT *, row_number() OVER (PARTITION BY doc_id, is_cross, slug ORDER BY n) AS k, CASE WHEN is_cross THEN '../../drafts.md' ELSE '../drafts.md' END AS back FROM u),
            m AS (SELECT *, '# S' || n || CASE WHEN is_cross THEN ' — cross-paragraph span, blocks ' ELSE ' — snippet, block ' END || block_index || CASE WHEN end_block > block_index THEN '–' || end_block ELSE '' END || CASE WHEN is_cross THEN ' (⚠ review)' ELSE '' END
              || chr(10) || chr(10) || '> Back to inventory: [`' || back || '`](' || back || ')' || CASE WHEN is_cross THEN ' · kind: paired (cross-paragraph) · status: ⚠ GUESSED' || chr(10) || chr(10) || 'This span crosses paragraphs; confirm that it is one variable.' ELSE '' END
              || chr(10) || chr(10) || '---' || chr(10) || chr(10) || coalesce(body, '') AS markdown FROM v)
            SELECT doc_id, 'S' || n AS id, 'snippets/' || CASE WHEN is_cross THEN 'cross-paragraph/' ELSE '' END || slug || CASE WHEN k > 1 THEN '-' || k ELSE '' END || '.md' AS path, CAST(length(markdown) AS INT) AS n_chars, md5(markdown) AS digest FROM m""",
        "cross_previews": f"""WITH RECURSIVE {_slices_sql()},
            line AS (SELECT doc_id, first_block, end_block, string_agg(CASE WHEN block_index = first_block THEN substr(text, greatest(instr(text, '['), 1)) WHEN block_index = end_block AND contains(text, ']') THEN regexp_extract(text, '(?s)^.*[]]') ELSE text END, ' ' ORDER BY block_index) AS line
              FROM part WHERE kind = 'paragraph' AND end_block > first_block GROUP BY ALL)
            SELECT e.doc_id, e.block_index, start_at, e.end_block, CAST(length(coalesce(line, '')) AS INT) AS n_chars, md5(coalesce(line, '')) AS digest FROM every e LEFT JOIN line l ON l.doc_id = e.doc_id AND l.first_block = e.block_index AND l.end_block = e.end_block
            WHERE e.kind = 'paired_cross_paragraph'""",
        "table_markdown": f"SELECT doc_id, '| ' || array_to_string(rows[1], ' | ') || ' |' || chr(10) || '| --- | --- | --- |' || chr(10) || list_aggregate(list_transform(rows[2:], lambda r: '| ' || array_to_string(r, ' | ') || ' |' || chr(10)), 'string_agg', '') || chr(10) AS markdown FROM ({X.NATIONS_SQL})",
        "span_cells": f"""SELECT doc_id, block_index, '`' || replace(CASE WHEN length(c) > 60 THEN left(c, 60) || '…' ELSE c END, '|', '\\|') || '`' AS cell, CASE WHEN {_SLUG} = '' THEN 'span' ELSE {_SLUG} END AS slug
            FROM (SELECT *, replace({_COLLAPSE.format('text')}, '`', '''') AS c FROM ({X.DRAFTS_SQL}) WHERE kind <> 'table')""",
        "dominant_language": "WITH n AS (SELECT source, lang, count(*) AS n FROM documents WHERE lang <> 'es' GROUP BY ALL), r AS (SELECT source, lang FROM n QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) = 1) SELECT s.source AS doc_id, coalesce(lang, 'und') AS dominant_lang FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN r ON r.source = s.source",
        "document_languages": "SELECT source AS doc_id, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM documents GROUP BY source",
        "language_tags": f"""WITH w AS (SELECT doc_id, block_index, text, regexp_extract_all(lower(text), '\\p{{L}}+') AS w FROM ({X.LINES_SQL})), n AS (SELECT doc_id, block_index, text, {_marker_counts()} FROM w)
            SELECT doc_id, block_index, CASE WHEN ok THEN CASE {chosen} END END AS lang, CASE WHEN ok THEN round(CAST({best} AS DOUBLE) / ({total}), 4) END AS confidence FROM (SELECT *, length(text) >= 25 AND {best} > 0 AND 2 * {best} >= {total} AS ok FROM n)""",
        "page_numbers": f"SELECT doc_id, block_index, CAST(1 + sum(CASE WHEN block_index % 6 = 0 THEN 1 ELSE 0 END) OVER w + coalesce(sum(CASE WHEN block_index % 5 = 0 THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS page FROM ({X.STYLED}) WINDOW w AS (PARTITION BY doc_id ORDER BY block_index)",
    }
    return out | {"inventory_texts": _inventory_sql(out["snippet_index"])}


def queries() -> dict:
    named = (
        blocks_from_text, fields_of_blocks, doc_id_hash, neighbors_flow, neighbors_table, bracket_hits, bracket_balance, cross_block_hits, document_sections,
        snippet_index, snippet_files, cross_previews, markdown_inventory, inventory_texts, table_markdown, span_cells, dominant_language, document_languages, language_tags, page_numbers,
    )
    return {f.__name__: f for f in named}
