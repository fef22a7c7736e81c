"""Queries of detection, resolution and censoring, with their SQL counterparts."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from docloom.functions import spans as S
from docloom.operators import censor, language, records, review
from docloom.operators.fields import sentence_window
from docloom.plans import fixtures as X

PARTIES = ["Acme Holdings", "Globex Ltd", "initech group", "St. John"]
SHOWN = ["doc_id", "block_index", "start_at", "end_at", "value"]


def _shown(found):
    o = censor.occurrences(found)
    return o.withColumnRenamed("start", "start_at").withColumnRenamed("end", "end_at")


def _sql_literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def matches_sql(pattern: str, fields: str = X.FIELDS_SQL) -> str:
    """All matches with offsets, in RE2, by the same gaps."""
    p = _sql_literal(rf"(?s)(.*?)((?:{pattern})|\z)")
    return f"""
    SELECT doc_id, block_index, CAST(till - length(hit) AS INT) AS start_at, CAST(till AS INT) AS end_at, hit AS value FROM (
      SELECT doc_id, block_index, hit, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, block_index ORDER BY i) AS till FROM (
        SELECT doc_id, block_index, unnest(g) AS gap, unnest(h) AS hit, generate_subscripts(g, 1) AS i FROM (
          SELECT doc_id, block_index, regexp_extract_all(text, {p}, 1) AS g, regexp_extract_all(text, {p}, 2) AS h FROM ({fields}) WHERE regexp_matches(text, {_sql_literal(pattern)})))) WHERE hit <> ''"""


_D = "regexp_replace(value, '[^0-9]', '', 'g')"
LUHN_SQL = f"""list_sum(list_transform(range(1, length({_D}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse({_D}), i, 1) AS INT)
  WHEN CAST(substr(reverse({_D}), i, 1) AS INT) > 4 THEN 2 * CAST(substr(reverse({_D}), i, 1) AS INT) - 9 ELSE 2 * CAST(substr(reverse({_D}), i, 1) AS INT) END)) % 10 = 0"""
KEEP_SQL = {"phone": f"length({_D}) BETWEEN 7 AND 15", "card": f"length({_D}) BETWEEN 13 AND 19 AND {LUHN_SQL}"}


def detector_oracle(d: S.Detector, fields: str = X.FIELDS_SQL) -> str:
    keep = KEEP_SQL.get(d.name)
    return f"SELECT * FROM ({matches_sql(d.pattern, fields)})" + (f" WHERE {keep}" if keep else "")


def entity_oracle(fields: str = X.FIELDS_SQL) -> str:
    stop = "|".join(S.STOP_WORDS)
    head, tail = rf"'^(?:(?i:{stop})(?:[ \t\-]+|$))+'", rf"'(?:(?:^|[ \t\-]+)(?i:{stop}))+$'"
    return f"""
    SELECT doc_id, block_index, start_at, CAST(start_at + length(value) AS INT) AS end_at, value FROM (
      SELECT doc_id, block_index, CAST(end_at - length(rest) AS INT) AS start_at, regexp_replace(rest, {tail}, '') AS value FROM (
        SELECT *, regexp_replace(value, {head}, '') AS rest FROM ({matches_sql(S.NAME, fields)}))) WHERE value <> ''"""


def party_oracle(fields: str = X.FIELDS_SQL) -> str:
    each = [f"SELECT *, '{S.party_type(n)}' AS value_type, {i} AS ord FROM ({matches_sql(rf'(?i:\b{re.escape(n)}\b)', fields)})".replace("\\ ", " ") for i, n in enumerate(PARTIES)]
    return " UNION ALL ".join(each)


def candidates_oracle(parties: bool = False, fields: str = X.FIELDS_SQL) -> str:
    named = [(d, 100 + i, detector_oracle(d, fields)) for i, d in enumerate(S.DETECTORS)]
    named += [(S.ENTITY, 200, entity_oracle(fields)), (S.PERSON, 201, detector_oracle(S.PERSON, fields))]
    parts = [f"SELECT doc_id, block_index, start_at, end_at, value, '{d.value_type}' AS value_type, '{d.source}' AS source, {d.rank} AS rank, {o} AS ord FROM ({q})" for d, o, q in named]
    if parties:
        parts.append(f"SELECT doc_id, block_index, start_at, end_at, value, value_type, 'party' AS source, 0 AS rank, ord FROM ({party_oracle(fields)})")
    return " UNION ALL ".join(parts)


def resolved_ctes(candidates: str) -> str:
    """CTEs that end in ``resolved``: rounds that take each field's best span and drop what overlaps it."""
    return f"""
    cand AS MATERIALIZED ({candidates}),
    rounds AS (
      SELECT 0 AS step, * FROM cand
      UNION ALL
      SELECT step + 1, doc_id, block_index, start_at, end_at, value, value_type, source, rank, ord FROM (
        SELECT *, first_value(start_at) OVER w AS bs, first_value(end_at) OVER w AS be FROM rounds WINDOW w AS (PARTITION BY doc_id, block_index ORDER BY rank, start_at - end_at, start_at, ord)
      ) WHERE start_at >= be OR end_at <= bs),
    resolved AS MATERIALIZED (SELECT doc_id, block_index, start_at, end_at, value, value_type, source,
        CASE source WHEN 'party' THEN 'party-list' WHEN 'regex' THEN 'regex:' || lower(value_type) ELSE 'heuristic' END AS method FROM rounds
      QUALIFY row_number() OVER (PARTITION BY doc_id, block_index, step ORDER BY rank, start_at - end_at, start_at, ord) = 1)"""


RESOLVED = f"WITH RECURSIVE {resolved_ctes(candidates_oracle())}"
MAPPING = """
    first_seen AS (SELECT doc_id, value, count(*) AS occurrences, arg_min(value_type, k) AS value_type, arg_min(method, k) AS method, min(k) AS k
      FROM (SELECT *, CAST(block_index AS BIGINT) * 1000000 - start_at AS k FROM resolved) GROUP BY doc_id, value),
    mapping AS MATERIALIZED (SELECT doc_id, value, value_type, method, occurrences,
      'REDACTED_' || upper(value_type) || '_' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS placeholder
      FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, value_type ORDER BY k) AS n FROM first_seen))"""


def _one(d: S.Detector):
    def run(spark, sf_dir):
        f = X.fields(spark, sf_dir)
        return _shown(f.withColumn("spans", S.settled(F.expr(S.detector_sql("text", d))))).select(*SHOWN)

    return run


def entity_guess(spark, sf_dir):
    return _shown(X.fields(spark, sf_dir).withColumn("spans", S.settled(F.expr(S.entity_sql("text"))))).select(*SHOWN)


def party_matches(spark, sf_dir):
    return _shown(X.fields(spark, sf_dir).withColumn("spans", S.settled(F.expr(S.party_sql("text", PARTIES))))).select(*SHOWN, "value_type")


def overlap_resolved(spark, sf_dir):
    return _shown(censor.detect(X.fields(spark, sf_dir))).select(*SHOWN, "value_type", "method")


def party_precedence(spark, sf_dir):
    found = censor.detect(X._cells(X.from_orders(spark, sf_dir, X.LEDGER)), PARTIES)
    return _shown(found).select(*SHOWN, "value_type", "method")


def allow_list(spark, sf_dir):
    allowed = spark.createDataFrame([("Acme Holdings",), ("4111 1111 1111 1111",), ("c7@shop5.com",)], "value string")
    found = censor.detect(X._cells(X.from_orders(spark, sf_dir, X.LEDGER)), None, allowed)
    return _shown(found).select(*SHOWN, "value_type")


def placeholder_mapping(spark, sf_dir):
    return censor.placeholders(censor.detect(X.fields(spark, sf_dir)))


def censored_text(spark, sf_dir):
    return censor.censored(censor.detect(X._cells(X.from_orders(spark, sf_dir, X.LEDGER)))).select("doc_id", "block_index", "text")


def review_items(spark, sf_dir):
    items = censor.review_items(censor.detect(X.fields(spark, sf_dir)))
    return items.select("doc_id", "item_index", "value", "detected_type", "method", F.size("occurrences").alias("n"), F.get("occurrences", F.lit(0))["start"].alias("first_start"))


def sentence_context(spark, sf_dir):
    f = X._cells(X.from_orders(spark, sf_dir, X.LEDGER))
    o = censor.occurrences(f.withColumn("spans", S.settled(F.expr(S.detector_sql("text", S.DETECTORS[0])))))
    return o.select("doc_id", "block_index", "value", sentence_window(F.col("text"), F.col("start"), F.col("end")).alias("context"))


def literal_values(spark, sf_dir):
    rows = X.from_orders(spark, sf_dir, X.LEDGER).withColumn("needle", F.lit("e"))
    return rows.select("doc_id", "block_index", F.posexplode(F.expr(S.literal_spans_sql("text", "needle"))).alias("n", "s")).select("doc_id", "block_index", "n", F.col("s.start").alias("start_at"))


def applied_decisions(spark, sf_dir):
    """The log's decisions applied to the ledger: groups by value, one added value, one rejected type."""
    f = X._cells(X.from_orders(spark, sf_dir, X.LEDGER))
    found = censor.detect(f)
    items = censor.review_items(found)
    verdict = F.when(F.col("detected_type") == "DATE", "reject").otherwise("confirm")
    decided = review.group_decisions(items, items.select("doc_id", "value", verdict.alias("verdict"), F.col("detected_type").alias("final_type")))
    none = F.lit(None).cast("int")
    place = [none.alias(c) for c in ("block_index", "cell_row", "cell_col", "start", "end")]
    base = decided.select("doc_id", F.lit(0).cast("bigint").alias("seq"), "value", "verdict", "final_type", "scope", F.lit(False).alias("user_added"), *place)
    added = f.select("doc_id").distinct().select("doc_id", F.lit(1).cast("bigint").alias("seq"), F.lit("budget").alias("value"), F.lit("confirm").alias("verdict"), F.lit("other").alias("final_type"), F.lit("group").alias("scope"), F.lit(True).alias("user_added"), *place)
    return censor.apply_decisions(found, base.unionByName(added)).select("doc_id", "block_index", "text")


def _occurred(spark, sf_dir):
    f = X._cells(X.from_orders(spark, sf_dir, X.LEDGER))
    blocks = f.select("doc_id", "block_index", "kind", F.lit(None).cast("tinyint").alias("level"), "text", F.lit(None).cast("array<array<string>>").alias("rows"))
    tagged = language.filled(f.withColumns({"lang": F.lit(None).cast("string"), "confidence": F.lit(None).cast("float")}), "en")
    return records.occurrences(censor.detect(f), blocks, tagged)


_LOGGED = ["schema", "timestamp", "source", "doc_id", "value", "method", "detected_type", "verdict", "final_type", "shown_context", "block_context", "occurrences", "scope"]


def _flat(rows):
    joined = [F.array_join(c, ",").alias(c) for c in ("block_kinds", "langs")]
    return rows.select(*_LOGGED, *joined, "span_edited", F.col("neighbors.above").alias("above"), F.col("neighbors.below").alias("below"), F.col("neighbors.row_label").alias("row_label"))


def decision_log(spark, sf_dir):
    """Log rows of decisions on the ledger's values: dates rejected, the rest confirmed, some not reviewed."""
    occurred = _occurred(spark, sf_dir)
    items = occurred.groupBy("doc_id", "value").agg(F.min("value_type").alias("final_type"))
    decided = items.withColumn("verdict", F.when(F.col("final_type") == "DATE", "reject").otherwise("confirm")).withColumn("reviewed", F.length("value") % 3 != 0)
    return _flat(records.group_records(occurred, decided, "ledger", 1700000000))


def occurrence_log(spark, sf_dir):
    """Log rows of decisions on single occurrences: the first of each block of the ledger."""
    occurred = _occurred(spark, sf_dir)
    first = occurred.groupBy("doc_id", "block_index", "cell_row", "cell_col").agg(F.min("start").alias("start"))
    decided = first.withColumns({"verdict": F.when(F.col("start") % 2 == 0, "reject").otherwise("confirm"), "final_type": F.lit("other")})
    return _flat(records.occurrence_records(occurred, decided, "ledger", 1700000000))


_LEDGER_RESOLVED = f"WITH RECURSIVE {resolved_ctes(candidates_oracle(fields=X.LEDGER))}"


def _censored_sql(ctes: str, spans: str, source: str) -> str:
    return f"""{ctes},
    put AS (SELECT s.doc_id, s.block_index, f.text, start_at, end_at, placeholder, coalesce(lag(end_at) OVER (PARTITION BY s.doc_id, s.block_index ORDER BY start_at), 0) AS prior FROM ({spans}) s JOIN ({source}) f USING (doc_id, block_index)),
    done AS (SELECT doc_id, block_index, string_agg(substr(text, CAST(prior + 1 AS BIGINT), CAST(start_at - prior AS BIGINT)) || placeholder, '' ORDER BY start_at) AS head, max(end_at) AS last FROM put GROUP BY doc_id, block_index)
    SELECT doc_id, block_index, CASE WHEN head IS NULL THEN text ELSE head || substr(text, CAST(last + 1 AS BIGINT)) END AS text FROM ({source}) LEFT JOIN done USING (doc_id, block_index)"""


def queries() -> dict:
    out = {f"{d.name}_spans": _one(d) for d in (*S.DETECTORS, S.PERSON)}
    named = (entity_guess, party_matches, overlap_resolved, party_precedence, allow_list, placeholder_mapping, censored_text, review_items, sentence_context, literal_values, applied_decisions, decision_log, occurrence_log)
    return out | {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    out = {f"{d.name}_spans": detector_oracle(d) for d in (*S.DETECTORS, S.PERSON)}
    columns = "doc_id, block_index, start_at, end_at, value"
    shown = f"SELECT {columns}, value_type, method FROM resolved"
    allowed = "'Acme Holdings', '4111 1111 1111 1111', 'c7@shop5.com'"
    decided = """
    kept AS (SELECT r.* FROM resolved r JOIN (SELECT doc_id, value, arg_min(value_type, CAST(block_index AS BIGINT) * 1000000 + start_at) AS label FROM resolved GROUP BY doc_id, value) USING (doc_id, value) WHERE label <> 'DATE'),
    labelled AS (SELECT k.doc_id, k.block_index, k.start_at, k.end_at, k.value, l.label FROM kept k JOIN (SELECT doc_id, value, arg_min(value_type, CAST(block_index AS BIGINT) * 1000000 + start_at) AS label FROM resolved GROUP BY doc_id, value) l USING (doc_id, value)),
    extra AS (SELECT doc_id, block_index, CAST(instr(text, 'budget') - 1 AS INT) AS start_at, CAST(instr(text, 'budget') + 5 AS INT) AS end_at, 'budget' AS value, 'other' AS label FROM (%s) f WHERE instr(text, 'budget') > 0
      AND NOT EXISTS (SELECT 1 FROM labelled l WHERE l.doc_id = f.doc_id AND l.block_index = f.block_index AND l.start_at < instr(f.text, 'budget') + 5 AND instr(f.text, 'budget') - 1 < l.end_at)),
    uses AS MATERIALIZED (SELECT * FROM labelled UNION ALL SELECT * FROM extra),
    firsts AS (SELECT doc_id, value, upper(arg_min(label, k)) AS label, min(k) AS k FROM (SELECT *, CAST(block_index AS BIGINT) * 1000000 - start_at AS k FROM uses) GROUP BY doc_id, value),
    names AS MATERIALIZED (SELECT doc_id, value, 'REDACTED_' || label || '_' || lpad(CAST(row_number() OVER (PARTITION BY doc_id, label ORDER BY k) AS VARCHAR), 3, '0') AS placeholder FROM firsts)""" % X.LEDGER
    window = "trim(regexp_replace(regexp_extract(substr(text, 1, start_at), '[^.!?\\n]*$') || value || regexp_extract(substr(text, end_at + 1), '^[^.!?\\n]*[.!?\\n]?'), '\\s+', ' ', 'g'))"
    around = f"""{_LEDGER_RESOLVED},
    o AS MATERIALIZED (SELECT r.*, CAST(r.block_index AS BIGINT) * 1000000 + start_at AS k, {window} AS shown_context, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS block_context, above, below FROM resolved r
      JOIN (SELECT *, lag(text) OVER w AS above, lead(text) OVER w AS below FROM ({X.LEDGER}) WINDOW w AS (PARTITION BY doc_id ORDER BY block_index)) f USING (doc_id, block_index))"""
    row = "CAST(6 AS INT) AS schema, CAST(1700000000 AS BIGINT) AS timestamp, 'ledger' AS source, CAST(doc_id AS VARCHAR) AS doc_id, value, method"
    rest = "'paragraph' AS block_kinds, 'en' AS langs, false AS span_edited, above, below, CAST(NULL AS VARCHAR) AS row_label"
    return out | {
        "decision_log": f"""{around},
            g AS (SELECT doc_id, value, arg_min(value_type, k) AS detected_type, arg_min(method, k) AS method, arg_min(shown_context, k) AS shown_context, arg_min(block_context, k) AS block_context, arg_min({{'a': above, 'b': below}}, k) AS near,
              CAST(count(*) AS INT) AS occurrences, min(value_type) AS final_type FROM o GROUP BY doc_id, value)
            SELECT {row}, detected_type, CASE WHEN final_type = 'DATE' THEN 'reject' ELSE 'confirm' END AS verdict, CASE WHEN final_type <> 'DATE' THEN final_type END AS final_type, shown_context, block_context, occurrences, 'group' AS scope, {rest}
            FROM (SELECT *, near.a AS above, near.b AS below FROM g) WHERE length(value) % 3 <> 0""",
        "occurrence_log": f"""{around}
            SELECT {row}, value_type AS detected_type, CASE WHEN start_at % 2 = 0 THEN 'reject' ELSE 'confirm' END AS verdict, CASE WHEN start_at % 2 = 1 THEN 'other' END AS final_type, shown_context, block_context, CAST(1 AS INT) AS occurrences, 'occurrence' AS scope, {rest}
            FROM o QUALIFY row_number() OVER (PARTITION BY doc_id, block_index ORDER BY start_at) = 1""",
        "entity_guess": entity_oracle(),
        "party_matches": f"SELECT {columns}, value_type FROM ({party_oracle()})",
        "overlap_resolved": f"{RESOLVED} {shown}",
        "party_precedence": f"WITH RECURSIVE {resolved_ctes(candidates_oracle(True, X.LEDGER))} {shown}",
        "allow_list": f"WITH RECURSIVE {resolved_ctes(f'SELECT * FROM ({candidates_oracle(fields=X.LEDGER)}) WHERE value NOT IN ({allowed})')} SELECT {columns}, value_type FROM resolved",
        "placeholder_mapping": f"{RESOLVED}, {MAPPING} SELECT doc_id, value, value_type, method, occurrences, placeholder FROM mapping",
        "censored_text": _censored_sql(f"{_LEDGER_RESOLVED}, {MAPPING}", "SELECT r.*, m.placeholder FROM resolved r JOIN mapping m ON m.doc_id = r.doc_id AND m.value = r.value", X.LEDGER),
        "review_items": f"""{RESOLVED}, k AS (SELECT *, CAST(block_index AS BIGINT) * 1000000 + start_at AS k FROM resolved),
            i AS (SELECT doc_id, value, arg_min(value_type, k) AS detected_type, arg_min(method, k) AS method, CAST(count(*) AS INT) AS n, arg_min(start_at, k) AS first_start, min(k) AS k FROM k GROUP BY doc_id, value)
            SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS item_index, value, detected_type, method, n, first_start FROM i""",
        "sentence_context": f"""SELECT doc_id, block_index, value, trim(regexp_replace(regexp_extract(substr(text, 1, start_at), '[^.!?\\n]*$') || value || regexp_extract(substr(text, end_at + 1), '^[^.!?\\n]*[.!?\\n]?'), '\\s+', ' ', 'g')) AS context
            FROM ({matches_sql(S.EMAIL, X.LEDGER)}) JOIN ({X.LEDGER}) USING (doc_id, block_index)""",
        "literal_values": f"SELECT doc_id, block_index, CAST(row_number() OVER (PARTITION BY doc_id, block_index ORDER BY i) - 1 AS INT) AS n, CAST(i - 1 AS INT) AS start_at FROM (SELECT doc_id, block_index, text, unnest(range(1, length(text) + 1)) AS i FROM ({X.LEDGER})) WHERE substr(text, i, 1) = 'e'",
        "applied_decisions": _censored_sql(f"{_LEDGER_RESOLVED}, {decided}", "SELECT u.*, n.placeholder FROM uses u JOIN names n ON n.doc_id = u.doc_id AND n.value = u.value", X.LEDGER),
    }
