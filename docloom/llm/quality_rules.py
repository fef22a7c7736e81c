"""Quality rules: a threshold table compiled into one projection, with built-in functions only.

Metrics of a text are lengths, symbol, stop-word and line counts; a rule bounds a
ratio of two of them from below or above. ``compile_rules`` turns the table into
one Boolean column, so the whole decision is part of a single Spark projection
without shuffles or user functions.

Repeated 3-word windows are found by their 64-bit hashes within a text.

Cases: a null text counts as empty, has zero counts and fails; empty texts fail
the minimum length; rows are independent, so repeated rows give repeated
results; an empty table gives an empty table; extra columns are ignored by
judge() and kept by keep(); texts of any length are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to a in is it that for was on with as be at by this from or an are not he his but "
    "le la les de des du et un une que qui pour par sur dans au en est il ne pas "
    "der die das und ist von zu den mit nicht ein eine dem im auf für "
    "el los las del y que se por con para su al lo es no una"
).split()


@dataclass(frozen=True)
class Rule:
    """Fails a text where metric / per is under low or over high; per "" is 1."""

    name: str
    metric: str
    per: str = ""
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("mean word length", "word_chars", "n_words", 1.5, 25),
    Rule("symbols per word", "n_symbols", "n_words", high=0.5),
    Rule("stop words", "n_stop_words", low=2),
    Rule("duplicate lines", "n_dup_lines", "n_lines", high=0.5),
    Rule("bullet lines", "n_bullet_lines", "n_lines", high=0.9),
    Rule("lines cut off", "n_ellipsis_lines", "n_lines", high=0.5),
    Rule("capitals per character", "n_capitals", "word_chars", high=0.5),
)


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """One column: whether a row with the metrics passes every rule."""
    ok = F.lit(True)
    for r in rules:
        over = F.greatest(F.col(r.per), F.lit(1)) if r.per else F.lit(1)
        if r.low is not None:
            ok &= F.col(r.metric) >= over * F.lit(r.low)
        if r.high is not None:
            ok &= F.col(r.metric) <= over * F.lit(r.high)
    return ok


def _without(chars: str) -> Column:
    return F.length(F.translate("text", chars, ""))


def _total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0), lambda a, x: a + x)


def metrics(docs: DataFrame) -> DataFrame:
    """docs with the columns that rules refer to. Needs a column ``text`` without nulls."""
    n = F.col("n_words")
    out = (
        docs.withColumn("_words", F.expr(rf"regexp_extract_all(text, r'{WORD}', 0)"))
        .withColumn("_lines", F.filter(F.split("text", "\n"), lambda x: F.translate(x, SPACE, "") != ""))
        .withColumn("n_words", F.size("_words").cast("bigint"))
        .withColumn("_windows", F.slice(F.transform("_words", lambda w, i: F.xxhash64(w, F.get(F.col("_words"), i + 1), F.get(F.col("_words"), i + 2))), 1, F.greatest(n - 2, F.lit(0)).cast("int")))
        .withColumn("_sorted", F.when(F.size("_windows") == F.size(F.array_distinct("_windows")), F.expr("array()").cast("array<bigint>")).otherwise(F.sort_array("_windows")))
        .withColumn("_twice", F.array_distinct(F.filter("_sorted", lambda h, i: h == F.get(F.col("_sorted"), i + 1))))
    )
    # Positions of repeated windows: by lookup where few windows repeat, else by sorting windows with their positions.
    looked_up = F.filter(F.transform("_windows", lambda h, i: F.when(F.array_contains("_twice", h), i)), lambda p: p.isNotNull())
    out = out.withColumn("_pairs", F.when(F.size("_twice") > 64, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    near = lambda p, i: (p["h"] == F.get(F.col("_pairs"), i + 1)["h"]) | (p["h"] == F.get(F.col("_pairs"), F.greatest(i - 1, F.lit(0)))["h"]) & (i > 0)
    by_sorting = F.sort_array(F.transform(F.filter("_pairs", near), lambda p: p["i"]))
    out = out.withColumn("_at", F.when(F.size("_twice") == 0, F.expr("array()").cast("array<int>")).when(F.size("_twice") > 64, by_sorting).otherwise(looked_up))
    step = F.transform("_at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get(F.col("_at"), i + 1) - p, F.lit(3))))
    starts = lambda *marks: F.size(F.filter("_lines", lambda x: F.ltrim(x).rlike("^(?:" + "|".join(marks) + ")")))
    return out.select(
        *docs.columns,
        "n_words",
        _without(SPACE).cast("bigint").alias("word_chars"),
        (F.length("text") - _without(SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        _total(step).cast("bigint").alias("n_repeat_words"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(*sorted(set(STOP_WORDS))))).cast("bigint").alias("n_stop_words"),
        (F.length("text") - _without("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("bigint").alias("n_capitals"),
        starts("[-*]", "•").cast("bigint").alias("n_bullet_lines"),
        F.size(F.filter("_lines", lambda x: F.rtrim(x).endswith("..."))).cast("bigint").alias("n_ellipsis_lines"),
    )


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed and kept."""
    m = metrics(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return m.select("doc_id", *BASE, failed.alias("base_failed"), (~failed & compile_rules(rules)).alias("kept"))


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with the columns they came with.

    The verdict unfolds to one row or none. A filter would be pushed through the projections above the
    scan, which would write out each metric anew wherever another refers to it.
    """
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    judged = metrics(packed).select("_doc", (~failed & compile_rules(rules)).alias("_kept"))
    return judged.select(F.explode(F.when(F.col("_kept"), F.array("_doc"))).alias("_doc")).select(*[F.col("_doc")[c].alias(c) for c in docs.columns])


def oracle() -> str:
    """The same rows in DuckDB SQL, by unnesting words and windows."""
    quoted = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    space = r"[\x20\x09-\x0D]"
    line_list = rf"list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '{space}', '', 'g') <> '')"
    tests = []
    for r in RULES:
        over = f"greatest({r.per}, 1)" if r.per else "1"
        tests += [f"{r.metric} >= {over} * CAST({r.low} AS DOUBLE)"] * (r.low is not None) + [f"{r.metric} <= {over} * CAST({r.high} AS DOUBLE)"] * (r.high is not None)
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, {line_list} AS lines FROM d),
    p AS (SELECT r, unnest(words) AS w1, generate_subscripts(words, 1) AS i FROM w),
    t AS (SELECT r, i, w1, lead(w1) OVER q AS w2, lead(w1, 2) OVER q AS w3 FROM p WINDOW q AS (PARTITION BY r ORDER BY i)),
    k AS (SELECT r, i, count(*) OVER (PARTITION BY r, w1, w2, w3) AS n FROM t WHERE w3 IS NOT NULL),
    x AS (SELECT r, count(DISTINCT i + o) AS n_repeat_words FROM k, (VALUES (0), (1), (2)) AS s(o) WHERE n > 1 GROUP BY r),
    m AS (SELECT w.r, doc_id, CAST(len(words) AS BIGINT) AS n_words, length(regexp_replace(text, '{space}', '', 'g')) AS word_chars,
      length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
      coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines, len(list_filter(words, lambda x: lower(x) IN ({quoted}))) AS n_stop_words,
      length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals, len(list_filter(lines, lambda x: regexp_matches(ltrim(x), '^(?:[-*]|\x{{2022}})'))) AS n_bullet_lines,
      len(list_filter(lines, lambda x: ends_with(rtrim(x), '...'))) AS n_ellipsis_lines FROM w LEFT JOIN x ON x.r = w.r),
    b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
    SELECT doc_id, {', '.join(BASE)}, base_failed, NOT base_failed AND {' AND '.join(tests)} AS kept FROM b"""
