"""Feature vectors of review decisions and styled blocks, as arrays of doubles in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.spans import VALUE_TYPES
from docloom.operators.review import CATEGORIES

BLOCK_KINDS = ("paragraph", "heading", "list_item", "table_cell")
METHODS = ("party-list", "regex", "heuristic", "manual")
LANGS = ("en", "fr")
ALIGNMENTS = ("left", "center", "right", "justify")
CENSOR_WIDTH, STYLING_WIDTH = 45, 43


def bit(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def opt_num(c: Column) -> list[Column]:
    return [F.coalesce(c.cast("double"), F.lit(0.0)), bit(c.isNotNull())]


def tri_state(c: Column) -> list[Column]:
    return [bit(c), bit(~c)]


def one_hot(c: Column, vocabulary: tuple[str, ...]) -> list[Column]:
    return [bit(c == v) for v in vocabulary]


def multi_hot(c: Column, vocabulary: tuple[str, ...]) -> list[Column]:
    return [bit(F.array_contains(c, v)) for v in vocabulary]


def heading_bucket(c: Column) -> list[Column]:
    return [bit(c == 1), bit(c == 2), bit(c == 3), bit(c.isNotNull() & ~c.isin(1, 2, 3))]


def surface(text: Column) -> list[Column]:
    """Length, share of digits, all capitals, starts with a digit, words and punctuation of a text."""
    n = F.length(text)
    digits = n - F.length(F.regexp_replace(text, "[0-9]", ""))
    words = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))
    return [
        F.least(n, F.lit(200)) / 200.0,
        F.when(n == 0, 0.0).otherwise(digits / n),
        bit(text.rlike(r"\p{IsAlphabetic}") & ~text.rlike(r"\p{IsLowercase}")),
        bit(text.rlike(r"(?U)^\s*[0-9]")),
        F.least(words, F.lit(20)) / 20.0,
        bit(text.rlike(r"[!-/:-@\[-`{-~]")),
    ]


def censor_features() -> Column:
    """45 features of a decision record."""
    method = F.when(F.col("method").startswith("regex:"), "regex").otherwise(F.col("method"))
    parts = [
        *one_hot(F.col("detected_type"), VALUE_TYPES), bit(~F.col("detected_type").isin(*VALUE_TYPES)),
        *one_hot(method, METHODS), bit(~method.isin(*METHODS)),
        *multi_hot(F.col("block_kinds"), BLOCK_KINDS), bit(F.col("scope") == "occurrence"),
        bit(F.col("heading_level").isNotNull()), *heading_bucket(F.col("heading_level")),
        *multi_hot(F.col("langs"), LANGS), bit(F.exists("langs", lambda x: ~x.isin(*LANGS))),
        F.least(F.col("occurrences"), F.lit(50)) / 50.0, F.least(F.size("block_kinds"), F.lit(4)) / 4.0,
        *[bit(F.col(f"neighbors.{n}").isNotNull()) for n in ("above", "below", "col_header", "row_label")],
        *surface(F.col("value")), bit(F.contains("value", F.lit("@"))),
    ]
    return F.array(*[p.cast("double") for p in parts])


def styling_features() -> Column:
    """43 features of a styling record. docx says "both" where the vocabulary has "justify", so that one is never set."""
    size = F.coalesce(F.size("segments"), F.lit(0))
    parts = [
        *opt_num(F.col("relative.style_doc_freq")), *tri_state(F.col("relative.font_matches_doc_dominant")),
        *tri_state(F.col("relative.size_matches_doc_dominant")), *tri_state(F.col("relative.matches_role_peers")),
        *opt_num(F.col("relative.indent_vs_ilvl_norm")),
        *one_hot(F.col("block_kind"), BLOCK_KINDS), bit(F.col("in_table")), *heading_bucket(F.col("heading_level")),
        bit(F.col("style_unresolved")), bit(F.col("numbering_unresolved")), F.least(size, F.lit(20)) / 20.0, bit(size >= 2),
        bit(F.col("numbering_format").isNotNull()), bit(F.col("para.numbering.num_id").isNotNull()),
        F.coalesce(F.col("para.indent.left") / 1440.0, F.lit(0.0)), bit(F.col("para.indent.hanging").isNotNull()),
        *one_hot(F.col("para.alignment"), ALIGNMENTS), bit(F.col("run.bold")), bit(F.col("run.italic")),
        bit(F.col("run.underline").isNotNull()), *opt_num(F.col("run.size_half_pt")), bit(F.col("run.font").isNotNull()),
        *surface(F.col("text")),
    ]
    return F.array(*[p.cast("double") for p in parts])


def is_confirm() -> Column:
    return F.col("verdict") == "confirm"


def is_weird() -> Column:
    return F.col("verdict") == "weird"


def reason_index(reason: Column, classes: tuple[str, ...] = CATEGORIES) -> Column:
    """A reason's place among the classes, from 0; null if it has none."""
    at = F.array_position(F.array(*[F.lit(c) for c in classes]), reason)
    return F.when(at > 0, (at - 1).cast("int"))
