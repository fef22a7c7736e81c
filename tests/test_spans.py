import random
import re

import pytest
from pyspark.sql import functions as F

from docloom.functions import spans as S
from docloom.operators import censor

FIELD = "doc_id bigint, block_index int, cell_row int, cell_col int, kind string, heading_level tinyint, text string"


def frame(spark, texts, doc=1):
    return spark.createDataFrame([(doc, i, None, None, "paragraph", None, t) for i, t in enumerate(texts)], FIELD)


def found(spark, texts, **kw):
    rows = censor.occurrences(censor.detect(frame(spark, texts), **kw)).orderBy("block_index", "start").collect()
    return [(r.block_index, r.value_type, r.value) for r in rows]


@pytest.mark.parametrize(
    "text,want",
    [
        ("write to a@b.com please", [("EMAIL", "a@b.com")]),
        ("pay GB82WEST12345698765432 now", [("IBAN", "GB82WEST12345698765432")]),
        ("on 2026-06-04 it ends", [("PHONE", "2026-06-04")]),
        ("costs $500000 in all", [("ACCOUNT", "500000")]),
        ("bare 4155550132 here", [("ACCOUNT", "4155550132")]),
        ("due 12/05/2026 at noon", [("DATE", "12/05/2026")]),
        ("overcharged by ten percent (10%) or more", [("PERCENT", "ten percent (10%)")]),
        ("soit dix pour cent du total", [("PERCENT", "dix pour cent")]),
        ("pay 1 000,50 € today", [("MONEY", "1 000,50 €")]),
        ("le 3 FÉVRIER 2024 au soir", [("DATE", "3 FÉVRIER 2024")]),
        ("about nineteen percent now", [("PERCENT", "nineteen percent")]),
        ("card 4111 1111 1111 1111 ok", [("CARD", "4111 1111 1111 1111")]),
        ("met Dr. Smith there", [("PERSON", "Dr. Smith")]),
        ("", []),
    ],
)
def test_single_texts(spark, text, want):
    assert [(t, v) for _, t, v in found(spark, [text])] == want


def test_stop_words_are_trimmed_at_both_ends(spark):
    assert [v for _, _, v in found(spark, ["The Buyer and Pay Acme The", "The A", "New To York"])] == ["Buyer", "Acme", "New To York"]


def test_luhn_failures_are_no_cards(spark):
    assert ("CARD", "4111 1111 1111 1112") not in [(t, v) for _, t, v in found(spark, ["4111 1111 1111 1112"])]


def test_parties_win_and_get_their_type(spark):
    got = found(spark, ["ACME Ltd. and st. john paid jane@acme.com"], names=["Acme Ltd", "St. John"])
    assert got == [(0, "ORG", "ACME Ltd"), (0, "PERSON", "st. john"), (0, "EMAIL", "jane@acme.com")]
    assert [S.party_type(n) for n in ("Globex, Inc.", "Company Men", "Jane Roe", "Ag")] == ["ORG", "ORG", "PERSON", "ORG"]


def test_allowed_values_make_way_for_others(spark):
    allowed = spark.createDataFrame([("2026-06-04",)], "value string")
    assert found(spark, ["on 2026-06-04 it ends"], allowed=allowed) == []
    shorter = spark.createDataFrame([("GB82WEST12345698765432",)], "value string")
    assert found(spark, ["pay GB82WEST12345698765432 to a@b.co"], allowed=shorter) == [(0, "PHONE", "12345698765432"), (0, "EMAIL", "a@b.co")]


def test_paired_brackets_are_reserved(spark):
    assert [v for _, _, v in found(spark, ["pay [a@b.com] or c@d.com", "x ] e@f.com ["])] == ["c@d.com", "e@f.com"]


def test_numbering_runs_from_the_right_within_a_field(spark):
    texts = ["a@b.com then c@d.com", "again a@b.com and e@f.com"]
    f = censor.detect(frame(spark, texts))
    got = {r.value: r.placeholder for r in censor.placeholders(f).collect()}
    assert got == {"c@d.com": "REDACTED_EMAIL_001", "a@b.com": "REDACTED_EMAIL_002", "e@f.com": "REDACTED_EMAIL_003"}
    out = [r.text for r in censor.censored(f).orderBy("block_index").collect()]
    assert out == ["REDACTED_EMAIL_002 then REDACTED_EMAIL_001", "again REDACTED_EMAIL_002 and REDACTED_EMAIL_003"]


def test_decisions_split_added_and_rejected(spark):
    f = censor.detect(frame(spark, ["Rate is 3% here and 3% there; globex agrees."]))
    schema = "doc_id bigint, seq bigint, value string, verdict string, final_type string, scope string, user_added boolean, block_index int, cell_row int, cell_col int, start int, end int"
    decisions = spark.createDataFrame(
        [(1, 0, "3%", "confirm", "PERCENT", "occurrence", False, 0, None, None, 8, 10), (1, 1, "globex", "confirm", "ORG", "group", True, None, None, None, None, None), (1, 2, "Rate", "reject", None, "group", False, None, None, None, None, None)], schema
    )
    out = [r.text for r in censor.apply_decisions(f, decisions).collect()]
    assert out == ["Rate is REDACTED_PERCENT_001 here and 3% there; REDACTED_ORG_001 agrees."]


def test_spans_equal_python_regex(spark):
    r = random.Random(4)
    parts = ["a@b.co", " ", "12/05/2026", "x", "é", "4155550132", "10%", "\n", "Anna", "-", "Bo", "$5", ".", "ten percent", "3 mars 2024"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(150)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for pattern in (S.EMAIL, S.ACCOUNT, S.DATE, S.PERCENT, S.MONEY):
        got = {x.i: [(s.start, s.end) for s in x.s] for x in df.select("i", F.expr(S.matches_sql("text", pattern)).alias("s")).collect()}
        assert got == {i: [m.span() for m in re.finditer(pattern, t)] for i, t in enumerate(texts)}


def test_resolution_equals_a_plain_greedy(spark):
    r = random.Random(6)
    cases = []
    for i in range(120):
        cases.append((i, [(s, s + r.randint(1, 6), "v", "T", "regex", r.randint(0, 4), o) for o, s in enumerate(r.choices(range(20), k=r.randint(0, 9)))]))
    df = spark.createDataFrame(cases, f"i int, spans array<{S.SPAN}>")
    got = {x.i: sorted((s.start, s.end, s.ord) for s in x.r) for x in df.select("i", F.expr(S.resolve_sql("spans")).alias("r")).collect()}
    for i, spans in cases:
        taken = []
        for s in sorted(spans, key=lambda s: (s[5], s[0] - s[1], s[0], s[6])):
            if all(s[1] <= t[0] or t[1] <= s[0] for t in taken):
                taken.append(s)
        assert got[i] == sorted((s[0], s[1], s[6]) for s in taken)


def test_literal_spans(spark):
    df = spark.createDataFrame([("aaa.b a.b", "a.b"), ("aaaa", "aa"), ("x", ""), ("$1 $1", "$1")], "text string, v string")
    got = [[(s.start, s.end) for s in r.s] for r in df.select(F.expr(S.literal_spans_sql("text", "v")).alias("s")).collect()]
    assert got == [[(2, 5), (6, 9)], [(0, 2), (2, 4)], [], [(0, 2), (3, 5)]]
