"""Detectors as arrays of spans, in built-in expressions only.

A span array comes from two calls of regexp_extract_all over ``(gap)(match or end
of text)``: lengths of gaps and matches add up to offsets. Spans never leave
their row, so detection and overlap resolution need neither explode nor shuffle.
Offsets are characters; ends are exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that results depend on.
W = "(?:one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million|billion)"
WF = "(?:une?|deux|trois|quatre|cinq|six|sept|huit|neuf|dix|onze|douze|treize|quatorze|quinze|seize|vingts?|trente|quarante|cinquante|soixante|cents?|mille|millions?|milliards?)"
FN = r"[0-9]{1,3}(?:\s[0-9]{3})*(?:,[0-9]+)?"
MONTHS = "(?i:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
IBAN = r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}\b"
PHONE = r"\+?[0-9][0-9 ()\-.]{5,}[0-9]"
ACCOUNT = r"\b[0-9]{6,17}\b"
CARD = r"\b[0-9](?:[ \-]?[0-9]){12,18}\b"
MONEY = r"(?:[$£€]\s?[0-9][0-9,]*(?:\.[0-9]{1,2})?)|(?:[0-9][0-9,]*(?:\.[0-9]{1,2})?\s?(?i:usd|eur|gbp|dollars?|euros?|pounds?))"
MONEY_WORDS = rf"(?i:\b{W}(?:[ \t\-]+(?:and[ \t]+)?{W})*\s+(?:dollars?|euros?|pounds?|pesos?|cents?|usd|eur|gbp)\b)"
PERCENT = rf"(?i:(?:\b{W}(?:[ \t\-]+(?:and[ \t]+)?{W})*\s+per ?cent(?:\s*\([^)]*%\s*\))?)|(?:\b[0-9][0-9,]*(?:\.[0-9]+)?\s?%))"
DATE = (
    r"(?:\b[0-9]{1,4}[/.\-][0-9]{1,2}[/.\-][0-9]{1,4}\b)"
    rf"|(?:\b[0-9]{{1,2}}\s+{MONTHS}[a-z]*\.?,?\s+[0-9]{{2,4}}\b)"
    rf"|(?:\b{MONTHS}[a-z]*\.?\s+[0-9]{{1,2}},?\s+[0-9]{{2,4}}\b)"
)
MONEY_FR = rf"(?i:(?:{FN}\s?(?:€|euros?|dollars?|francs?|centimes?))|(?:€\s?{FN})|(?:\b{WF}(?:[ \t\-]+(?:et[ \t]+)?{WF})*\s+(?:euros?|dollars?|francs?|centimes?)\b))"
PERCENT_FR = rf"(?i:(?:\b{WF}(?:[ \t\-]+(?:et[ \t]+)?{WF})*\s+pour\s?cent(?:\s*\([^)]*%\s*\))?)|(?:{FN}\s?%))"
DATE_FR = r"(?i:\b[0-9]{1,2}(?:er)?\s+(?:janvier|février|fevrier|mars|avril|mai|juin|juillet|août|aout|septembre|octobre|novembre|décembre|decembre)\.?\s+[0-9]{2,4}\b)"
NAME = r"\p{Lu}\p{Ll}+(?:[ \t\-]+\p{Lu}\p{Ll}+)*"
#: The same for Java, which matches a repeated group by recursion, and runs out of stack on long ones, unless it keeps what it has. SQL takes NAME.
LOOP_NAME = NAME + "+"
HONORIFIC = rf"\b(?:MM?\.|Mme\.?|Mlle\.?|Me\.?|Dr\.?|Mr\.?|Mrs\.?|Ms\.?)[ \t]+{NAME}"
STOP_WORDS = (
    "the a an this that these those it we you they he she i if in on at to of for and or but by with from as "
    "per pay email reach contact signed sign deliver write invoice note see please dear subject re no yes all any each such"
).split()
ORG_SUFFIXES = "inc incorporated llc llp lp ltd limited corp corporation co company gmbh plc ag sa nv bv".split()
VALUE_TYPES = ("PERSON", "ORG", "IBAN", "CARD", "ACCOUNT", "PHONE", "DATE", "MONEY", "PERCENT", "EMAIL", "LOCATION", "ADDRESS", "ENTITY")

#: Which span wins an overlap: parties first, then by type, heuristics last.
PARTY_RANK, HEURISTIC_RANK = 0, 10
RANKS = {"IBAN": 1, "CARD": 2, "ACCOUNT": 3, "PHONE": 4, "DATE": 5, "MONEY": 6, "PERCENT": 7, "EMAIL": 8}
OTHER_RANK = 9

SPAN = "struct<start:int,end:int,value:string,value_type:string,source:string,rank:int,ord:int>"
NO_SPANS = f"cast(array() as array<{SPAN}>)"


def quoted(s: str) -> str:
    """A SQL string literal that keeps backslashes as they are."""
    return "r'" + s + "'" if "'" not in s else "r\"" + s + '"'


#: Matches that one fold gathers.
FOLD = 256
_NONE = "cast(array() as array<struct<start:int,end:int,value:string>>)"


def matches_sql(text: str, pattern: str) -> str:
    """SQL for array<struct<start,end,value>> of the leftmost non-overlapping matches.

    One pass puts the control characters 1 and 2 around each match; splitting at the first gives pieces
    whose lengths add up to offsets. A text that has these characters itself is cut into gaps and matches
    instead, in two passes.
    """
    marked = f"regexp_replace({text}, {quoted(f'(?U)({pattern})')}, concat(char(1), '$1', char(2)))"
    hit = "substring_index(x, char(2), 1)"
    add = f"named_struct('start', a.at, 'end', a.at + length({hit}), 'value', {hit})"
    step = f"if(instr(x, char(2)) = 0, named_struct('at', a.at + length(x), 'out', a.out), named_struct('at', a.at + length(x) - 1, 'out', concat(a.out, array({add}))))"
    # A fold copies what it has at each match, so long arrays are folded part by part, each from its own offset.
    fold = lambda part, at: f"aggregate({part}, named_struct('at', {at}, 'out', {_NONE}), (a, x) -> {step}, a -> a.out)"
    before = f"aggregate(slice(p, 1, k * {FOLD}), 0, (b, y) -> b + length(y) - if(instr(y, char(2)) = 0, 0, 1))"
    parts = f"flatten(transform(sequence(0, cast((size(p) - 1) div {FOLD} as int)), k -> {fold(f'slice(p, k * {FOLD} + 1, {FOLD})', before)}))"
    fast = f"transform(array(split({marked}, char(1))), p -> if(size(p) <= {FOLD}, {fold('p', '0')}, {parts}))[0]"
    return f"if(instr({text}, char(1)) = 0 and instr({text}, char(2)) = 0, {fast}, {_gaps_sql(text, pattern)})"


def _gaps_sql(text: str, pattern: str) -> str:
    """The same from gaps and matches. The match may also be the empty end of the text: without it, the rest
    after the last match would be scanned again from each of its characters."""
    p = quoted(rf"(?U)(?s:(.*?))((?:{pattern})|\z)")
    gaps, hits = (f"regexp_extract_all({text}, {p}, {g})" for g in (1, 2))
    pairs = f"zip_with({gaps}, {hits}, (g, h) -> named_struct('g', length(g), 'h', h))"
    zero = f"named_struct('at', 0, 'out', {_NONE})"
    step = (
        "named_struct('at', a.at + x.g + length(x.h), 'out', if(x.h = '', a.out, "
        "concat(a.out, array(named_struct('start', a.at + x.g, 'end', a.at + x.g + length(x.h), 'value', x.h)))))"
    )
    return f"aggregate({pairs}, {zero}, (a, x) -> {step}, a -> a.out)"


@dataclass(frozen=True)
class Detector:
    """gate: a cheap test that every text with a match passes. keep: a test of a match ``s``."""

    name: str
    value_type: str
    pattern: str
    gate: str
    keep: str = ""
    source: str = "regex"

    @property
    def loop(self) -> str:
        """The pattern with names that Java matches by a loop."""
        return self.pattern.replace(NAME, LOOP_NAME)

    @property
    def rank(self) -> int:
        return HEURISTIC_RANK if self.source == "heuristic" else RANKS.get(self.value_type, OTHER_RANK)


_DIGIT = "{t} rlike '[0-9]'"
_digits = "regexp_replace(s.value, '[^0-9]', '')"
DETECTORS = (
    Detector("email", "EMAIL", EMAIL, "instr({t}, '@') > 0"),
    Detector("iban", "IBAN", IBAN, "{t} rlike '[A-Z][A-Z][0-9][0-9]'"),
    Detector("phone", "PHONE", PHONE, "{t} rlike '[0-9][0-9 ()\\\\-.]{{5}}'", f"length({_digits}) between 7 and 15"),
    Detector("account", "ACCOUNT", ACCOUNT, "{t} rlike '[0-9]{{6}}'"),
    Detector("card", "CARD", CARD, "{t} rlike '[0-9][ \\\\-]?[0-9][ \\\\-]?[0-9][ \\\\-]?[0-9]'", f"length({_digits}) between 13 and 19 and luhn_check({_digits})"),
    Detector("money", "MONEY", MONEY, _DIGIT),
    Detector("money_words", "MONEY", MONEY_WORDS, "{t} rlike '(?i)dollar|euro|pound|peso|cent|usd|eur|gbp'"),
    Detector("percent", "PERCENT", PERCENT, "{t} rlike '(?i)%|per ?cent'"),
    Detector("date", "DATE", DATE, _DIGIT),
    Detector("money_fr", "MONEY", MONEY_FR, "{t} rlike '(?i)€|euro|dollar|franc|centime'"),
    Detector("percent_fr", "PERCENT", PERCENT_FR, "{t} rlike '(?i)%|pour'"),
    Detector("date_fr", "DATE", DATE_FR, _DIGIT),
)
_stop = "|".join(STOP_WORDS)
ENTITY = Detector("entity", "ENTITY", NAME, "true", source="heuristic")
PERSON = Detector("honorific", "PERSON", HONORIFIC, "{t} rlike 'M|Dr'", source="heuristic")


def _spans(text: str, d: Detector, order: int, matches: str) -> str:
    kept = f"filter({matches}, s -> {d.keep})" if d.keep else matches
    made = (
        f"transform({kept}, s -> named_struct('start', s.start, 'end', s.end, 'value', s.value, 'value_type', '{d.value_type}', "
        f"'source', '{d.source}', 'rank', {d.rank}, 'ord', {order}))"
    )
    return f"if({d.gate.format(t=text)}, {made}, {NO_SPANS})"


def detector_sql(text: str, d: Detector, order: int = 0) -> str:
    """SQL for the spans of one detector."""
    return _spans(text, d, order, matches_sql(text, d.loop))


def entity_sql(text: str, order: int = 0) -> str:
    """Runs of capitalised words without the stop-words at both ends; runs of nothing else are dropped.

    A group that keeps what it has must take whole words: a stop-word at the end is followed by another or by nothing.
    """
    head, tail = rf"^(?:(?i:{_stop})(?:[ \t\-]+|$))++", rf"(?:(?:^|[ \t\-]+)(?i:{_stop})(?=[ \t\-]|$))++$"
    rest = f"transform({matches_sql(text, LOOP_NAME)}, s -> named_struct('end', s.end, 'rest', regexp_replace(s.value, {quoted(head)}, '')))"
    core = f"transform({rest}, s -> named_struct('start', s.end - length(s.rest), 'value', regexp_replace(s.rest, {quoted(tail)}, '')))"
    cut = f"filter(transform({core}, s -> named_struct('start', s.start, 'end', s.start + length(s.value), 'value', s.value)), s -> s.value <> '')"
    return _spans(text, ENTITY, order, cut)


def party_type(name: str) -> str:
    """ORG if a word of the name is a company suffix, else PERSON."""
    words = ["".join(c for c in w) for w in name.split()]
    bare = [w.strip("".join(c for c in w if not c.isalnum())).lower() for w in words]
    return "ORG" if any(w in ORG_SUFFIXES for w in bare) else "PERSON"


def party_sql(text: str, names: list[str], order: int = 0) -> str:
    """All whole-word occurrences of all names, whatever their case. names is a configuration of known size."""
    import re

    parts = []
    for i, name in enumerate(n for n in names if n.strip()):
        d = Detector("party", party_type(name), rf"(?i:\b{re.escape(name).replace(chr(39), '.')}\b)", "true", source="party")
        kept = _spans(text, d, order + i, matches_sql(text, d.pattern)).replace(f"'rank', {d.rank}", f"'rank', {PARTY_RANK}")
        parts.append(kept)
    return f"concat({', '.join(parts)})" if parts else NO_SPANS


def settled(c: Column) -> Column:
    """The same values, computed once per row.

    Filters on an array, such as the one that an explode implies, are pushed through the projections that
    make it, which writes the whole detection into each lambda that refers to it. An expression that the
    optimiser takes for random stays where it is.
    """
    return F.when(F.rand() < 2, c)


def candidates(text: str, names: list[str] | None = None) -> Column:
    """The spans of every detector, parties first, in a fixed order of detectors."""
    parts = [detector_sql(text, d, 100 + i) for i, d in enumerate(DETECTORS)]
    parts += [entity_sql(text, 200), detector_sql(text, PERSON, 201)]
    if names:
        parts.insert(0, party_sql(text, names))
    return F.expr(f"concat({', '.join(parts)})")


def literal_spans_sql(text: str, value: str) -> str:
    """Non-overlapping exact occurrences of a column's value; none for an empty value."""
    parts = f"split({text}, concat('\\\\Q', {value}, '\\\\E'), -1)"
    zero = "named_struct('at', 0, 'out', cast(array() as array<struct<start:int,end:int>>))"
    step = f"named_struct('at', a.at + length(x) + length({value}), 'out', concat(a.out, array(named_struct('start', a.at + length(x), 'end', a.at + length(x) + length({value})))))"
    return f"if({value} = '', cast(array() as array<struct<start:int,end:int>>), aggregate(slice({parts}, 1, size({parts}) - 1), {zero}, (a, x) -> {step}, a -> a.out))"


def paired_sql(text: str) -> str:
    """Spans of innermost-first paired brackets within one text, as array<struct<start,end>>.

    A stack over the brackets: an open one is pushed, a closing one pops the latest.
    """
    marks = f"filter(transform(split({text}, ''), (c, i) -> named_struct('c', c, 'i', i)), m -> m.c in ('[', ']'))"
    zero = "named_struct('open', cast(array() as array<int>), 'out', cast(array() as array<struct<start:int,end:int>>))"
    step = (
        "case when m.c = '[' then named_struct('open', concat(a.open, array(m.i)), 'out', a.out) "
        "when size(a.open) = 0 then a "
        "else named_struct('open', slice(a.open, 1, size(a.open) - 1), 'out', concat(a.out, array(named_struct('start', element_at(a.open, -1), 'end', m.i + 1)))) end"
    )
    return f"if(instr({text}, ']') = 0, cast(array() as array<struct<start:int,end:int>>), aggregate({marks}, {zero}, (a, m) -> {step}, a -> a.out))"


def resolve_sql(spans: str, reserved: str | None = None) -> str:
    """Greedy choice of disjoint spans: by rank, longer, earlier, detector; in order of start. Spans that meet a reserved one are out."""
    usable = f"filter({spans}, s -> not exists({reserved}, r -> s.start < r.end and r.start < s.end))" if reserved else spans
    keyed = f"array_sort(transform({usable}, s -> named_struct('k1', s.rank, 'k2', s.start - s.end, 'k3', s.start, 'k4', s.ord, 's', s)))"
    greedy = (
        f"aggregate({keyed}, {NO_SPANS}, (a, k) -> if(exists(a, o -> k.s.start < o.end and o.start < k.s.end), a, concat(a, array(k.s))))"
    )
    alone = f"size(array_distinct(transform({usable}, s -> s.ord))) <= 1"  # one detector's spans never overlap
    return f"if({alone}, {usable}, array_sort({greedy}))"
