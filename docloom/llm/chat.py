"""Chat formatting: a compiler for a small sandboxed template language.

A template is parsed into a syntax tree, constants are folded, and each node
becomes a Python closure. A rendering is a lazy sequence of (text, in_generation)
pieces, so conversations of any length stream through in bounded memory.

The language: ``{# remark #}``, ``{{ expression }}``, ``{% if %}/{% elif %}/{% else %}/{% endif %}``,
``{% for x in expression %}/{% endfor %}`` (with loop.index, loop.first and
loop.last), ``{% set x = expression %}`` and ``{% generation %}/{% endgeneration %}``;
a hyphen inside a marker, as in ``{%-`` or ``-}}``, drops the white space on its side.
Expressions: strings, integers, true, false, none, names, keys of mappings
(a.b, a['b']), + == != < > <= >= in, and, or, not, parentheses, and the filters
upper, lower, trim, title, length, default(x) and escape(marks...). There are no
calls, attributes of objects, imports or assignments outside the template's own
names, so a template cannot reach anything but its inputs.

Cases: null text or role counts as empty; rows of one conversation go by turn,
ties by role and text; repeated rows are repeated turns; a null conv_id is a
conversation of its own; an empty table gives an empty table; extra columns are
ignored. A conversation, or a turn, of any length is written and read in parts of
``PART_CHARS`` characters; a task holds one turn's text at a time, as its row does.
"""

from __future__ import annotations

import functools
import hashlib
import operator
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import bounded_batches

CONTROL = ("### ", "</turn>")
TEMPLATE = (
    "{% for m in messages %}### {{ m.role | escape(': ') }}: "
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}</turn>\n{% endfor %}"
)


class TemplateError(ValueError):
    pass


def escape(s: str, *more: str) -> str:
    """A backslash before every backslash and control string; unescape() undoes it."""
    out = str(s).replace("\\", "\\\\")
    for mark in (*CONTROL, *more):
        out = out.replace(mark, "\\" + mark)
    return out


_ESCAPED = re.compile(r"\\(.)", re.S)


def unescape(s: str) -> str:
    return _ESCAPED.sub(r"\1", s)


FILTERS: dict[str, Callable] = {
    "upper": lambda s: str(s).upper(),
    "lower": lambda s: str(s).lower(),
    "trim": lambda s: str(s).strip(),
    "title": lambda s: str(s).title(),
    "length": len,
    "default": lambda s, other="": other if s is None else s,
    "escape": escape,
}
_COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge, "in": lambda a, b: a in b}


# Syntax tree ---------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Key:
    of: object
    key: object


@dataclass(frozen=True)
class Apply:
    """A pure operation on operands: an operator or a filter."""

    fn: Callable
    args: tuple


@dataclass(frozen=True)
class Logic:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Output:
    value: object


@dataclass(frozen=True)
class If:
    test: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class Assign:
    name: str
    value: object


@dataclass(frozen=True)
class Generation:
    body: tuple


_QUOTED = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""
_PART = re.compile(rf"(?P<trim>\s*(?=\{{[{{%#]-))?(?:\{{\{{-?(?P<out>(?:{_QUOTED}|(?!-?\}}\}}).)*)(?P<o>-?)\}}\}}|\{{%-?(?P<tag>(?:{_QUOTED}|(?!-?%\}}).)*)(?P<t>-?)%\}}|\{{#.*?(?P<c>-?)#\}})", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+<>|().,\[\]]))""", re.S)
_STRING_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _tokens(s: str) -> list[tuple[str, str]]:
    out, at = [], 0
    s = s.strip()
    while at < len(s):
        m = _TOKEN.match(s, at)
        if not m:
            raise TemplateError(f"unexpected {s[at:at + 10]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Expressions:
    """Recursive descent: or, and, not, comparison, +, filters, keys, atoms."""

    def __init__(self, source: str):
        self.tokens, self.at = _tokens(source), 0

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" else ""

    def take(self, *wanted: str) -> str:
        if self.peek() not in wanted:
            raise TemplateError(f"expected {' or '.join(wanted)}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self):
        out = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def either(self):
        left = self.both()
        while self.peek() == "or":
            self.take("or")
            left = Logic("or", left, self.both())
        return left

    def both(self):
        left = self.negated()
        while self.peek() == "and":
            self.take("and")
            left = Logic("and", left, self.negated())
        return left

    def negated(self):
        if self.peek() == "not":
            self.take("not")
            return Apply(operator.not_, (self.negated(),))
        return self.compared()

    def compared(self):
        left = self.added()
        while self.peek() in _COMPARE:
            left = Apply(_COMPARE[self.take(*_COMPARE)], (left, self.added()))
        return left

    def added(self):
        left = self.filtered()
        while self.peek() == "+":
            self.take("+")
            left = Apply(operator.add, (left, self.filtered()))
        return left

    def filtered(self):
        value = self.keyed()
        while self.peek() == "|":
            self.take("|")
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            args = [value]
            if self.peek() == "(":
                self.take("(")
                while self.peek() != ")":
                    args.append(self.either())
                    if self.peek() != ")":
                        self.take(",")
                self.take(")")
            value = Apply(FILTERS[name], tuple(args))
        return value

    def keyed(self):
        value = self.atom()
        while self.peek() in (".", "["):
            if self.take(".", "[") == ".":
                kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
                if kind != "name" or name.startswith("_"):
                    raise TemplateError("a key must be a plain name")
                self.at += 1
                value = Key(value, Const(name))
            else:
                value = Key(value, self.either())
                self.take("]")
        return value

    def atom(self):
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too early")
        kind, s = self.tokens[self.at]
        if s == "(" and kind == "op":
            self.take("(")
            value = self.either()
            self.take(")")
            return value
        self.at += 1
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: _STRING_ESCAPES.get(m[1], m[1]), s[1:-1], flags=re.S))
        if kind == "int":
            return Const(int(s))
        if kind == "name" and not s.startswith("_"):
            return Const({"true": True, "false": False, "none": None}[s]) if s in ("true", "false", "none") else Name(s)
        raise TemplateError(f"unexpected {s!r}")


def parse(source: str) -> tuple:
    """The template's syntax tree."""
    parts, at = [], 0
    while m := _PART.search(source, at):
        if m.start() > at:
            parts.append(("text", source[at : m.start()]))
        if m["out"] is not None:
            parts.append(("out", m["out"]))
        elif m["tag"] is not None:
            parts.append(("tag", m["tag"].strip()))
        at = m.end()
        if m["o"] or m["t"] or m["c"]:
            at += len(source[at:]) - len(source[at:].lstrip())
    if at < len(source):
        parts.append(("text", source[at:]))
    position = 0

    def body(*ends: str) -> tuple[tuple, str]:
        nonlocal position
        nodes = []
        while position < len(parts):
            kind, s = parts[position]
            position += 1
            if kind == "text":
                nodes.append(Output(Const(s)))
            elif kind == "out":
                nodes.append(Output(_Expressions(s).whole()))
            else:
                word, _, rest = s.partition(" ")
                if word in ends:
                    return tuple(nodes), s
                nodes.append(tag(word, rest))
        if ends:
            raise TemplateError(f"missing {' or '.join(ends)}")
        return tuple(nodes), ""

    def condition(rest: str) -> If:
        test = _Expressions(rest).whole()
        then, end = body("elif", "else", "endif")
        if end.startswith("elif"):
            return If(test, then, (condition(end[5:]),))
        return If(test, then, body("endif")[0] if end == "else" else ())

    def tag(word: str, rest: str):
        if word == "if":
            return condition(rest)
        if word == "for" and (m := re.fullmatch(r"\s*([A-Za-z]\w*)\s+in\s+(.*)", rest, re.S)):
            return For(m[1], _Expressions(m[2]).whole(), body("endfor")[0])
        if word == "set" and (m := re.fullmatch(r"\s*([A-Za-z]\w*)\s*=\s*(.*)", rest, re.S)):
            return Assign(m[1], _Expressions(m[2]).whole())
        if word == "generation":
            return Generation(body("endgeneration")[0])
        raise TemplateError(f"unknown tag {word!r}")

    return body()[0]


def fold(node):
    """The node with constant operations done and adjacent constant output joined."""
    if isinstance(node, tuple):
        out: list = []
        for x in map(fold, node):
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Output) and isinstance(y.value, Const):
                    y = Output(Const(_text(y.value.value)))
                    if y.value.value == "":
                        continue
                    if out and isinstance(out[-1], Output) and isinstance(out[-1].value, Const):
                        y = Output(Const(out.pop().value.value + y.value.value))
                out.append(y)
        return tuple(out)
    if isinstance(node, Apply):
        args = tuple(map(fold, node.args))
        if not all(isinstance(a, Const) for a in args):
            return Apply(node.fn, args)
        try:
            return Const(node.fn(*(a.value for a in args)))
        except (TypeError, ValueError) as e:
            raise TemplateError(f"a constant expression has no value: {e}") from e
    if isinstance(node, Logic):
        left, right = fold(node.left), fold(node.right)
        if isinstance(left, Const):
            return right if bool(left.value) == (node.op == "and") else left
        return Logic(node.op, left, right)
    if isinstance(node, Key):
        return Key(fold(node.of), fold(node.key))
    if isinstance(node, Output):
        return Output(fold(node.value))
    if isinstance(node, If):
        test = fold(node.test)
        if isinstance(test, Const):
            return fold(node.then if test.value else node.other)
        return If(test, fold(node.then), fold(node.other))
    if isinstance(node, For):
        return For(node.name, fold(node.over), fold(node.body))
    if isinstance(node, Assign):
        return Assign(node.name, fold(node.value))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    return node


def _text(x: object) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x)


def _value(node) -> Callable[[dict], object]:
    """A closure that evaluates an expression."""
    if isinstance(node, Const):
        return lambda names, v=node.value: v
    if isinstance(node, Name):
        return lambda names, n=node.name: names.get(n)
    if isinstance(node, Key):
        of, key = _value(node.of), _value(node.key)

        def lookup(names):
            x = of(names)
            return x.get(key(names)) if isinstance(x, Mapping) else None

        return lookup
    if isinstance(node, Logic):
        left, right = _value(node.left), _value(node.right)
        return (lambda names: left(names) and right(names)) if node.op == "and" else (lambda names: left(names) or right(names))
    fn, args = node.fn, [_value(a) for a in node.args]
    if len(args) == 1:
        return lambda names, a=args[0]: fn(a(names))
    return lambda names: fn(*[a(names) for a in args])


Piece = tuple[str, bool]


def _writer(node) -> Callable[[dict, bool], Iterator[Piece]]:
    """A closure that yields a statement's pieces."""
    if isinstance(node, tuple):
        parts = [_writer(x) for x in node]

        def sequence(names, on):
            for p in parts:
                yield from p(names, on)

        return sequence
    if isinstance(node, Output):
        value = _value(node.value)

        def output(names, on):
            yield _text(value(names)), on

        return output
    if isinstance(node, If):
        test, then, other = _value(node.test), _writer(node.then), _writer(node.other)
        return lambda names, on: (then if test(names) else other)(names, on)
    if isinstance(node, Generation):
        inner = _writer(node.body)
        return lambda names, on: inner(names, True)
    if isinstance(node, Assign):
        assigned = _value(node.value)

        def assign(names, on, name=node.name):
            names[name] = assigned(names)
            yield from ()

        return assign
    over, body = _value(node.over), _writer(node.body)

    def loop(names, on, name=node.name):
        items, index, none = iter(over(names) or ()), 0, object()
        item = next(items, none)
        while item is not none:
            after = next(items, none)
            index += 1
            yield from body({**names, name: item, "loop": {"index": index, "first": index == 1, "last": after is none}}, on)
            item = after

    return loop


def compile_template(source: str) -> Callable[..., Iterator[Piece]]:
    """render(**inputs) -> pieces of (text, whether inside a generation block). Inputs may be lazy iterables."""
    write = _writer(fold(parse(source)))
    return lambda **inputs: write(dict(inputs), False)


# Conversations --------------------------------------------------------------

PARTS = "conv_id bigint, part bigint, text string, mask array<struct<start:int,end:int>>"
_MASK = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
PART_CHARS = 1 << 16


def _conversations(batches: Iterable[pa.RecordBatch], columns: int) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Groups of consecutive rows with one first value, each to be used up before the next."""
    from itertools import groupby

    rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(columns)), strict=True))
    return groupby(rows, key=lambda r: r[0])


def format_conversations(turns: DataFrame, template: str = TEMPLATE, partitions: int | None = None) -> DataFrame:
    """Rendered conversations, in parts of about PART_CHARS characters with the spans under the loss mask.

    Rows of a conversation stand together and in order within a partition. A long
    conversation has more parts, so no task holds one whole.
    """
    bounded_batches(turns.sparkSession)
    keys = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    rows = turns.select("conv_id", "turn", "role", "text")
    rows = (rows.repartition(partitions, "conv_id") if partitions else rows.repartition("conv_id")).sortWithinPartitions(*keys)

    def run(batches):
        render = compile_template(template)

        def parts():
            for conv, group in _conversations(batches, 4):
                messages = ({"turn": t, "role": r or "", "text": x or ""} for _, t, r, x in group)
                n, text, size, mask = 0, [], 0, []
                pieces = ((p[a : a + PART_CHARS], on) for p, on in render(messages=messages) for a in range(0, len(p), PART_CHARS))
                for piece, on in pieces:
                    if on:
                        if mask and mask[-1]["end"] == size:
                            mask[-1]["end"] = size + len(piece)
                        else:
                            mask.append({"start": size, "end": size + len(piece)})
                    text.append(piece)
                    size += len(piece)
                    if size >= PART_CHARS:
                        yield conv, n, "".join(text), mask
                        n, text, size, mask = n + 1, [], 0, []
                if size or not n:
                    yield conv, n, "".join(text), mask

        held, size = [], 0
        for p in parts():
            held.append(p)
            size += len(p[2])
            if size >= 1 << 22:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)

    def _batch(held):
        kinds = (pa.int64(), pa.int64(), pa.string(), _MASK)
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names=["conv_id", "part", "text", "mask"])

    return rows.mapInArrow(run, PARTS)


READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


class _Reader:
    """Reads one conversation back from its parts and keeps running digests; holds no more than a part and a mark."""

    #: What ends each state: the mark of a turn, its role, its text.
    ENDS = ("### ", ": ", "</turn>\n")

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = self.state = 0
        self.buffer, self.pending = "", ""

    def add(self, text: str, mask: list[dict]) -> None:
        for m in mask:
            self.add_loss(text[m["start"] : m["end"]])
        self.chars += len(text)
        s, at = self.buffer + text, 0
        while at < len(s):
            mark = self.ENDS[self.state]
            end = self._end(s, at, mark)
            to = end if end >= 0 else self._whole(s, at, max(at, len(s) - len(mark) + 1))
            if self.state:
                self.turns.update(unescape(s[at:to]).encode())
            elif to > at:
                raise ValueError(f"{s[at : at + 80]!r} begins no turn")
            at = to
            if end < 0:
                break
            at += len(mark)
            if self.state:
                self.turns.update(b"\n")
            self.n += self.state == 2
            self.state = (self.state + 1) % 3
        self.buffer = s[at:]

    @staticmethod
    def _end(s: str, at: int, mark: str) -> int:
        """Place of the first mark from ``at`` on that no backslash escapes, or -1."""
        found = s.find(mark, at)
        while found >= 0 and _Reader._whole(s, at, found) != found:
            found = s.find(mark, found + 1)
        return found

    @staticmethod
    def _whole(s: str, at: int, to: int) -> int:
        """``to``, or one less where that would part a backslash from what it escapes."""
        run = to
        while run > at and s[run - 1] == "\\":
            run -= 1
        return to - (to - run) % 2

    def add_loss(self, s: str) -> None:
        """A span may end between a backslash and what it escapes."""
        s = self.pending + s
        odd = (len(s) - len(s.rstrip("\\"))) % 2
        self.pending, s = s[len(s) - odd :], s[: len(s) - odd]
        plain = unescape(s)
        self.loss_chars += len(plain)
        self.loss.update(plain.encode())

    def row(self, conv) -> tuple:
        if self.buffer or self.pending or self.state:
            raise ValueError(f"conversation {conv}: {self.buffer[:80]!r} is no whole turn")
        return conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(parts: DataFrame) -> DataFrame:
    """Turns and masked text of what format_conversations() returns, digested. Keeps its partitions and order."""
    names = [x.split()[0] for x in READ.split(", ")]

    def run(batches):
        rows = []
        for conv, group in _conversations(batches, 4):
            reader = _Reader()
            for _, _, text, mask in group:
                reader.add(text, mask)
            rows.append(reader.row(conv))
            if len(rows) == 1000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=_READ)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=_READ)

    return parts.mapInArrow(run, READ)


_READ = pa.schema([(x.split()[0], pa.int64() if x.endswith("bigint") else pa.string()) for x in READ.split(", ")])


def oracle(said: str) -> str:
    """The rows of the query over ``conversations`` and conversation -7, in DuckDB SQL: digests of the turns as they are, without rendering."""
    escaped = lambda c, *more: functools.reduce(lambda x, m: f"replace({x}, '{m}', '\\{m}')", (*CONTROL, *more), f"replace({c}, '\\', '\\\\')")
    return f"""
    WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, 0, 'user', '{said}' UNION ALL SELECT -7, 1, 'assistant', '{said}'),
    t AS (SELECT *, coalesce(role, '') AS r, coalesce(text, '') AS x, coalesce(role = 'assistant', false) AS own FROM c)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)) AS turns_sha256,
      CAST(coalesce(sum(length(x)) FILTER (own), 0) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) FILTER (own), '')) AS loss_sha256,
      CAST(sum(length('### ') + length({escaped('r', ': ')}) + length(': ') + length({escaped('x')}) + length('</turn>') + 1) AS BIGINT) AS formatted_chars
    FROM t GROUP BY conv_id"""
