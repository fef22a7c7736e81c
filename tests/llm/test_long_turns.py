import hashlib
import random
import tracemalloc

import pytest

from docloom.llm import chat


def read(turns, part):
    """One conversation rendered, cut into parts anywhere and read back."""
    pieces = list(chat.compile_template(chat.TEMPLATE)(messages=[{"role": r, "text": t} for r, t in turns]))
    text, mask, at = "".join(p for p, _ in pieces), [], 0
    for p, on in pieces:
        if on:
            mask.append((at, at + len(p)))
        at += len(p)
    reader = chat._Reader()
    for lo in range(0, len(text), part):
        spans = [{"start": max(a, lo) - lo, "end": min(b, lo + part) - lo} for a, b in mask if a < lo + part and b > lo]
        reader.add(text[lo : lo + part], spans)
    return reader.row(1)


@pytest.mark.parametrize("part", [1, 2, 3, 7, 1000])
def test_parts_may_be_cut_anywhere(part):
    r = random.Random(part)
    bits = ["\\", "\\\\", "### ", "</turn>", "</turn>\n", "\n", ": ", ":", " ", "<", "é", "#", "a"]
    some = lambda n: "".join(r.choice(bits) for _ in range(r.randint(0, n)))
    for _ in range(60):
        turns = [(r.choice(["user", "assistant", some(4)]), some(12)) for _ in range(r.randint(1, 5))]
        loss = "".join(t for role, t in turns if role == "assistant")
        got = read(turns, part)
        assert got[1:5] == (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_memory_of_a_long_turn_stays_flat():
    reader, part = chat._Reader(), "some words \\\\ and </tur" * 2800
    reader.add("### assistant: ", [])
    tracemalloc.start()
    for _ in range(200):  # 12 million characters
        reader.add(part, [{"start": 0, "end": len(part)}])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    reader.add("</turn>\n", [])
    assert reader.row(1)[1] == 1 and peak < 4_000_000


def test_a_long_turn_is_written_in_parts(spark):
    text = "x\\" * 400_000
    df = spark.createDataFrame([(1, 0, "assistant", text)], "conv_id bigint, turn bigint, role string, text string")
    parts = chat.format_conversations(df)
    assert max(len(r.text) for r in parts.collect()) <= 2 * chat.PART_CHARS
    row = chat.read_back(parts).first()
    assert (row.loss_chars, row.loss_sha256) == (len(text), hashlib.sha256(text.encode()).hexdigest())


@pytest.mark.parametrize("text", ["no turn", "### user: cut off", "### user", "### user: x</turn>\nmore"])
def test_what_is_no_turn_is_refused(text):
    reader = chat._Reader()
    with pytest.raises(ValueError):
        reader.add(text, [])
        reader.row(1)


def render(source, **kw):
    return "".join(t for t, _ in chat.compile_template(source)(**kw))


def test_marks_and_remarks():
    assert render("a  {%- if true -%}  b  {%- endif -%}  c") == "abc"
    assert render("a  {{- 'b' -}}  c{# remark {{ x }} #}d {#- e -#} f") == "abcdf"
    assert render("{{ '}}' }}{{ \"%}\" }}{% if '%}' == x %}y{% endif %}", x="%}") == "}}%}y"
    assert render(" a {{ 'b' }} c ") == " a b c "


@pytest.mark.parametrize("bad", ["{{ 'a' + 1 }}", "{{ 1 < 'a' }}", "{{ 3 | length }}"])
def test_constants_without_a_value_are_template_errors(bad):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(bad)
