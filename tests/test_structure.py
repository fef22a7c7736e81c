import hashlib
import random

from pyspark.sql import functions as F

from docloom.operators import brackets, fields, language, sections, style

B = fields.BLOCKS


def blocks(spark, rows):
    """rows of (kind, text or rows)."""
    return spark.createDataFrame([(1, i, k, 1 if k == "heading" else None, None if k == "table" else t, t if k == "table" else None) for i, (k, t) in enumerate(rows)], B)


def all_hits(spark, rows):
    b = blocks(spark, rows)
    return b, [(r.block_index, r.start, r.end_block, r.kind, r.span_text) for r in brackets.hits(b, fields.fields(b)).orderBy("block_index", "cell_row", "cell_col", "start", "end").collect()]


def test_paragraphs(spark):
    docs = spark.createDataFrame([(1, "alpha\r\n\r\nbeta\r\ngamma\n \t\n\n  \n"), (2, ""), (3, "\n\n one \n"), (4, None)], "doc_id bigint, text string")
    got = [(r.doc_id, r.block_index, r.text) for r in fields.paragraphs(docs).orderBy("doc_id", "block_index").collect()]
    assert got == [(1, 0, "alpha"), (1, 1, "beta\ngamma"), (3, 0, " one ")]


def test_content_id(spark):
    got = {r.doc_id: r.content_id for r in fields.content_ids(blocks(spark, [("paragraph", "Hello")])).collect()}
    assert got == {1: "9558168f1073f326"}
    mixed = fields.content_ids(blocks(spark, [("heading", "T"), ("table", [["a", "é"], ["b"]])])).first().content_id
    raw = b"\x01\x01T\xff" + b"\x03a\x00" + "é".encode() + b"\x00\nb\x00\n\xff"
    assert mixed == hashlib.sha256(raw).hexdigest()[:16]


def test_neighbours(spark):
    b = blocks(spark, [("paragraph", "a"), ("table", [["h1", "h2"], ["r", "x"], ["s"]]), ("paragraph", "b"), ("heading", "c")])
    flow = {r.block_index: (r.above, r.below) for r in fields.flow_neighbours(b).collect()}
    assert flow[0] == (None, None) and flow[2] == (None, "c") and flow[3] == ("b", None)
    cells = {(r.cell_row, r.cell_col): (r.above, r.below, r.col_header, r.row_label) for r in fields.table_neighbours(b).collect()}
    assert cells[(1, 1)] == ("h2", None, "h2", "r") and cells[(0, 0)] == (None, "r", None, None) and cells[(2, 0)] == ("r", None, "h1", None)


def test_brackets_in_one_field(spark):
    cases = {
        "Pay [Buyer Name] today.": [(0, 4, 0, "paired", "[Buyer Name]")],
        "[a[b]": [(0, 0, 0, "lone_open", "[a[b]"), (0, 2, 0, "paired", "[b]")],
        "obligations of [ the seller\nnext line": [(0, 15, 0, "lone_open", "[ the seller")],
        "prev line\nthe seller ] owes": [(0, 10, 0, "lone_close", "the seller ]")],
        "[" + "x" * 118 + "]": [(0, 0, 0, "paired", "[" + "x" * 118 + "]")],
        "[" + "x" * 119 + "]": [(0, 0, 0, "paired_long", "[" + "x" * 119 + "]")],
    }
    for text, want in cases.items():
        assert all_hits(spark, [("paragraph", text)])[1] == want


def test_pairs_equal_a_stack(spark):
    r = random.Random(8)
    texts = ["".join(r.choice("[]a\n") for _ in range(r.randint(0, 25))) for _ in range(200)]
    df = spark.createDataFrame([(i, 0, None, None, t) for i, t in enumerate(texts)], "doc_id bigint, block_index int, cell_row int, cell_col int, text string")
    got = {i: set() for i in range(len(texts))}
    for x in brackets.field_hits(df).where("kind like 'paired%'").collect():
        got[x.doc_id].add((x.start, x.end))
    for i, t in enumerate(texts):
        stack, want = [], set()
        for at, c in enumerate(t):
            if c == "[":
                stack.append(at)
            elif c == "]" and stack:
                want.add((stack.pop(), at + 1))
        assert got[i] == want


def test_pairs_across_blocks(spark):
    _, got = all_hits(spark, [("paragraph", "If [the buyer"), ("table", [["x", "y"], ["z"]]), ("paragraph", "defaults] then")])
    assert got == [(0, 3, 2, "paired_cross_paragraph", "[the buyer\n\nx | y\nz\n\ndefaults]")]
    _, got = all_hits(spark, [("table", [["[a", "b]"]])])
    assert [k for *_, k, _ in got] == ["lone_open", "lone_close"]
    _, got = all_hits(spark, [("paragraph", "a] [b"), ("paragraph", "c] d]")])
    assert [(x[0], x[2], x[3]) for x in got] == [(0, 0, "lone_close"), (0, 1, "paired_cross_paragraph"), (1, 1, "lone_close")]


def test_sections_snippets_and_inventory(spark):
    rows = [("paragraph", "Intro [x]"), ("heading", "Payment"), ("paragraph", "Pay [Amount]."), ("paragraph", "Pay [Amount]."), ("heading", "End")]
    b, _ = all_hits(spark, rows)
    h = brackets.hits(b, fields.fields(b))
    got = {r.section: (r.heading, r.n_blocks, r.n_hits) for r in sections.sections(b, h).collect()}
    assert got == {0: (None, 1, 1), 1: ("Payment", 3, 2), 4: ("End", 1, 0)}
    s = sections.snippet_index(h, b)
    assert [(r.id, r.path) for r in s.orderBy("id").collect()] == [("S1", "snippets/intro-x.md"), ("S2", "snippets/pay-amount.md"), ("S3", "snippets/pay-amount-2.md")]
    md = sections.render(b, h, s).first().markdown
    assert "# Payment\n\nPay [Amount]." in md and "| S2 | `[Amount]` | paired | confident | [snippets/pay-amount.md](snippets/pay-amount.md) |" in md and "# End" not in md
    none = blocks(spark, [("paragraph", "plain")])
    empty = brackets.hits(none, fields.fields(none))
    assert "_No bracketed variables detected._" in sections.render(none, empty, sections.snippet_index(empty, none)).first().markdown


def test_slug_names_stay_unique(spark):
    rows = [("paragraph", t) for t in ("[a]", "[a] 2", "[a]", "]")]
    b, _ = all_hits(spark, rows)
    h = brackets.hits(b, fields.fields(b))
    assert [r.path for r in sections.snippet_index(h, b).orderBy("block_index").collect()] == ["snippets/a.md", "snippets/a-2.md", "snippets/a-3.md", "snippets/span.md"]


def test_windows_count_bytes(spark):
    text = "é" * 200 + "a@b.co" + "é" * 200
    df = spark.createDataFrame([(text, 200, 206)], "text string, s int, e int")
    got = df.select(fields.sentence_window(F.col("text"), F.col("s"), F.col("e")).alias("w"), fields.block_window(F.col("text"), F.col("s"), F.col("e")).alias("b")).first()
    assert got.w == "é" * 80 + "a@b.co" + "é" * 80 and got.b == text
    near = spark.createDataFrame([("One. Two a@b.co  now! Three", "a@b.co"), ("x", "y")], "text string, n string")
    assert [r.w for r in near.select(fields.first_window(F.col("text"), F.col("n")).alias("w")).collect()] == ["Two a@b.co now!", ""]


def test_table_markdown_fills_ragged_rows(spark):
    df = spark.createDataFrame([([["a|b", "c"], ["d"]],), ([],)], "rows array<array<string>>")
    assert [r.m for r in df.select(sections.table_markdown(F.col("rows")).alias("m")).collect()] == ["| a\\|b | c |\n| --- | --- |\n| d |  |\n\n", ""]


def test_languages(spark):
    texts = ["The buyer and the seller of this house have to pay for it", "Le vendeur et la maison est dans une rue avec les arbres", "zzz qqq xxx yyy www vvv uuu ttt", "short"]
    df = spark.createDataFrame([(1, i, None, None, t) for i, t in enumerate(texts)], "doc_id bigint, block_index int, cell_row int, cell_col int, text string")
    tagged = language.tag(df)
    assert [r.lang for r in tagged.orderBy("block_index").collect()] == ["en", "fr", None, None]
    full = language.filled(tagged).orderBy("block_index").collect()
    assert [(r.lang, round(r.confidence, 1)) for r in full][2:] == [("en", 0.0), ("en", 0.0)]
    assert language.dominant(tagged.where("block_index > 1")).first().dominant_lang == "und"
    assert {r.lang for r in language.filled(tagged, "fr").collect()} == {"fr"}
    o = spark.createDataFrame([(1, 0, None, None, "v")], "doc_id bigint, block_index int, cell_row int, cell_col int, value string")
    assert language.tag_occurrences(o, tagged).first().lang == "en"


S = "doc_id bigint, block_index int, kind string, level int, style_name string, font string, size_half_pt int, bold boolean, italic boolean, alignment string, indent_left int, num_id int, ilvl int, style_unresolved boolean, segments array<struct<text:string,bold:boolean>>"


def styled(spark, rows):
    base = {"kind": "paragraph", "level": None, "style_name": None, "font": None, "size_half_pt": None, "bold": False, "italic": False, "alignment": None, "indent_left": None, "num_id": None, "ilvl": None, "style_unresolved": False, "segments": []}
    return spark.createDataFrame([(1, i, *{**base, **r}.values()) for i, r in enumerate(rows)], S)


def test_style_notes_and_profile(spark):
    b = styled(spark, [{"font": "Arial", "size_half_pt": 24}, {"font": "Arial", "size_half_pt": 27}, {"font": "Times", "size_half_pt": 24}, {"style_unresolved": True, "font": "Arial"}])
    p = style.profile(b).first()
    assert (p.total_blocks, p.dominant_font, p.dominant_size) == (4, "Arial", 24)
    rel = {r.block_index: r.font_matches_doc_dominant for r in style.relative_features(b).collect()}
    assert rel == {0: True, 1: True, 2: False, 3: None}
    notes = {r.block_index: r.notes for r in style.deviation_notes(b).collect()}
    assert notes == {1: "size 13.5pt — 2 of 3 other body use 12pt", 2: "font Times — 3 of 3 other body use Arial"}


def test_positional_notes(spark):
    li = {"kind": "list_item", "num_id": 3}
    b = styled(spark, [{**li, "ilvl": 0}, {}, {**li, "ilvl": 2}, {**li, "ilvl": None}, {**li, "ilvl": 2}])
    got = {r.block_index: r.notes for r in style.positional_notes(b).collect()}
    assert got == {1: "paragraph interrupts list 3 (between two list items)", 4: "list level jumps 0→2"}


def test_style_chain_stops_at_cycles(spark):
    s = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "a"), (1, "d", "missing"), (1, "e", None)], "doc_id bigint, style_id string, based_on string")
    got = {}
    for r in style.resolve_chain(s).orderBy("distance").collect():
        got.setdefault(r.style_id, []).append(r.ancestor)
    assert got == {"a": ["a", "b", "c"], "b": ["b", "c", "a"], "c": ["c", "a", "b"], "d": ["d"], "e": ["e"]}


def test_segments_join_equal_runs(spark):
    runs = [(0, "a", True), (1, " ", False), (2, "b", True), (3, "", False), (4, "c", False)]
    df = spark.createDataFrame([(1, 0, i, t, (b,)) for i, t, b in runs], "doc_id bigint, block_index int, run_index int, text string, style struct<bold:boolean>")
    assert [(r.text, r.style.bold) for r in style.segments(df).orderBy("segment").collect()] == [("a b", True), ("c", False)]
