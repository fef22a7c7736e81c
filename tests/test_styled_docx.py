import zipfile

from docloom.operators import style
from docloom.sources import documents, styled

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
STYLES = """
<w:docDefaults><w:rPrDefault><w:rPr><w:rFonts w:ascii="Calibri"/><w:sz w:val="22"/></w:rPr></w:rPrDefault><w:pPrDefault><w:pPr><w:jc w:val="right"/></w:pPr></w:pPrDefault></w:docDefaults>
<w:style w:type="paragraph" w:styleId="Base"><w:pPr><w:jc w:val="both"/><w:ind w:left="720" w:hanging="360"/><w:spacing w:after="120"/></w:pPr><w:rPr><w:b/><w:color w:val="FF0000"/></w:rPr></w:style>
<w:style w:type="paragraph" w:styleId="Heading2"><w:basedOn w:val="Base"/><w:pPr><w:jc w:val="left"/></w:pPr><w:rPr><w:rFonts w:ascii="Arial"/></w:rPr></w:style>
<w:style w:type="character" w:styleId="Loud"><w:rPr><w:b w:val="0"/><w:caps/><w:spacing w:val="20"/></w:rPr></w:style>
<w:style w:type="paragraph" w:styleId="Orphan"><w:basedOn w:val="Gone"/></w:style>
<w:style w:type="paragraph" w:styleId="A"><w:basedOn w:val="B"/><w:rPr><w:sz w:val="30"/></w:rPr></w:style>
<w:style w:type="paragraph" w:styleId="B"><w:basedOn w:val="A"/><w:rPr><w:sz w:val="40"/><w:i/></w:rPr></w:style>"""
LISTS = """
<w:abstractNum w:abstractNumId="5"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/><w:lvlText w:val="•"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="decimal"/><w:lvlText w:val="%2."/></w:lvl></w:abstractNum>
<w:num w:numId="1"><w:abstractNumId w:val="5"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="9"/></w:num>"""


def r(text, props=""):
    return f'<w:r><w:rPr>{props}</w:rPr><w:t xml:space="preserve">{text}</w:t></w:r>'


def p(props, *runs):
    return f"<w:p><w:pPr>{props}</w:pPr>{''.join(runs)}</w:p>"


def of(name):
    return f'<w:pStyle w:val="{name}"/>'


def listed(num, level):
    return f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{num}"/></w:numPr>'


def docx(path, body, styles=STYLES, lists=LISTS):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        if styles is not None:
            z.writestr("word/styles.xml", f"<w:styles {W}>{styles}</w:styles>")
        if lists is not None:
            z.writestr("word/numbering.xml", f"<w:numbering {W}>{lists}</w:numbering>")


def read(spark, path):
    return styled.read_styled(spark, str(path)).orderBy("path", "block_index").collect()


def test_properties_come_from_the_nearest_layer(spark, tmp_path):
    docx(tmp_path / "a.docx", p(of("Heading2"), r("Head")) + p("", r("plain")) + p(of("Base") + '<w:ind w:left="100"/>', r("own", '<w:sz w:val="18"/><w:b w:val="false"/>'))
         + p(of("A"), r("loop")) + p(of("B"), r("pool")))
    head, plain, own, loop, pool = read(spark, tmp_path)
    assert (head.kind, head.level, head.font, head.size_half_pt, head.bold, head.color, head.alignment, head.indent_left, head.indent_hanging, head.space_after) == ("heading", 2, "Arial", 22, True, "FF0000", "left", 720, 360, 120)
    assert (plain.font, plain.size_half_pt, plain.bold, plain.alignment, plain.style_unresolved) == ("Calibri", 22, None, None, False)  # defaults of paragraphs are not folded in
    assert (own.size_half_pt, own.bold, own.color, own.alignment, own.indent_left, own.indent_hanging) == (18, False, "FF0000", "both", 100, 360)
    assert [(x.size_half_pt, x.italic, x.style_unresolved) for x in (loop, pool)] == [(30, True, False), (40, True, False)]


def test_segments_follow_character_styles(spark, tmp_path):
    loud = '<w:rStyle w:val="Loud"/>'
    docx(tmp_path / "a.docx", p(of("Base"), r(""), r("ab", "<w:b/>"), r("  ", loud), r("cd"), r("loud!", loud), r(" ")))
    (row,) = read(spark, tmp_path)
    assert [(s.text, s.style.bold, s.style.caps, s.style.char_spacing) for s in row.segments] == [("ab  cd", True, None, None), ("loud! ", False, True, 20)]
    assert row.text == "ab  cdloud! " and row.bold is True  # of equally long ones the first


def test_lists_tables_pages_and_missing_entries(spark, tmp_path):
    cells = f"<w:tbl><w:tr><w:tc>{p('', r('x'))}{p('', r(' '))}{p('', r('y'))}</w:tc><w:tc>{p(of('Heading1'), r('z'))}{p(listed(1, 0), r('q'))}</w:tc></w:tr></w:tbl>"
    broken = '<w:r><w:br w:type="page"/><w:br w:type="page"/></w:r>'
    docx(tmp_path / "a.docx", p(listed(1, 1), r("one")) + p(listed(2, 0), r("two")) + p(listed(1, 7), r("three")) + p(of("Nope"), r("four")) + p(of("Orphan"), r("five")) + p("", broken) + cells)
    rows = read(spark, tmp_path)
    assert [(x.kind, x.number_kind, x.level_text, x.numbering_unresolved) for x in rows[:3]] == [("list_item", "decimal", "%2.", False), ("list_item", None, None, True), ("list_item", None, None, True)]
    assert [x.style_unresolved for x in rows[:5]] == [False, False, False, True, True]
    assert [(x.block_index, x.text, x.kind, x.in_table, x.page) for x in rows[5:]] == [(5, "x", "table_cell", True, 2), (6, "y", "table_cell", True, 2), (7, "z", "heading", True, 2), (8, "q", "list_item", True, 2)]
    assert documents.read_docx(spark, str(tmp_path)).agg({"page": "max"}).first()[0] == 2


def test_no_sheet_empty_body_and_the_style_operators(spark, tmp_path):
    docx(tmp_path / "a.docx", p(of("Base"), r("alone")), None, None)
    docx(tmp_path / "b.docx", "")
    docx(tmp_path / "c.docx", "".join(p(of("Base"), r(f"t{i}")) for i in range(4)) + p(of("Base"), r("odd ", '<w:rFonts w:ascii="Arial"/>'), r("one", '<w:b w:val="0"/>')))
    rows = read(spark, tmp_path)
    assert len(rows) == 6 and rows[0].style_unresolved and rows[0].font is None
    blocks = styled.read_styled(spark, str(tmp_path / "c.docx"))
    notes = {x.block_index: x.notes for x in style.deviation_notes(blocks).collect()}
    assert notes[4] == "font Arial — 4 of 4 other body use Calibri; 1 of 2 segments bold"
    lines = {x.block_index: x.lines for x in style.review_lines(blocks).collect()}
    assert lines[0] == '   indent: left 0.5", hanging 0.25"\n   style: Base → Calibri, 11pt, bold'
    assert style.profile(blocks).first().dominant_font == "Calibri" and style.relative_features(blocks).count() == 5
