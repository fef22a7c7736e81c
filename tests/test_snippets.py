from docloom.operators import brackets, fields, sections
from tests.test_structure import blocks


def cut(spark, rows):
    b = blocks(spark, rows)
    f = fields.fields(b)
    h = brackets.hits(b, f)
    return b, h, sections.slices(f, h)


ROWS = [
    ("heading", "Terms"),
    ("paragraph", "write to a@x.com or [Name] at b@y.org"),
    ("paragraph", "c@z.net first [if the buyer d@w.io"),
    ("table", [["e@v.com", "cell"]]),
    ("heading", "between e@v.com"),
    ("paragraph", "whole f@u.com"),
    ("paragraph", "ends] here c@z.net"),
]


def test_each_range_counts_its_own_placeholders(spark):
    b, h, s = cut(spark, ROWS)
    files = {r.id: r for r in sections.snippet_documents(s, sections.snippet_index(h, b, s), "a.md").collect()}
    # Within a field placeholders are given out from the right.
    assert files["S1"].path == "snippets/write-to-redacted-email-002-or-name-at-redacted-em.md"
    assert files["S1"].markdown.split("---\n\n")[1] == "write to REDACTED_EMAIL_002 or [Name] at REDACTED_EMAIL_001\n\n"
    cross = files["S2"]
    assert cross.path.startswith("snippets/cross-paragraph/redacted-email-002-first") and "../../a.md" in cross.markdown and "blocks 2–6" in cross.markdown
    # The table is left out, but the value in its cell is numbered before the heading's.
    assert cross.markdown.split("---\n\n")[1] == "REDACTED_EMAIL_002 first [if the buyer REDACTED_EMAIL_001\n\n# between REDACTED_EMAIL_003\n\nwhole REDACTED_EMAIL_004\n\nends] here REDACTED_EMAIL_002\n\n"


def test_previews_join_paragraphs_between_the_outer_brackets(spark):
    b, h, s = cut(spark, ROWS)
    shown = {(r.block_index, r.end_block): r.span_text for r in sections.with_previews(h, s).collect()}
    assert shown[(1, 1)] == "[Name]"
    assert shown[(2, 6)] == "[if the buyer REDACTED_EMAIL_001 whole REDACTED_EMAIL_004 ends]"


def test_documents_without_brackets_or_rows(spark):
    for rows in ([("paragraph", "plain a@x.com")], []):
        b, h, s = cut(spark, rows)
        assert s.count() == 0 and sections.with_previews(h, s).count() == 0
        assert sections.snippet_documents(s, sections.snippet_index(h, b, s), "a.md").count() == 0
