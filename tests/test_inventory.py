import random
import re

import pytest
from pyspark.sql import functions as F

from docloom.operators import brackets, fields, inventory, sections
from docloom.plans import registry

SCHEMA = "doc_id bigint, block_index int, kind string, level int, text string, rows array<array<string>>"


def odd_blocks():
    """Documents of random brackets, tables, headings, line breaks, odd spaces, nulls and slugs that look suffixed."""
    r = random.Random(7)
    parts = ["[", "]", "[", "]", " ", "a", "pay", "-2", "b|c", "`", "\n", "   ", "\x1c", "　", "É", "word " * 9, "x" * 70, " " * 300, "2"]
    text = lambda: None if r.random() < 0.04 else "".join(r.choice(parts) for _ in range(r.randint(0, 9)))
    rows = []
    for doc in [*range(120), None]:
        for i in range(r.randint(1, 9)):
            kind = r.choice(["paragraph", "paragraph", "heading", "table", None] if r.random() < 0.2 else ["paragraph", "heading", "table"])
            level = r.choice([None, 0, 1, 3, 9]) if kind == "heading" else None
            cells = r.choice([None, [], [[]], *[[[text() for _ in range(r.randint(0, 3))] for _ in range(r.randint(1, 3))] for _ in range(4)]])
            rows.append((doc, 3 * i, kind, level, None if kind == "table" else text(), cells if kind == "table" else None))
    return rows


def test_one_pass_equals_the_operators_on_rows(spark):
    blocks = spark.createDataFrame(odd_blocks(), SCHEMA).repartition(3)
    f = fields.fields(blocks)
    places = brackets.places(f)
    want = sections.render(blocks, brackets.hits(blocks, f, places), sections.snippet_index(places, blocks))
    got = inventory.inventories(blocks).collect()
    assert sorted(map(str, got)) == sorted(map(str, want.collect())) and len(got) == 121


def test_cells_and_slugs_equal_the_expressions(spark):
    spaces = "".join(chr(c) for c in [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])
    texts = ["", " ", "-", "[É] pay—now", "a" * 49 + " b", "x" * 61, " " * 400 + "z" * 70, spaces + "a" + spaces + "b", "\x1c a \x1f", "`|`" * 30, *[f"a{c}{c}b{c}" for c in spaces]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("t", sections.display_cell(F.col("t")).alias("c"), sections.slug(F.col("t")).alias("s")).collect():
        assert (inventory.display_cell([r.t]), inventory.slug(r.t)) == (r.c, r.s)
        assert inventory.display_cell(list(r.t)) == r.c


def test_a_document_of_many_lone_brackets():
    """Each of 20,000 brackets reaches to the end of its line; no cell copies more than it shows."""
    made = inventory.markdown([(0, "paragraph", None, "[word " * 20_000, None), (1, "paragraph", None, "]" * 10_000, None)])
    assert made.count("\n| S1 | `[word [word") == 10_001 - 1 and made.count("paired (cross-paragraph)") == 10_000


def test_no_documents(spark):
    assert inventory.inventories(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("name", ["inventory_texts", "markdown_inventory"])
def test_texts_move_once(spark, tmp_path, name):
    """On rows of hits these queries settled two tables and joined texts to them: 35 exchanges and more."""
    docs = [(i, "One, two. Three\nfour, | five.\nsix") for i in range(50)]
    spark.createDataFrame(docs, "doc_id bigint, text string").repartition(spark.sparkContext.defaultParallelism).write.parquet(str(tmp_path / "documents.parquet"))
    df = registry.queries()[name](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    # Apart from dealing out few files: one exchange of blocks, one of documents without an id.
    assert len(re.findall(r"Exchange hashpartitioning\(doc_id", plan)) <= 4 and "Window" not in plan and "Join" not in plan
    assert df.count() == 50
