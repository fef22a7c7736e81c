import os
import random
import re

import duckdb
import pytest

from docloom.llm import chat, queries, secrets

SF = "/root/testdata/sf0.001"


def sql(con, name):
    got = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in got.description]
    return names, sorted(map(str, got.fetchall()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_conversations_equal_their_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    names, want = sql(con, "op6_chat_format")
    assert sorted(str(tuple(r[c] for c in names)) for r in queries.op6_chat_format(spark, SF).collect()) == want


def test_odd_conversations_equal_their_sql(spark, tmp_path):
    r = random.Random(8)
    bits = ["\\", "### ", "</turn>", ": ", "\n", "é", "a", "'"]
    rows = [(c, t, r.choice(["user", "assistant", "x: \\", None]), r.choice([None, "", "".join(r.choice(bits) for _ in range(9))]), "clash") for c in [None, *range(12)] for t in (0, 1, 1, 2, None)]
    schema = "conv_id bigint, turn bigint, role string, text string, n_turns string"
    spark.createDataFrame(rows + rows[:3], schema).repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    names, want = sql(con, "op6_chat_format")
    assert sorted(str(tuple(x[c] for c in names)) for x in queries.op6_chat_format(spark, str(tmp_path)).collect()) == want
    assert chat.CONTROL == ("### ", "</turn>")


def brute_markov(text, samples):
    """Spans of key-like runs by plain counts of neighbouring characters."""
    count = {}
    for s, y in samples:
        for a, b in zip(s, s[1:]):
            count[y, a, b] = count.get((y, a, b), 0) + 1
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
    import math

    total = {(y, a): sum(count.get((y, a, b), 0) + 0.5 for b in letters) + 0.5 for y in (0, 1) for a in letters}
    log = lambda y, a, b: math.log((count.get((y, a, b), 0) + 0.5) / total[y, a])
    out = []
    for m in re.finditer(r"(?<!\w)[A-Za-z0-9+/_=-]{20,}(?!\w)", text):
        pairs = list(zip(m[0], m[0][1:]))
        if sum(log(1, a, b) - log(0, a, b) for a, b in pairs) / len(pairs) > 0.35:
            out.append((m.start(), m.end()))
    return out


def test_model_spans_equal_brute_force():
    r, samples = random.Random(11), secrets.labelled_samples()
    keys = [s for s, _ in secrets.labelled_samples(120, seed=31)]
    texts = [" ".join(r.choice([r.choice(keys), "words", "é", "a_b", "x" * 30, "-" * 25, "http://h.example/path/to/some/page"]) + r.choice(["", ",", "é", "."]) for _ in range(30)) for _ in range(25)]
    for t in texts:
        assert [(s, e) for s, k, e, _ in secrets.spans(t) if k == 3] == brute_markov(t, samples)
