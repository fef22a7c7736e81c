import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from docloom.llm import bpe, chat, packing, quality_knn, quality_rules, secrets, toxicity, warc

DOC = "doc_id bigint, text string, n_words string, source string"
TEXTS = [
    None, "", " ", "one", "a b c a b c", "Don't we'll 12½ Straße ŒUVRE  \t x\n\n y", "日本語 ok \x1c x", "zqxj" * 300, "a" * 2000, "x   y z", "é" * 40 + "1" * 30,
    "The of and. " * 30, "Same line here\n" * 12, "same same same " * 25, "plain words " + " ".join(f"w{i}" for i in range(80)), "<|endoftext|> hi",
]


def frame(spark, texts=TEXTS):
    rows = [(i, t, "clash", None) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[4], (None, "a null id", None, None)], DOC).repartition(3)


# Byte-level BPE


def test_bpe_equals_the_public_library(spark):
    df = frame(spark)
    want = dict(enumerate(bpe.reference_digest(bpe.default_ranks(), TEXTS)))
    rows = bpe.decode(bpe.encode(df)).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        if r.doc_id is not None:
            assert (len(r.ids) // 4, hashlib.sha256(r.ids).hexdigest()) == want[r.doc_id]
            assert bytes(r.bytes) == (TEXTS[r.doc_id] or "").encode()
    assert sorted(map(str, rows)) == sorted(map(str, bpe.round_trip(df).collect()))
    assert bpe.encode(df.limit(0)).count() == 0


def test_bpe_caches_do_not_change_results(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 3)
    r = random.Random(1)
    texts = [" ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 12))) for _ in range(20)) for _ in range(12)]
    c = bpe.ByteBpe(bpe.default_ranks())
    got = [x for t in texts for x in c.encode([t])]
    assert [(len(x) // 4, hashlib.sha256(x).hexdigest()) for x in got] == bpe.reference_digest(bpe.default_ranks(), texts)
    assert [b.decode() for b in c.decode(got, rows=7)] == texts


# Packing


def test_pieces_cover_every_id_once(spark):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(packing.default_tokenizer())
    tk.encode_special_tokens = True
    texts = [*TEXTS, "word and more. " * 3000]
    ids = [np.array(tk.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for t in texts]
    df = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], DOC).repartition(2)
    rows = packing.pack(df).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert (r.ids_crc32, r.doc_tokens) == (zlib.crc32(part.tobytes()), len(ids[r.doc_id]))
    for i, x in enumerate(ids):
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(x)
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW
    assert packing.pack(df.limit(0)).count() == 0


def test_cuts_equal_a_plain_search():
    r = random.Random(3)
    for _ in range(40):
        n = r.randint(2, 40)
        ends = np.cumsum([r.randint(1, 9) for _ in range(n)])
        cost = np.array([r.choice([0, 1, 4]) for _ in range(n)])
        window = 12
        c, pen = [0, *ends.tolist()], [0, *cost.tolist()]
        f = [0.0] + [float("inf")] * n
        for j in range(1, n + 1):
            f[j] = pen[j] + min(f[i] + window - (c[j] - c[i]) for i in range(j) if c[j] - c[i] <= window)
        got = packing.cuts(ends, cost, 0, window, True)
        total, at = 0.0, 0
        for e in got[:-1]:
            total += window - (e - at) + pen[c.index(e)]
            at = e
        best = min(f[i] + c[i] for i in range(n) if c[n] - c[i] <= window)
        assert c[n] - at <= window and total + at == best


def test_settling_early_keeps_order_and_memory_small():
    ends = np.zeros(50, bool)
    ends[7] = True
    p = packing.Packer(ends, window=64, segment=256)
    r, rows, docs = np.random.default_rng(2), [], []
    for i in range(120):
        docs.append(r.integers(0, 50, r.integers(1, 60)).astype("<u4"))
        rows += p.add(i, docs[-1])
        assert len(p.docs) < 300
    rows += p.settle(True)
    joined = {}
    for d, start, length, *_ in rows:
        joined.setdefault(d, []).append(docs[d][start : start + length])
    assert all(np.array_equal(np.concatenate(joined[i]), docs[i]) for i in range(120))
    sizes = Counter()
    for x in rows:
        sizes[x[5]] += x[2]
    pad = sum(64 - s for s in sizes.values() if s & (s - 1))
    assert max(sizes.values()) <= 64 and pad < 0.2 * sum(map(len, docs))


# Chat formatting

TURNS = "conv_id bigint, turn bigint, role string, text string, part string"


def brute_chat(rows):
    out = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {c: (len(t), digest("".join(f"{r}\n{x}\n" for r, x in t)), sum(len(x) for r, x in t if r == "assistant"), digest("".join(x for r, x in t if r == "assistant"))) for c, t in out.items()}


@pytest.mark.parametrize("part", [7, 1 << 16])
def test_chat_round_trip(spark, monkeypatch, part):
    r = random.Random(5)
    bits = ["\\", "### ", "</turn>", "\n", "a", ": ", "é", "</turn>\n", "\\### Assistant: </turn> ok", "{{ x }}", ""]
    rows = [(c, i, r.choice(["user", "assistant", "system", "od: d\\"]), "".join(r.choice(bits) for _ in range(r.randint(0, 8)))) for c in range(25) for i in range(r.randint(1, 9))]
    rows += [(None, 0, "user", None), (-7, 0, None, "x"), (-7, 1, "assistant", "y"), (-7, 1, "assistant", "y")]
    df = spark.createDataFrame([(*x, "clash") for x in rows], TURNS).repartition(3)
    parts = chat.format_conversations(df)
    got = {x.conv_id: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) for x in chat.read_back(parts).collect()}
    assert got == brute_chat(rows)
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_long_conversations_come_in_parts(spark):
    df = spark.createDataFrame([(1, i, "assistant", "x" * 30_000) for i in range(8)], "conv_id bigint, turn bigint, role string, text string")
    rows = chat.format_conversations(df).collect()
    assert len(rows) > 2 and max(len(r.text) for r in rows) < chat.PART_CHARS + 40_000
    assert chat.read_back(chat.format_conversations(df)).first().loss_chars == 240_000


def render(source, **kw):
    return "".join(t for t, _ in chat.compile_template(source)(**kw))


def test_template_language():
    assert render("{% for m in xs %}{{ loop.index }}{% if loop.last %}!{% elif loop.first %}?{% else %},{% endif %}{{ m.a | upper }}{% endfor %}", xs=[{"a": "x"}, {"a": "y"}, {"a": "z"}]) == "1?X2,Y3!Z"
    assert render("{% set a = 'b' + 'c' %}{{ a | title }}{{ none | default('d') }}{{ 'é' in 'né' }}{{ m['k'] }}", m={"k": 1}) == "BcdTrue1"
    assert render("{{ not (1 == 2) and 3 }}{{ x.y.z }}") == "3"
    folded = chat.fold(chat.parse("a{{ 'b' + 'c' | upper }}{% if 1 < 2 %}d{% else %}{{ e }}{% endif %}"))
    assert folded == (chat.Output(chat.Const("abCd")),)
    assert list(chat.compile_template("a{% generation %}{{ x }}{% endgeneration %}b")(x="y")) == [("a", False), ("y", True), ("b", False)]


@pytest.mark.parametrize("bad", ["{{ x.__class__ }}", "{{ f(1) }}", "{{ x | eval }}", "{% import os %}", "{% for x in y %}", "{{ 1 + }}", "{% endif %}", "{{ 'a' ~ }}"])
def test_templates_cannot_leave_the_sandbox(bad):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(bad)


def test_objects_have_no_attributes_in_templates():
    assert render("{{ x.real }}", x=3) == ""


# Secrets


def test_base_patterns_and_model_spans(spark):
    key = "Zk8Qp2vXw9Lm4Rt7Yc1Nb6Hd3Jf5Gs0A"
    texts = [None, "", f"password: {key}", 'TOKEN = "abc"; secret=12345', "AKIA" + "Z9" * 9 + " AKIA12", "id " + "0f" * 12 + " " + "ab" * 11, "secret: token: abcdefgh",
             f"é AWS {key} and some_ordinary_identifier_name handleRequestContextError", "toſken=abcdefgh api-key=abcdefgh api_key='abcdefgh'", "token=aaaaaaa token=bbbbbbb " * 3]
    df = frame(spark, texts)
    rows = {r.doc_id: r for r in secrets.digest(secrets.scan(df)).collect()}
    assign = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for i, t in enumerate(texts):
        t = t or ""
        a = [m for m in assign.finditer(t) if len(m[2]) >= 6]
        b = [m for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        c = [m for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
        assert (rows[i].n_assign, rows[i].n_access, rows[i].n_hex) == (len(a), len(b), len(c))
        spans = sorted((m.start(), k, m.end()) for k, ms in enumerate((a, b, c)) for m in ms)
        assert rows[i].base_sha256 == hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
    assert rows[7].spans == "markov:6:38" and "markov" in rows[2].spans
    assert secrets.scan(df.limit(0)).count() == 0
    clean = secrets.redacted(df).collect()
    assert [r.text for r in clean if r.doc_id == 2] == ["password: [SECRET]"] and clean[0].asDict().keys() == {"doc_id", "text", "n_words", "source"}


def test_markov_ratio_parts_held_out_samples():
    m = secrets.train(secrets.labelled_samples(seed=7))
    held = secrets.labelled_samples(600, seed=99)
    wrong = [(s, y) for s, y in held if (m.score(s) > m.threshold) != bool(y)]
    assert len(wrong) < 0.03 * len(held) and not any(y == 0 for _, y in wrong)


def test_redaction_joins_overlaps():
    assert secrets.redact("abcdefgh", [(0, 0, 5, 2), (3, 2, 7, 3)]) == "ab[SECRET]h" and secrets.redact(None, []) is None


# Quality rules


def brute_rules(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(zip(words, words[1:], words[2:]))
    marked = {j for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    base = (len(words), sum(map(len, words)), sum(map(t.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(marked))
    return (*base, len(words) < 50 or 100 * len(marked) > 50 * len(words))


def test_rules_equal_brute_force(spark):
    r = random.Random(4)
    more = [" ".join(r.choice([f"w{i}" for i in range(12)]) for _ in range(r.randint(40, 300))) for _ in range(20)]
    passage = [f"p{i}" for i in range(120)]
    more += [" ".join(passage + [f"q{i}" for i in range(500)] + passage), "the of " + "x y z ###\n" * 60, " ".join(f"u{i} the" for i in range(200))]
    texts = TEXTS + more
    df = frame(spark, texts)
    rows = {x.doc_id: x for x in quality_rules.judge(df).collect()}
    for i, t in enumerate(texts):
        x = rows[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == brute_rules(t), i
        assert not (x.base_failed and x.kept)
    assert rows[len(texts) - 1].kept and not rows[len(texts) - 2].kept
    kept = quality_rules.keep(df)
    assert kept.columns == df.columns and sorted(x.doc_id for x in kept.collect() if x.doc_id is not None) == [i for i in range(len(texts)) if rows[i].kept]
    assert quality_rules.judge(df.limit(0)).count() == 0 and quality_rules.keep(df.limit(0)).count() == 0


def test_rules_run_without_python(spark):
    plan = quality_rules.keep(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Classifiers


def corpus(n=400, seed=2):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in "the of and ing tion er ou sh".split() for b in "st re nd ha en".split()]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(60, 160))]
        quality, toxic = int(r.random() < 0.8), int(r.random() < 0.2)
        if not quality:
            w = [x + "$$$" for x in w] if i % 2 else [x.upper() + "!!" for x in w]
        if toxic:
            for x in r.sample(["idiotic", "moronic", "scumlike", "trashy", "clownish"], r.randint(1, 5)):
                w[r.randrange(len(w))] = x
        docs.append((i, " ".join(w), "clash", None))
        labels.append((i, quality, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def labelled(spark):
    docs, labels = corpus()
    edge = [(1000, None, None, None), (1001, "", None, None), (None, "idiotic text", None, None), (1002, "x" * 50_000, None, None)]
    return spark.createDataFrame(docs + edge + [docs[0]], DOC).repartition(3), spark.createDataFrame([*labels, (5000, 1, 0), (1000, None, None)], "doc_id bigint, quality int, toxic int"), labels


def test_quality_votes_on_held_out_rows(labelled):
    df, labels, known = labelled
    rows = {r.doc_id: r for r in quality_knn.classify(df, labels).collect()}
    assert len(rows) == 404 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items() if i is not None)
    held = [(rows[i].predicted, q) for i, q, _ in known if rows[i].held_out]
    assert sum(p == q for p, q in held) > 0.95 * len(held)
    again = {r.doc_id: r.score for r in quality_knn.classify(df, labels).collect()}
    assert again == {i: r.score for i, r in rows.items()}


def test_quality_without_labels(labelled):
    df, labels, _ = labelled
    assert {r.score for r in quality_knn.classify(df, labels.limit(0)).collect()} == {0.5}
    assert quality_knn.classify(df.limit(0), labels).count() == 0


def test_toxicity_grades_and_stage(labelled):
    df, labels, known = labelled
    m = toxicity.train(df, labels)
    assert list(m.thresholds) == sorted(m.thresholds)
    rows = {r.doc_id: r for r in toxicity.score(df, m).collect()}
    assert all(rows[i].toxic == bool(t) for i, _, t in known)
    assert rows[None].toxic and not rows[1000].toxic and not rows[1001].toxic and 0 <= rows[1002].severity <= toxicity.GRADES
    few, many = toxicity.Scorer(m)("theof idiotic"), toxicity.Scorer(m)("idiotic moronic scumlike trashy clownish")
    assert many[0] > few[0]
    kept = toxicity.keep(df, m)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if not r.toxic}


def test_toxicity_without_both_labels(labelled):
    df, labels, _ = labelled
    m = toxicity.train(df, labels.where("toxic = 0"))
    assert not any(r.toxic or r.severity for r in toxicity.score(df, m).collect())
    assert toxicity.score(df.limit(0), m).count() == 0


# WARC


def pages(spark, n=700):
    rows = [(i, f"http://h/{i}", f"<p>{i} é</p>", "clash") for i in range(n)]
    rows += [(None, None, None, None), (5, "http://h/5", "<p>again</p>", ""), (6, "http://h/6", "<p>6 é</p>", "")]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, digest string").repartition(4)


def test_audit_finds_damage_loss_and_additions(spark):
    from pyspark.sql import functions as F

    one = pages(spark)
    other = warc.planted(one).where("page_id is null or page_id <> 699")
    other = other.withColumn("html", F.when(F.col("page_id") == 400, "longer than it was").otherwise(F.col("html")))
    other = other.unionByName(spark.createDataFrame([(2000, "u", "new")], "page_id bigint, url string, html string"))
    rows = warc.report(warc.records(one, "a").unionByName(warc.records(other, "b")), "a", "b").collect()
    by = {}
    for r in rows:
        by.setdefault(r.status, set()).add(r.page_id)
    assert by["damaged"] == {i for i in range(700) if i % 97 == 5} | {400} and by["missing"] == {699} and by["extra"] == {2000}
    assert by["moved"] == {i for i in range(401, 512) if i % 97 != 5}
    assert len(rows) == 704


def test_audit_of_equal_and_empty_replicas(spark):
    one = pages(spark, 40)
    both = warc.records(one, "a").unionByName(warc.records(one, "b"))
    assert {r.status for r in warc.report(both, "a", "b").collect()} == {"intact"}
    assert warc.report(both.limit(0), "a", "b").count() == 0


def test_files_read_back(spark, tmp_path):
    one = pages(spark, 30).where("page_id is not null").coalesce(2)
    warc.write(one, str(tmp_path / "w"))
    got = sorted((r.url, r.html) for r in warc.read(spark, str(tmp_path / "w" / "part-*")).collect())
    assert got == sorted((r.url, r.html) for r in one.collect())
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.0\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n"))
