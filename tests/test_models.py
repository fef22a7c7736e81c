import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions import features
from docloom.operators import model, review
from docloom.sources import documents, logs
from docloom.streaming import logs as stream


def test_sigmoid_is_stable(spark):
    df = spark.createDataFrame([(x,) for x in (-800.0, -1.0, 0.0, 1.0, 800.0)], "z double")
    assert [r.p for r in df.select(model.sigmoid(F.col("z")).alias("p")).collect()] == pytest.approx([0, 1 / (1 + math.e), 0.5, math.e / (1 + math.e), 1])


def test_gradient_descent_equals_a_scalar_loop():
    r = np.random.default_rng(1)
    x, y = r.normal(size=(30, 3)), (r.random(30) < 0.3).astype(float)
    w, b = model.gradient_descent(x, y, iterations=20)
    v, c = [0.0] * 3, 0.0
    pos = y.sum()
    for _ in range(20):
        g, h = [0.0] * 3, 0.0
        for row, t in zip(x, y, strict=True):
            p = 1 / (1 + math.exp(-(sum(a * d for a, d in zip(v, row, strict=True)) + c)))
            e = (30 / (2 * pos) if t else 30 / (2 * (30 - pos))) * (p - t)
            g = [a + e * d for a, d in zip(g, row, strict=True)]
            h += e
        v = [a - 0.5 * (d / 30 + 0.01 * a) for a, d in zip(v, g, strict=True)]
        c -= 0.5 * h / 30
    assert w == pytest.approx(v) and b == pytest.approx(c)


def _rows(spark, n=60):
    r = random.Random(2)
    data = []
    for i in range(n):
        y = int(r.random() < 0.3)
        data.append(("t", i, [y + r.gauss(0, 0.4), r.gauss(0, 1), 1.0], y, ("a" if i % 2 else "b") if y else None))
    return spark.createDataFrame(data, "task string, seq bigint, features array<double>, label int, reason string")


def test_training_scores_and_suggestions(spark):
    rows = _rows(spark)
    models, tuned, heads = model.train(rows)
    scored = model.score(rows.withColumn("fold", F.lit(0)), models)
    got = model.suggestions(scored, model.multiclass(rows, heads), tuned).join(rows.select("seq", "label"), "seq").collect()
    assert sum(r.predicted == bool(r.label) for r in got) >= 48
    assert all(r.predicted_reason in ("a", "b", None) for r in got) and any(r.predicted_reason for r in got)
    assert all(r.predicted_reason is None for r in got if not r.predicted)


def test_one_class_is_not_trained(spark):
    models, tuned, _ = model.train(_rows(spark).where("label = 0"))
    assert models.count() == 0 and tuned.count() == 0


def test_thresholds_equal_brute_force(spark):
    r = random.Random(5)
    for _ in range(4):
        rows = [("t", i, int(r.random() < 0.4), round(r.random(), 1)) for i in range(25)]
        got = model.thresholds(spark.createDataFrame(rows, "task string, seq bigint, label int, proba double")).first()
        pos, neg = [p for *_, y, p in rows if y], [p for *_, y, p in rows if not y]
        acc = lambda t: (sum(p >= t for p in pos) / len(pos) + sum(p < t for p in neg) / len(neg)) / 2
        options = list(dict.fromkeys([p for *_, p in rows] + [0.5]))
        best = max(map(acc, options))
        tied = [t for t in options if acc(t) >= best - 1e-12]
        assert got.accuracy == pytest.approx(best)
        assert abs(got.threshold - 0.5) == pytest.approx(min(abs(t - 0.5) for t in tied))


def test_folds_are_stratified(spark):
    rows = spark.createDataFrame([("t", i, int(i % 5 == 0)) for i in range(20)], "task string, seq bigint, label int")
    got = model.folds(rows).collect()
    assert {r.k for r in got} == {4} and sorted(r.fold for r in got if r.label) == [0, 1, 2, 3]


def test_meter_needs_enough_rows(spark):
    log = [("t", i, i % 4 == 0, i % 5 == 0, None, None) for i in range(130)]
    df = spark.createDataFrame(log, "task string, seq bigint, predicted boolean, actual boolean, predicted_reason string, actual_reason string")
    got = model.meter(df).withColumn("text", model.meter_text()).first()
    assert got["rows"] == 100 and got.balanced_accuracy is not None and "balanced accuracy" in got.text
    few = model.meter(df.where("seq < 50")).withColumn("text", model.meter_text()).first()
    assert few.balanced_accuracy is None and "not enough" in few.text


def test_censor_vector(spark):
    row = [("EMAIL", "regex:email", ["paragraph"], "group", None, ["en"], 2, (None, None, None, None), "jane@acme.com")]
    df = spark.createDataFrame(row, "detected_type string, method string, block_kinds array<string>, scope string, heading_level int, langs array<string>, occurrences int, neighbors struct<above:string,below:string,col_header:string,row_label:string>, value string")
    v = df.select(features.censor_features().alias("f")).first().f
    assert len(v) == features.CENSOR_WIDTH and [i for i, x in enumerate(v) if x] == [9, 15, 19, 29, 32, 33, 38, 42, 43, 44]
    assert v[32] == 0.04 and v[33] == 0.25 and v[38] == 13 / 200


def test_reason_and_keys(spark):
    df = spark.createDataFrame([("1",), ("5",), ("6",), ("x",)], "k string")
    got = df.select(review.category_for_key(F.col("k")).alias("c"), review.retype_label(F.col("k")).alias("t"), features.reason_index(F.lit("other")).alias("i")).collect()
    assert [r.c for r in got] == ["fake-number", "other", None, None] and got[0].t == "PERSON" and got[3].t is None and got[0].i == 4


def test_allowed_values_are_per_type(spark):
    store = spark.createDataFrame([("a", "X", 1, 0), ("b", "X", 1, 1), ("c", "X", 0, 1), ("d", "X", 1, 0), ("d", "Y", 0, 3)], "value string, type string, allow bigint, deny bigint")
    assert sorted(r.value for r in review.allowed_values(store).collect()) == ["a", "d"]


def test_logs_read_old_bad_and_missing_lines(spark, tmp_path):
    good = {"schema": 2, "timestamp": 1, "source": "s", "value": "v", "shown_context": "c", "block_context": "b", "unknown": 3}
    (tmp_path / "log.jsonl").write_text(json.dumps(good) + "\n{broken\n" + json.dumps({"schema": 6, "value": "x"}) + "\n")
    rows = logs.read_log(spark, str(tmp_path / "log.jsonl")).collect()
    assert len(rows) == 1 and rows[0].method == "" and rows[0].occurrences == 0 and rows[0].langs == [] and rows[0].final_type is None
    assert logs.read_log(spark, str(tmp_path / "none")).count() == 0


def test_artifacts_and_store_round_trip(spark, tmp_path):
    path = str(tmp_path / "m" / "model.json")
    assert logs.load_artifact(path) is None
    logs.save_artifact({"w": [1.0]}, path)
    assert logs.load_artifact(path) == {"w": [1.0]} and logs.load_artifact(path, version=2) is None
    store = spark.createDataFrame([("a", "X", 1, 0)], logs.STORE)
    logs.save_store(store, str(tmp_path / "store"))
    assert logs.load_store(spark, str(tmp_path / "store")).collect() == store.collect()
    with pytest.raises(FileExistsError):
        logs.ensure_writable(spark, [str(tmp_path / "none"), str(tmp_path / "store")])


def test_streaming_tally_counts_once(spark, tmp_path):
    log, store, check = (str(tmp_path / n) for n in ("log", "store", "check"))
    rows = [{"value": "a", "detected_type": "X", "verdict": "reject"}, {"value": "a", "detected_type": "X", "verdict": "confirm"}]
    for _ in range(2):
        spark.createDataFrame(rows).write.mode("append").json(log)
        stream.run_tally(spark, log, store, check).awaitTermination(60)
    assert [tuple(r) for r in stream.latest(spark, store).collect()] == [("a", "X", 2, 2)]


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def _docx(path, body):
    import zipfile

    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")


def test_docx_blocks_and_pages(spark, tmp_path):
    p = lambda t, props="": f"<w:p><w:pPr>{props}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>"
    _docx(tmp_path / "a.docx", p("Title", '<w:pStyle w:val="Heading2"/>') + p(" ") + '<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br w:type="page"/></w:r></w:p>'
          + p("item", '<w:numPr><w:ilvl w:val="1"/><w:numId w:val="3"/></w:numPr>') + f"<w:tbl><w:tr><w:tc>{p('x')}{p('y')}</w:tc><w:tc>{p('z')}</w:tc></w:tr></w:tbl>" + p("last", "<w:pageBreakBefore/>"))
    rows = documents.read_docx(spark, str(tmp_path)).orderBy("block_index").collect()
    assert [(r.kind, r.level, r.text, r.page) for r in rows] == [("heading", 2, "Title", 1), ("paragraph", None, "a\tb\n", 1), ("list_item", None, "item", 2), ("table", None, None, 2), ("paragraph", None, "last", 3)]
    assert rows[3].rows == [["x\ny", "z"]] and (rows[2].num_id, rows[2].ilvl) == (3, 1)
    documents.check_pages(documents.read_docx(spark, str(tmp_path)), [(1, 3)])
    with pytest.raises(ValueError):
        documents.check_pages(documents.read_docx(spark, str(tmp_path)), [(4, 4)])


def test_specs(spark, tmp_path):
    assert documents.parse_pages("2-3,5") == [(2, 3), (5, 5)]
    for bad in ("0", "3-2", "", "a", "1,,2"):
        with pytest.raises(ValueError):
            documents.parse_pages(bad)
    (tmp_path / "p").write_text("Acme, Bo\nCy")
    assert documents.parse_parties("a, b,") == ["a", "b"] and documents.parse_parties(f"@{tmp_path}/p") == ["Acme", "Bo", "Cy"]
    (tmp_path / "x.TXT").write_text("one\n\ntwo")
    assert [r.text for r in documents.read_text(spark, str(tmp_path / "x.TXT")).orderBy("block_index").collect()] == ["one", "two"]
    paths = spark.createDataFrame([("a/x.TXT",), ("b.docx",)], "path string")
    assert [r.format for r in documents.checked(paths).collect()] == ["txt", "docx"]
    with pytest.raises(Exception, match="unsupported"):
        documents.checked(spark.createDataFrame([("x.pdf",)], "path string")).collect()
