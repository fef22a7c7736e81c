import numpy as np

from docloom.llm import quality_knn, toxicity


def test_quality_features_count_all_of_a_long_word():
    base = "x" * 64
    a, b = (quality_knn.Features().row(base + tail * 40) for tail in ("Ab1=", "中文字。"))
    assert (a != b).any()
    f = quality_knn.Features()
    f.row("short words first")
    assert np.array_equal(f.row(base + "Ab1=" * 40), a) and max(map(len, f.cache)) <= 64


def test_toxicity_features_count_all_of_a_long_run():
    a, b = ({c for w in toxicity.words("x" * 64 + tail) for c in toxicity.codes(w)} for tail in ("clean" * 20, "marker" * 20))
    assert a - b and b - a
