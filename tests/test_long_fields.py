import re
import time

import pytest
from pyspark.sql import functions as F

from docloom.functions import spans


def found(spark, text, pattern):
    df = spark.createDataFrame([(text,)], "text string")
    return [(r.start, r.end, r.value) for r in df.select(F.expr(spans.matches_sql("text", pattern)).alias("s")).first().s]


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 511, 512, 513, 3000])
def test_offsets_across_parts(spark, n):
    text = "".join(f"é{'x' * (i % 5)}a{i}@b.com, " for i in range(n)) + "end"
    assert found(spark, text, spans.EMAIL) == [(m.start(), m.end(), m.group()) for m in re.finditer(spans.EMAIL, text)]


def test_time_of_many_matches(spark):
    text = "12345678 " * 40_000
    found(spark, "12345678", spans.ACCOUNT)
    began = time.time()
    assert len(found(spark, text, spans.ACCOUNT)) == 40_000
    assert time.time() - began < 10
