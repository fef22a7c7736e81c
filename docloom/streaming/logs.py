"""Streaming over review logs: the learned tally and the accuracy meter, updated as lines arrive.

Each micro-batch folds its own rows into a settled table, so the state is the
tally itself and a restart resumes from the checkpoint without counting twice:
a batch's table is written under its number, and the newest number wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.review import merge_tallies, tally
from docloom.sources.logs import DECISION

STORE = "value string, type string, allow bigint, deny bigint"


def decisions(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(DECISION + ", seq bigint").option("maxFilesPerTrigger", per_trigger).json(folder)


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The newest tally; empty before the first batch."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [s.getPath().getName() for s in fs.listStatus(path) if fs.exists(s.getPath().suffix("/_SUCCESS"))] if fs.exists(path) else []
    return spark.read.schema(STORE).parquet(f"{folder}/{max(done)}") if done else spark.createDataFrame([], STORE)


def run_tally(spark: SparkSession, logs: str, store: str, checkpoint: str):
    """Start a query that keeps the tally of all decisions in ``store``; returns it."""

    def fold(batch: DataFrame, number: int) -> None:
        name = f"{number:012d}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/{name}/_SUCCESS")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return
        merged = merge_tallies(latest(spark, store), tally(batch.where("value is not null")))
        merged.write.mode("overwrite").parquet(f"{store}/{name}")

    return decisions(spark, logs).writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, lateness: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Decisions per window of event time and verdict, with late rows up to ``lateness``."""
    at = F.timestamp_seconds("timestamp").alias("at")
    return events.select(at, "verdict").withWatermark("at", lateness).groupBy(F.window("at", width), "verdict").count()
