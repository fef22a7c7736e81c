"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.session import BATCH_ROWS, bounded_batches, discard, guard, settle, shared_folder  # noqa: F401  the other modules take them from here


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, in this order; clashing extra columns never reach an operator."""
    return df.select(*[df[n] for n in names])
