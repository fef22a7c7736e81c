"""Session helper: one place for the settings that the plans rely on, and for results that are used more than once."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows of one Arrow batch. Texts may be long, so batches stay small.
BATCH_ROWS = 1000


def guard(spark: SparkSession) -> SparkSession:
    """Settings that right results and bounded work need.

    With union output partitioning on, Spark 4.1 may take a union of differently coalesced children for
    co-partitioned and then loses rows or fails to zip them. The rule that infers a filter below an explode
    is off: the filter repeats the expressions that make the array, within each lambda that refers to them,
    so that detection ran many times a row (8.7 s against 1.5 s on 23,000 fields).
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    rule, off = "org.apache.spark.sql.catalyst.optimizer.InferFiltersFromGenerate", spark.conf.get("spark.sql.optimizer.excludedRules", None) or ""
    if rule not in off:
        spark.conf.set("spark.sql.optimizer.excludedRules", ",".join(filter(None, [off, rule])))
    return spark


def session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "docloom", **extra: str) -> SparkSession:
    conf = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | extra
    spark = SparkSession.builder.master(master).appName(app).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return guard(spark)


def bounded_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches that go to Python workers small in rows and bytes, and let local workers find this package."""
    guard(spark)
    root = str(Path(__file__).resolve().parents[1])
    environment = spark.sparkContext.environment
    if root not in environment.get("PYTHONPATH", "").split(":"):
        environment["PYTHONPATH"] = ":".join(filter(None, [environment.get("PYTHONPATH"), root]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's own, or a temporary one where both are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share under master {master}")
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Set on a settled table: where it lies.
_PATH = "_docloom_path"


def settle(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: computed once, and no executor's loss brings it up again."""
    import uuid

    path = f"{shared_folder(df.sparkSession)}/docloom/{uuid.uuid4().hex}"
    guard(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    setattr(out, _PATH, path)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that nothing refers to any more; other DataFrames are left alone."""
    for t in tables:
        if path := t.__dict__.get(_PATH):
            jvm, conf = t.sparkSession._jvm, t.sparkSession._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
