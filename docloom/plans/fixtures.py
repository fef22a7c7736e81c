"""Inputs of the queries, derived from the tables by rules that read the same in Spark and in SQL.

ledger: sentences with amounts, dates and names, one per order. lines: the lines
of all documents. drafts: lines whose commas and full stops become brackets;
lines with " | " are one-row tables, short ones headings. styled: a styled block
per order. log: a review decision per order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = """
SELECT 10000000 + o_custkey AS doc_id, CAST(o_orderkey AS INT) AS block_index,
  CASE o_orderkey % 8
    WHEN 0 THEN concat('Invoice ', o_orderkey, ': pay $', CAST(floor(o_totalprice) AS BIGINT), '.50 by ', substring(CAST(o_orderdate AS STRING), 1, 10), ' please.')
    WHEN 1 THEN concat('Remit ', CAST(floor(o_totalprice) AS BIGINT), ' euros within ten percent (10%) of the budget. Thanks')
    WHEN 2 THEN concat('Transfer to GB82WEST', lpad(CAST(o_orderkey AS STRING), 14, '0'), ' now! Late fees: 7.5% of ', o_orderkey)
    WHEN 3 THEN concat('Card 4111 1111 1111 1111 was charged three hundred dollars for order ', o_orderkey)
    WHEN 4 THEN concat('Payer 1 ', lpad(CAST(o_custkey % 1000 AS STRING), 3, '0'), ',50 euros le 3 mars 2024 soit dix pour cent du total')
    WHEN 5 THEN concat('Call +1 415-555-', lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0'), ' or mail c', o_custkey % 700, '@shop', o_orderkey % 9, '.com. Then wait')
    WHEN 6 THEN concat('Dr. Smith of Acme Holdings met Globex Ltd on ', 1 + o_orderkey % 28, ' Mar 2024 about Order ', o_orderkey)
    ELSE concat('The Account ', lpad(CAST(o_custkey AS STRING), 10, '7'), ' paid 7.5 % and twenty-five pounds to Pay Initech Group') END AS text
FROM orders"""

STYLED = """
SELECT o_custkey AS doc_id, CAST(o_orderkey AS INT) AS block_index,
  CASE o_orderkey % 4 WHEN 0 THEN 'heading' WHEN 1 THEN 'paragraph' WHEN 2 THEN 'list_item' ELSE 'table_cell' END AS kind,
  CASE WHEN o_orderkey % 4 = 0 THEN CAST(1 + floor((o_orderkey % 12) / 4.0) AS INT) END AS level,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS style_name,
  CASE WHEN o_orderkey % 5 <> 0 THEN concat('Font', substring(o_orderpriority, 1, 1)) END AS font,
  CASE WHEN o_orderkey % 11 <> 0 THEN CAST(20 + 3 * (o_orderkey % 3) AS INT) END AS size_half_pt,
  o_orderkey % 9 = 0 AS bold, o_orderkey % 13 = 0 AS italic,
  CASE WHEN o_orderkey % 6 < 3 THEN 'left' WHEN o_orderkey % 6 < 5 THEN 'both' END AS alignment,
  CASE WHEN o_orderkey % 2 = 0 THEN CAST(360 * (1 + o_orderkey % 3) AS INT) END AS indent_left,
  CASE WHEN o_orderkey % 4 = 2 THEN CAST(1 + o_custkey % 2 AS INT) END AS num_id,
  CASE WHEN o_orderkey % 4 = 2 AND o_orderkey % 5 <> 1 THEN CAST(floor((o_orderkey % 16) / 4.0) AS INT) END AS ilvl,
  o_orderkey % 17 = 0 AS style_unresolved, o_orderkey % 10 = 0 AS is_mixed, concat('Block ', o_orderkey, ' ') AS text
FROM orders"""

LOG = """
SELECT o_orderkey AS seq, o_custkey AS doc_id, concat('v', o_custkey % 400, CASE WHEN o_orderkey % 5 = 0 THEN '@x.com' ELSE '' END) AS value,
  CASE o_orderkey % 5 WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'ORG' WHEN 2 THEN 'PHONE' WHEN 3 THEN 'ENTITY' ELSE 'ID' END AS detected_type,
  CASE o_orderkey % 5 WHEN 0 THEN 'regex:email' WHEN 1 THEN 'party-list' WHEN 2 THEN 'regex:phone' WHEN 3 THEN 'heuristic' ELSE 'other' END AS method,
  CASE WHEN (o_orderkey + o_custkey) % 4 = 0 THEN 'reject' ELSE 'confirm' END AS verdict,
  CASE WHEN o_orderkey % 6 = 0 THEN 'occurrence' ELSE 'group' END AS scope, o_orderkey % 3 <> 0 AS reviewed,
  CAST(1 + o_orderkey % 70 AS INT) AS occurrences, CASE WHEN o_orderkey % 4 = 1 THEN CAST(1 + o_orderkey % 5 AS INT) END AS heading_level,
  o_totalprice AS price
FROM orders"""


def _views(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def from_orders(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("FROM orders", "FROM {orders}"), orders=_views(spark, sf_dir, "orders")["orders"])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, dealt out over the cores where the files make fewer parts than there are cores."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(cores, "doc_id") if docs.rdd.getNumPartitions() < cores else docs


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_index", "text"))


def _cells(df: DataFrame, kind: str = "paragraph") -> DataFrame:
    none = F.lit(None).cast("int")
    return df.select("doc_id", "block_index", none.alias("cell_row"), none.alias("cell_col"), F.lit(kind).alias("kind"), F.lit(None).cast("tinyint").alias("heading_level"), "text")


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lines and ledger as fields."""
    ledger = from_orders(spark, sf_dir, LEDGER)
    cores = spark.sparkContext.defaultParallelism
    ledger = ledger.repartition(cores, "doc_id") if ledger.rdd.getNumPartitions() < cores else ledger
    return _cells(lines(spark, sf_dir).unionByName(ledger))


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = lines(spark, sf_dir).withColumn("text", F.translate("text", ",.", "[]"))
    table = F.contains("text", F.lit(" | "))
    heading = F.size(F.split("text", " ")) <= 3
    kind = F.when(table, "table").when(heading, "heading").otherwise("paragraph")
    return marked.select(
        "doc_id", "block_index", kind.alias("kind"), F.when(kind == "heading", 1 + F.col("block_index") % 3).cast("tinyint").alias("level"),
        F.when(~table, F.col("text")).alias("text"), F.when(table, F.array(F.split("text", r" \| "))).alias("rows"),
    )


def styled(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.array(F.struct(F.col("text").alias("text"), F.lit(False).alias("bold")))
    two = F.array(F.struct(F.lit("a").alias("text"), F.lit(True).alias("bold")), F.struct(F.lit("b").alias("text"), F.lit(False).alias("bold")))
    return from_orders(spark, sf_dir, STYLED).withColumn("segments", F.when(F.col("is_mixed"), two).otherwise(one))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_orders(spark, sf_dir, LOG)


def nation_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table per region: a header and its nations."""
    n = _views(spark, sf_dir, "nation")["nation"]
    row = F.struct("n_nationkey", F.array(F.col("n_nationkey").cast("string"), "n_name", F.concat(F.lit("r"), "n_regionkey")).alias("r"))
    rows = F.concat(F.array(F.array(F.lit("key"), F.lit("name"), F.lit("region"))), F.transform(F.sort_array(F.collect_list(row)), lambda x: x["r"]))
    return n.groupBy(F.col("n_regionkey").cast("bigint").alias("doc_id")).agg(rows.alias("rows")).select("doc_id", F.lit(0).alias("block_index"), F.lit("table").alias("kind"), "rows")


# The same in DuckDB SQL.
LINES_SQL = "SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS block_index, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"
FIELDS_SQL = f"SELECT doc_id, block_index, text FROM ({LINES_SQL}) UNION ALL SELECT doc_id, block_index, text FROM ({LEDGER})"
DRAFTS_SQL = f"""
SELECT doc_id, block_index, t AS text, CASE WHEN contains(t, ' | ') THEN 'table' WHEN len(string_split(t, ' ')) <= 3 THEN 'heading' ELSE 'paragraph' END AS kind,
  CASE WHEN NOT contains(t, ' | ') AND len(string_split(t, ' ')) <= 3 THEN CAST(1 + block_index % 3 AS INT) END AS level
FROM (SELECT doc_id, block_index, translate(text, ',.', '[]') AS t FROM ({LINES_SQL}))"""
DRAFT_FIELDS_SQL = f"""
SELECT doc_id, block_index, CAST(-1 AS INT) AS cell_row, CAST(-1 AS INT) AS cell_col, kind, text FROM ({DRAFTS_SQL}) WHERE kind <> 'table'
UNION ALL SELECT doc_id, block_index, 0, CAST(generate_subscripts(c, 1) - 1 AS INT), 'table_cell', unnest(c) FROM (SELECT doc_id, block_index, string_split(text, ' | ') AS c FROM ({DRAFTS_SQL}) WHERE kind = 'table')"""
NATIONS_SQL = """
SELECT CAST(n_regionkey AS BIGINT) AS doc_id, list_concat([['key', 'name', 'region']], list([CAST(n_nationkey AS VARCHAR), n_name, 'r' || n_regionkey] ORDER BY n_nationkey)) AS rows FROM nation GROUP BY n_regionkey"""
