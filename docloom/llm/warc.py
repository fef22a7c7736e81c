"""WARC records and a Merkle fixity audit of replicas.

Pages become WARC/1.0 records. Records lie in segments (files) in order of their
page; a window over the records' lengths gives offsets, so texts are hashed where
they are read and only digests move. A leaf hashes a record's offset range and
digest. Nodes hash up to ``FAN`` ordered children: first within a segment, then
over segments, up to one root per replica. The audit compares roots and descends
only into the children of nodes that differ.

Cases: null url and html count as empty; a null page_id makes a segment of its
own; ties on page_id go by digest, and repeated rows are records of their own;
an empty table has no nodes and an empty audit; extra columns are ignored;
long pages are hashed whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import settle

SEGMENT, FAN = 256, 16
DATE = "2024-01-01T00:00:00Z"


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The text of a WARC record without the two line ends that close it."""
    body = F.coalesce(html, F.lit(""))
    size = F.octet_length(body).cast("string")
    key = F.md5(F.coalesce(page_id.cast("string"), F.lit("")))
    uuid = F.concat_ws("-", *[F.substring(key, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"), uuid, F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), size, F.lit("\r\n\r\n"), body,
    )


def records(pages: DataFrame, replica: str) -> DataFrame:
    """(replica, page_id, segment, bytes, digest): one row per record; the text stays behind."""
    text = pages.select("page_id", record(F.col("page_id"), F.col("url"), F.col("html")).alias("text"))
    closed = F.concat("text", F.lit("\r\n\r\n"))
    segment = F.coalesce(F.floor(F.col("page_id") / SEGMENT), F.lit(-1)).cast("bigint")
    return text.select(F.lit(replica).alias("replica"), "page_id", segment.alias("segment"), F.octet_length(closed).cast("bigint").alias("bytes"), F.sha2(closed, 256).alias("digest"))


def leaves(found: DataFrame) -> DataFrame:
    """Records with place, offset and hash: the leaves of each replica's tree."""
    order = Window.partitionBy("replica", "segment").orderBy("page_id", "digest")
    before = F.coalesce(F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = found.withColumn("place", (F.row_number().over(order) - 1).cast("bigint")).withColumn("offset", before)
    return placed.withColumn("hash", F.sha2(F.concat_ws(":", F.lit("leaf"), "offset", "bytes", "digest"), 256))


def _parents(nodes: DataFrame, parent: list[Column]) -> DataFrame:
    """Nodes (replica, segment, place, hash) over their ordered children."""
    rows = nodes.select("replica", *parent, F.struct(F.col("segment").alias("s"), F.col("place").alias("p"), "hash").alias("child"))
    children = F.array_sort(F.collect_list("child"))
    joined = F.array_join(F.transform(children, lambda c: c["hash"]), "")
    return rows.groupBy("replica", "up_segment", "up_place").agg(F.sha2(F.concat(F.lit("node:"), joined), 256).alias("hash")).select("replica", F.col("up_segment").alias("segment"), F.col("up_place").alias("place"), "hash")


def tree(found: DataFrame) -> list[tuple[DataFrame, str]]:
    """Levels from the leaves to the root, with how a node's key gives its parent's: by "place" within a segment, by "segment" above, by "join" under the root."""
    level = settle(leaves(found))
    out = [(level, "place")]
    while True:
        top = level.agg(F.max("place"), F.max("segment"), F.min("segment")).first()
        if top[0] is None or (top[0] == 0 and top[1] == top[2]):
            return out
        # Halving keeps the sign of a segment, so -1 (null and negative pages) and 0 meet only under the root.
        kind = "place" if top[0] > 0 else "join" if top[2] >= -1 and top[1] <= 0 else "segment"
        out[-1] = (level, kind)
        level = settle(_parents(level, _up(kind)))
        out.append((level, "root"))


def _up(kind: str) -> list[Column]:
    if kind == "place":
        return [F.col("segment").alias("up_segment"), F.floor(F.col("place") / FAN).cast("bigint").alias("up_place")]
    if kind == "join":
        return [F.lit(0).cast("bigint").alias("up_segment"), F.lit(0).cast("bigint").alias("up_place")]
    return [F.floor(F.col("segment") / FAN).cast("bigint").alias("up_segment"), F.lit(0).cast("bigint").alias("up_place")]


KEY = ["segment", "place"]


def mismatches(level: DataFrame, one: str, other: str) -> DataFrame:
    """Keys whose nodes differ between two replicas, or that only one has."""
    side = lambda r, name: level.where(F.col("replica") == r).select(*KEY, F.col("hash").alias(name))
    return side(one, "a").join(side(other, "b"), KEY, "full").where(~F.col("a").eqNullSafe(F.col("b"))).select(*KEY)


def audit(found: DataFrame, one: str, other: str) -> tuple[DataFrame, DataFrame]:
    """(leaves, damaged): all leaves of both replicas, and the keys of those that differ, found from the roots down."""
    levels = tree(found)
    bad = mismatches(levels[-1][0], one, other)
    for level, kind in reversed(levels[:-1]):
        bad = settle(bad)
        up = level.withColumns({"up_segment": _up(kind)[0], "up_place": _up(kind)[1]})
        suspect = up.join(bad.select(F.col("segment").alias("up_segment"), F.col("place").alias("up_place")), ["up_segment", "up_place"], "left_semi")
        bad = mismatches(suspect, one, other)
    return levels[0][0], bad


def report(found: DataFrame, one: str, other: str) -> DataFrame:
    """One row per record of the first replica, and per place that only the other has.

    status: intact; damaged, another digest; moved, the same digest at another offset; missing or extra in the other.
    """
    all_leaves, bad = audit(found, one, other)
    side = lambda r: all_leaves.where(F.col("replica") == r)
    theirs = side(other).join(bad, KEY, "left_semi").select(*KEY, F.col("page_id").alias("other_id"), F.col("digest").alias("other_digest"), F.col("offset").alias("other_offset"), F.lit(True).alias("present"))
    suspect = bad.join(side(one), KEY, "left").join(theirs, KEY, "left")
    status = F.when(F.col("digest").isNull(), "extra").when(F.col("present").isNull(), "missing").when(F.col("digest") != F.col("other_digest"), "damaged").otherwise("moved")
    columns = lambda s: [F.coalesce("page_id", "other_id").alias("page_id") if "other_id" in s.columns else F.col("page_id"), "segment", "place", "offset", "bytes", "digest"]
    differing = suspect.select(*columns(suspect), status.alias("status"))
    intact = side(one).join(bad, KEY, "left_anti")
    return intact.select(*columns(intact), F.lit("intact").alias("status")).unionByName(differing)


# Files ------------------------------------------------------------------------


def write(pages: DataFrame, path: str, compression: str = "none") -> None:
    """WARC files, one per partition, by Spark's text writer: records end with two line ends, which separate its lines."""
    text = pages.select(record(F.col("page_id"), F.col("url"), F.col("html")).alias("value"))
    text.write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


_HEADER = re.compile(rb"WARC/1\.[01]\r\n(.*?)\r\n\r\n", re.S)


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, payload) of each record in a file's bytes."""
    at = 0
    while at < len(data):
        m = _HEADER.match(data, at)
        if not m:
            raise ValueError(f"no WARC record at offset {at}")
        headers = dict(x.split(": ", 1) for x in m[1].decode().split("\r\n") if ": " in x)
        end = m.end() + int(headers["Content-Length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at offset {at} is cut off or longer than it says")
        yield at, end + 4 - at, headers, data[m.end() : end]
        at = end + 4


def read(spark, path: str) -> DataFrame:
    """Records of WARC files: file, offset, length, url and html."""

    def run(batches):
        import pandas as pd

        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                rows = [(name, o, n, h.get("WARC-Target-URI", ""), p.decode("utf-8", "replace")) for o, n, h, p in parse(content)]
                yield pd.DataFrame(rows, columns=["file", "offset", "length", "url", "html"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, offset bigint, length bigint, url string, html string")


def planted(pages: DataFrame, modulus: int = 97, remainder: int = 5) -> DataFrame:
    """A replica in which the first character of some pages is overwritten, which keeps their number of characters."""
    hit = F.col("page_id") % modulus == remainder
    return pages.select("page_id", "url", F.when(hit & (F.length("html") > 0), F.expr("overlay(html PLACING '~' FROM 1 FOR 1)")).otherwise(F.col("html")).alias("html"))


def oracle(modulus: int = 97, remainder: int = 5) -> str:
    """Brute force in DuckDB SQL: both replicas' records hashed and compared one by one."""
    text = f"""'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:uuid:' || substr(k, 1, 8) || '-' || substr(k, 9, 4) || '-' || substr(k, 13, 4) || '-' || substr(k, 17, 4) || '-' || substr(k, 21, 12)
      || '>' || chr(13) || chr(10) || 'WARC-Date: {DATE}' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: '
      || strlen(h) || chr(13) || chr(10) || chr(13) || chr(10) || h || chr(13) || chr(10) || chr(13) || chr(10)"""
    return f"""
    WITH p AS (SELECT page_id, url, md5(coalesce(CAST(page_id AS VARCHAR), '')) AS k, coalesce(html, '') AS h,
      CASE WHEN page_id % {modulus} = {remainder} AND length(html) > 0 THEN '~' || substr(html, 2) ELSE coalesce(html, '') END AS g FROM pages),
    a AS (SELECT page_id, url, k, CAST(coalesce(floor(page_id / {SEGMENT}), -1) AS BIGINT) AS segment, {text} AS t, h, g FROM p),
    d AS (SELECT page_id, segment, strlen(t) AS bytes, sha256(t) AS digest, h <> g AS differs, strlen(h) AS n, strlen(g) AS m FROM a)
    SELECT page_id, segment, CAST(row_number() OVER w - 1 AS BIGINT) AS place, CAST(coalesce(sum(bytes) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
      CAST(bytes AS BIGINT) AS bytes, digest, CASE WHEN differs THEN 'damaged' ELSE 'intact' END AS status
    FROM d WINDOW w AS (PARTITION BY segment ORDER BY page_id, digest)"""
