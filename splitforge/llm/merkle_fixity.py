"""Fixity audit of replicated record files with Merkle trees over offset ranges.

Records are hashed where they lie.  A leaf is the ordered hash of the records that
start in one range of ``range_bytes`` offsets of a file; above it every node is
the ordered hash of up to ``fanout`` neighbouring ranges, up to one root a file.
Two replicas compare roots first, and level by level only children of nodes that
differ are read; only the records of differing leaves are compared one by one.
Each node gathers at most ``fanout`` hashes, a leaf the records of one range, so no
task gathers a whole file.

Input rows: file, offset, length, digest (``records`` makes them).  Nulls: a null
url or html counts as empty; a null page_id files the page by its url's hash.
Repeated pages are records of their own, in the order of (page_id, digest); equal ones
are interchangeable.  page_id is expected to repeat seldom: pages of one page_id lie in
one file.  Very long texts are hashed whole, where they lie; only digests and lengths
move.  A record found only in one replica is reported as missing or extra, never an
error.  Empty replicas have no roots; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written

PAGES_PER_FILE, RANGE_BYTES, FANOUT, NO_ID_FILES = 1000, 1 << 16, 16, 1 << 20


def record_digest(url: Column, payload: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(url, F.lit("")), F.lit("\n"), F.coalesce(payload, F.lit(""))), 256)


def records(pages: DataFrame, pages_per_file: int = PAGES_PER_FILE) -> DataFrame:
    """(file, offset, length, digest, page_id): pages as records of files of consecutive page_ids, one after the other."""
    length = (F.octet_length(F.coalesce("url", F.lit(""))) + 1 + F.octet_length(F.coalesce("html", F.lit("")))).cast("long")
    file = F.coalesce(F.floor(F.col("page_id") / pages_per_file), -1 - F.conv(F.substring(F.md5(F.coalesce("url", F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long") % NO_ID_FILES)
    rows = pages.select("page_id", file.cast("long").alias("file"), length.alias("length"), record_digest(F.col("url"), F.col("html")).alias("digest"))
    before = F.sum("length").over(W.partitionBy("file").orderBy("page_id", "digest").rowsBetween(W.unboundedPreceding, -1))
    return rows.select("file", F.coalesce(before, F.lit(0)).cast("long").alias("offset"), "length", "digest", "page_id")


def _ordered_hash(*parts: Column) -> Column:
    names = [f"p{i}" for i in range(len(parts))]
    ordered = F.array_sort(F.collect_list(F.struct(*[c.alias(n) for c, n in zip(parts, names)])))
    lines = F.transform(ordered, lambda x: F.concat_ws(":", *[x[n].cast("string") for n in names]))
    return F.sha2(F.array_join(lines, ","), 256)


def merkle_tree(recs: DataFrame, levels: int, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """(level, file, node, hash), written: level 0 are offset ranges, level ``levels`` the file roots (node 0)."""
    leaf = F.floor(F.col("offset") / range_bytes)
    level = recs.groupBy("file", leaf.alias("node")).agg(_ordered_hash(F.col("offset"), F.col("length"), F.col("digest")).alias("hash"))
    every = level = written(level.withColumn("level", F.lit(0)))
    for k in range(1, levels + 1):
        up = level.groupBy("file", F.floor(F.col("node") / fanout).alias("node")).agg(_ordered_hash(F.col("node"), F.col("hash")).alias("hash"))
        level = up.withColumn("level", F.lit(k))
        every = every.unionByName(level)
    return written(every)


def _levels(recs: DataFrame, range_bytes: int, fanout: int) -> int:
    last, levels = (recs.agg(F.max("offset")).first()[0] or 0) // range_bytes, 0
    while last:
        last, levels = last // fanout, levels + 1
    return levels


def audit(primary: DataFrame, replica: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """(file, offset, status, expected, found) of the records that differ: corrupt, missing (not in the replica) or extra."""
    levels = max(_levels(primary, range_bytes, fanout), _levels(replica, range_bytes, fanout))
    ours, theirs = (merkle_tree(r, levels, range_bytes, fanout) for r in (primary, replica))
    suspects = None
    for k in range(levels, -1, -1):
        sides = []
        for side, name in ((ours, "a"), (theirs, "b")):
            nodes = side.filter(F.col("level") == k).select("file", "node", F.col("hash").alias(name))
            if suspects is not None:
                nodes = nodes.withColumn("up", F.floor(F.col("node") / fanout)).join(suspects.withColumnRenamed("node", "up"), ["file", "up"], "left_semi").drop("up")
            sides.append(nodes)
        suspects = sides[0].join(sides[1], ["file", "node"], "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select("file", "node")
    suspects = written(suspects)

    def inside(recs: DataFrame) -> DataFrame:
        return recs.withColumn("node", F.floor(F.col("offset") / range_bytes)).join(suspects, ["file", "node"], "left_semi")

    found = inside(replica).select("file", "offset", F.col("digest").alias("found"), F.col("length").alias("length_b"))
    expected = inside(primary).select("file", "offset", F.col("digest").alias("expected"), F.col("length").alias("length_a"))
    both = expected.join(found, ["file", "offset"], "full")
    same = F.col("expected").eqNullSafe(F.col("found")) & F.col("length_a").eqNullSafe(F.col("length_b"))
    status = F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "extra").otherwise("corrupt")
    return both.filter(~same).select("file", "offset", status.alias("status"), "expected", "found")


def op1_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages against a replica with planted damage: by md5 of page_id 1 in 256 records is overwritten, 1 lost, 1 cut short."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    good = written(records(pages))
    hit = F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 2)
    html = F.when(hit == "00", F.overlay("html", F.lit("#"), F.lit(1))).when(hit == "02", F.left(F.col("html"), F.length("html") - 1)).otherwise(F.col("html"))
    damaged = pages.filter(F.coalesce(hit, F.lit("")) != "01").select("page_id", record_digest(F.col("url"), html).alias("now"), record_digest(F.col("url"), F.col("html")).alias("digest")).distinct()
    same = good["page_id"].eqNullSafe(damaged["page_id"]) & (good["digest"] == damaged["digest"])
    replica = written(good.join(damaged, same).select(good["*"], "now").select("file", "offset", "length", F.col("now").alias("digest")))
    return audit(good, replica)


OP1_SQL = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, html, substr(md5(CAST(page_id AS VARCHAR)), 1, 2) AS hit,
  coalesce(CAST(floor(page_id / 1000) AS BIGINT), -1 - CAST('0x' || substr(md5(coalesce(url, '')), 1, 8) AS BIGINT) % 1048576) AS file FROM pages),
h AS (SELECT *, strlen(url) + 1 + strlen(coalesce(html, '')) AS n, sha256(url || chr(10) || coalesce(html, '')) AS expected,
  sha256(url || chr(10) || coalesce(CASE hit WHEN '00' THEN '#' || substr(html, 2) WHEN '02' THEN CASE WHEN length(html) < 2 THEN '' ELSE left(html, length(html) - 1) END ELSE html END, '')) AS now FROM p),
r AS (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY file ORDER BY page_id, expected ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM h)
SELECT file, "offset", CASE WHEN hit = '01' THEN 'missing' ELSE 'corrupt' END AS status, expected, CASE WHEN hit <> '01' THEN now END AS found
FROM r WHERE hit = '01' OR now <> expected
"""
