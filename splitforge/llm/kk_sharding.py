"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

Rows with equal texts form a group that stays together.  Groups are dealt by hash
into blocks of about ``block_groups``; a block is solved in one task: every group
starts as a partial partition (its size and zeros), and the two with the largest
spread are combined, heaviest part to lightest, until one is left.  The blocks'
partial partitions are vectors of shard sums and are combined by the same rule,
``block_groups`` of them at a time, level by level, so no task sees more than a
block.  Only (hash, size) is shuffled, never texts.

Slots count from zero without gaps in each shard: rows are numbered within
(shard, hash bucket) and the sizes of the earlier buckets are added, so a shard
dominated by one group of copies is numbered by many tasks.

Nulls: a null text counts as an empty one (size 8, checksum 0, the same group); a
null doc_id is numbered before all others.  Repeated rows get slots of their own.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written

SHARDS, BLOCK_GROUPS, ROW_OVERHEAD, SLOT_BUCKET_ROWS = 24, 20_000, 8, 50_000


def differencing(items: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp over vectors of ``parts`` sums each: (n x parts) new place of each item's part, and the sums of the places.

    A scalar item is a vector with its size first and zeros after it.
    """
    n = len(items)
    order = np.argsort(-items, axis=1, kind="stable")
    sums = np.take_along_axis(items, order, axis=1)
    # node: (sums from heavy to light); merges remember where each part of either side went
    nodes: list[tuple] = [tuple(s) for s in sums.tolist()]
    heap = [(s[-1] - s[0], i) for i, s in enumerate(nodes)]
    heapq.heapify(heap)
    merges: list[tuple[int, int, list[int]]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        mixed = [x + y for x, y in zip(nodes[a], reversed(nodes[b]))]
        by = sorted(range(parts), key=mixed.__getitem__, reverse=True)
        merges.append((a, b, by))
        nodes.append(tuple(mixed[k] for k in by))
        nodes[a] = nodes[b] = ()
        heapq.heappush(heap, (nodes[-1][-1] - nodes[-1][0], len(nodes) - 1))
    place: list = [None] * len(nodes)
    place[-1] = np.arange(parts)
    for k in range(len(merges) - 1, -1, -1):
        a, b, by = merges[k]
        new = np.empty(parts, np.int64)
        new[by] = place[n + k]
        place[a], place[b] = new, new[::-1]
        place[n + k] = None
    out = np.empty((n, parts), np.int64)
    for i in range(n):
        out[i, order[i]] = place[i]
    return out, np.array(nodes[-1], dtype=items.dtype)


def _solve(groups: DataFrame, parts: int, block_groups: int) -> DataFrame:
    """(gkey, shard) for groups (gkey, gsize)."""
    n = groups.count()
    blocks = max(1, -(-n // block_groups))
    dealt = groups.withColumn("node", F.pmod(F.xxhash64("gkey"), F.lit(blocks)))

    def leaf(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["gsize", "gkey"], ascending=False, kind="stable")
        items = np.zeros((len(pdf), parts), np.int64)
        items[:, 0] = pdf.gsize
        place, sums = differencing(items, parts)
        out = pd.DataFrame({"gkey": pdf.gkey.to_numpy(), "node": pdf.node.to_numpy(), "part": place[:, 0], "sums": None})
        out.at[0, "sums"] = sums.tolist()
        return out

    solved = written(dealt.groupBy("node").applyInPandas(leaf, "gkey binary, node long, part long, sums array<long>"))
    assigned = solved.select("gkey", "node", "part")
    vectors = solved.filter("sums is not null").select("node", "sums")

    def inner(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        place, sums = differencing(np.array(pdf.sums.tolist(), np.int64), parts)
        out = pd.DataFrame({"node": pdf.node.to_numpy(), "up": pdf.up.to_numpy(), "place": place.tolist(), "sums": None})
        out.at[0, "sums"] = sums.tolist()
        return out

    while blocks > 1:
        step = written(vectors.withColumn("up", F.floor(F.col("node") / block_groups)).groupBy("up").applyInPandas(inner, "node long, up long, place array<long>, sums array<long>"))
        assigned = assigned.join(step.select("node", "up", "place"), "node").select("gkey", F.col("up").alias("node"), F.get("place", F.col("part").cast("int")).alias("part"))
        vectors = step.filter("sums is not null").select(F.col("up").alias("node"), "sums")
        blocks = -(-blocks // block_groups)
    return assigned.select("gkey", F.col("part").cast("int").alias("shard"))


def shard(docs: DataFrame, shards: int = SHARDS, block_groups: int = BLOCK_GROUPS) -> DataFrame:
    """(row, doc_id, size, text_crc32, shard, slot) for every row; row numbers those of the scan."""
    if shards < 1 or block_groups < 2:
        raise ValueError("shards >= 1 and block_groups >= 2")
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = written(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.unhex(F.md5(text)).alias("gkey"),
        )
    )
    groups = written(rows.groupBy("gkey").agg(F.sum("size").alias("gsize")))
    placed = rows.join(_solve(groups, shards, block_groups), "gkey").drop("gkey")
    buckets = max(8, -(-rows.count() // SLOT_BUCKET_ROWS))
    placed = written(placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "row"), F.lit(buckets)).cast("int")))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    heads = counts.select("shard", "bucket", (F.sum("n").over(W.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("head"))
    slot = F.col("head") + F.row_number().over(W.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "row")) - 1
    return placed.join(heads, ["shard", "bucket"]).select("row", "doc_id", "size", "text_crc32", "shard", slot.cast("long").alias("slot"))


def op5_kk_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
