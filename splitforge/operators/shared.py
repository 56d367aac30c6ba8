from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


FINISH = 200_000


def saved(df: DataFrame) -> DataFrame:
    """The frame written to the shared checkpoint folder and read again; iterations keep short plans and survive lost executors.

    The tables stay, since results read them; the folder's owner clears it when the session ends.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='splitforge-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hash_order(key: Column, seed: object) -> Column:
    """md5 of seed and key: a shuffle that any engine can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def matched(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join by columns of one name in which NULL matches NULL."""
    named = right.withColumnsRenamed({c: f"__{c}" for c in on})
    cond = F.lit(True)
    for c in on:
        cond = cond & left[c].eqNullSafe(named[f"__{c}"])
    return left.join(named, cond, how).drop(*[f"__{c}" for c in on])


def _summed(rows: DataFrame, by: list[str], part: str, order: str, values: list[str]) -> DataFrame:
    """rows with ``<value>_before``: the sums of the rows before within ``part``, plus those of the smaller parts."""
    sums = rows.groupBy(*by, part).agg(*[F.sum(v).alias(v) for v in values])
    heads = sums.select(*by, part, *[(F.sum(v).over(W.partitionBy(*by).orderBy(part)) - F.col(v)).alias(f"__{v}") for v in values])
    inside = W.partitionBy(*by, part).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    own = rows.withColumns({f"{v}_before": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values})
    return matched(own, heads, [*by, part]).withColumns({f"{v}_before": F.col(f"{v}_before") + F.col(f"__{v}") for v in values}).drop(part, *[f"__{v}" for v in values])


def ranked(df: DataFrame, by: list[str], order: str, name: str = "rank") -> DataFrame:
    """Ranks from 1 in the order of the hex column ``order`` within ``by``.

    Rows are numbered within their first three digits, plus the counts of smaller
    digits, so that no task sees a whole group.
    """
    rows = df.withColumns({"__d": F.substring(order, 1, 3), "__one": F.lit(1).cast("long")})
    return _summed(rows, by, "__d", order, ["__one"]).withColumn(name, F.col("__one_before") + 1).drop("__one", "__one_before")


def running(df: DataFrame, by: list[str], order: str, values: list[str]) -> DataFrame:
    """df with ``<value>_before``: the sums of the values of the rows before, in the order of any column within ``by``.

    Rows are range-partitioned by ``by`` and ``order``, so that a large group is spread over
    tasks, and summed within their part.  They are written before, so parts stay as they are.
    """
    parts = saved(df.repartitionByRange(*by, order).withColumn("__d", F.spark_partition_id()))
    return _summed(parts, by, "__d", order, values)


def numbered(df: DataFrame, by: list[str], order: str, name: str = "rank") -> DataFrame:
    """Ranks from 1 in the order of any column within ``by``; ``order`` goes."""
    rows = running(df.withColumn("__one", F.lit(1).cast("long")), by, order, ["__one"])
    return rows.withColumn(name, F.col("__one_before") + 1).drop("__one", "__one_before", order)


def _contracted(links: DataFrame, by: list[str]) -> DataFrame:
    """Fewer links (by, v, u) with the same components: those that each task reads together become stars around their least nodes."""

    def stars(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for key, own in pdf.groupby(by, dropna=False) if by else [((), pdf)]:
            node, at = np.unique(own[["i", "j"]].to_numpy(), return_inverse=True)
            a, b = at.reshape(-1, 2).T
            root = np.arange(len(node))
            while len(a):
                apart = root[a] != root[b]
                a, b = a[apart], b[apart]
                np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
                while not np.array_equal(up := root[root], root):
                    root = up
            some = np.flatnonzero(root != np.arange(len(node)))
            out.append(pd.DataFrame({**dict(zip(by, key)), "v": node[some], "u": node[root[some]]}))
        return pd.concat(out) if out else pd.DataFrame(columns=[*by, "v", "u"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for pdf in batches:
            held.append(pdf)
            n += len(pdf)
            if n >= 500_000:
                yield stars(pd.concat(held))
                held, n = [], 0
        if held:
            yield stars(pd.concat(held))

    schema = links.select(*by, F.col("i").alias("v"), F.col("i").alias("u")).schema
    return links.select(*by, "i", "j").mapInPandas(run, schema)


def components(links: DataFrame, by: list[str]) -> DataFrame:
    """(by, node, part) for links (by, i, j): part is the least node reachable within ``by``.

    Links are contracted where they are read, then large-star and small-star steps follow in
    turn until the links stand still; every step is an aggregation and a join.  As soon as
    no more than ``FINISH`` links are left, one task contracts them to the end.
    """
    edges = saved(_contracted(links.filter("i <> j"), by).distinct())
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64(*by, "u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        if now[0] <= FINISH:
            edges = saved(_contracted(edges.select(*by, F.col("v").alias("i"), F.col("u").alias("j")).coalesce(1), by))
            break
        state = now
        both = edges.select(*by, "u", "v").union(edges.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*by, "u").agg(F.min("v").alias("m")).select(*by, "u", F.least("u", "m").alias("m"))
        large = both.join(least, [*by, "u"]).filter("v > u and v <> m").select(*by, "v", F.col("m").alias("u")).distinct()
        down = large.groupBy(*by, "v").agg(F.min("u").alias("m"))
        ends = F.array(F.struct("v"), F.struct(F.col("u").alias("v")))
        edges = saved(large.join(down, [*by, "v"]).select(*by, F.explode(ends).alias("e"), F.col("m").alias("u")).select(*by, "e.v", "u").filter("u <> v").distinct())
    roots = edges.select(*by, F.col("u").alias("node"), F.col("u").alias("part")).distinct()
    return edges.select(*by, F.col("v").alias("node"), F.col("u").alias("part")).union(roots)
