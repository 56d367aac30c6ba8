from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import saved
from .readers import input_signature, require_columns


def write_labelled(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)


def write_splits(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Rows with dataset, method, run and split, as CSV folders by these four."""
    require_columns(rows, "dataset", "method", "run", "split")
    rows.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("dataset", "method", "run", "split").option("header", True).csv(path)


def write_split_indices(assigned: DataFrame, path: str) -> None:
    """One JSON row a run with the sorted indices of each split; for splits whose indices fit a row (the file format asks for that)."""
    wide = assigned.groupBy("run").pivot("split", ["train", "val", "test"]).agg(F.array_sort(F.collect_list("idx")))
    wide.select("run", *[F.col(s).alias(f"{s}_idx") for s in ("train", "val", "test")]).write.partitionBy("run").json(path)


def write_cache(df: DataFrame, path: str, source: DataFrame, failures: DataFrame | None = None) -> None:
    """The frame as Parquet, with the signature of the input it was made from, and what failed on the way, beside it."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    if failures is not None:
        failures.write.mode("overwrite").parquet(f"{path}/failures")
    df.sparkSession.createDataFrame([(input_signature(source), failures is not None)], "signature string, failures boolean").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def _meta(spark: SparkSession, path: str, source: DataFrame):
    try:
        found = spark.read.schema("signature string, failures boolean").json(f"{path}/meta").first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return found if found and found.signature == input_signature(source) else None


def read_cache(spark: SparkSession, path: str, source: DataFrame) -> DataFrame | None:
    """The cached frame if it was made from the same input rows, else None."""
    return spark.read.parquet(f"{path}/data") if _meta(spark, path, source) else None


def read_failures(spark: SparkSession, path: str, source: DataFrame) -> DataFrame | None:
    """What failed when the cached frame was made; None without a cache of the same input, or if nothing was kept."""
    found = _meta(spark, path, source)
    return spark.read.parquet(f"{path}/failures") if found and found.failures else None


def cached_pairs(rows: DataFrame, path: str, id_: str, compute: Callable[[DataFrame, str], DataFrame], width: int = 100_000) -> tuple[DataFrame, int]:
    """(pairs, blocks that were computed) of ``compute``, from a cache that follows changes of its input block by block.

    A block is ``width`` neighbouring ids, so appended rows fall into the last ones; a
    signature of its rows tells whether a block has changed.  Pairs (i, j, ...) of two
    unchanged blocks are kept; ``compute(rows, only)`` makes those of which one end has the boolean
    column ``only``.  A new state is a folder of its own, which its description, written last, points to.
    """
    spark = rows.sparkSession
    block = lambda c: F.floor(F.col(c) / width)
    content = F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).cast("string")
    now = saved(rows.groupBy(block(id_).alias("block")).agg(F.concat_ws("-", F.count("*"), content).alias("signature")))
    try:
        state = read_json(spark, f"{path}/state")["state"]
        before, old = spark.read.parquet(f"{path}/{state}/blocks"), spark.read.parquet(f"{path}/{state}/pairs")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        state, before, old = -1, now.limit(0), None
    same = saved(now.join(before, ["block", "signature"]).select("block"))
    changed = now.join(same, "block", "left_anti").count()
    if old is not None and not changed and before.count() == now.count():
        return old, 0
    fresh = rows.withColumn("__block", block(id_)).join(same.select(F.col("block").alias("__block"), F.lit(True).alias("__same")), "__block", "left")
    pairs = compute(fresh.withColumn("only", F.col("__same").isNull()).drop("__block", "__same"), "only")
    if old is not None:
        kept = old.withColumn("block", block("i")).join(same, "block", "left_semi").withColumn("block", block("j")).join(same, "block", "left_semi")
        pairs = pairs.unionByName(kept.drop("block"))
    pairs.write.mode("overwrite").parquet(f"{path}/{state + 1}/pairs")
    now.write.mode("overwrite").parquet(f"{path}/{state + 1}/blocks")
    write_json({"state": state + 1}, spark, f"{path}/state", overwrite=True)
    return spark.read.parquet(f"{path}/{state + 1}/pairs"), changed


def write_json(row: dict, spark: SparkSession, path: str, overwrite: bool = False) -> None:
    """One record as JSON with sorted keys."""
    text = spark.createDataFrame([(json.dumps(row, sort_keys=True),)], "value string")
    text.coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    """One record of any form, from a JSON file or a folder that ``write_json`` made."""
    return json.loads(spark.read.option("wholetext", True).text(path).first()[0])
