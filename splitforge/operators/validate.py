"""Checks that return the offending rows; ``require_empty`` turns them into errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_uniqueness(df: DataFrame, candidates: list[list[str]]) -> DataFrame:
    """(columns, n_rows, n_keys, n_repeated_keys, is_unique) for each candidate key."""
    out = None
    for cols in candidates:
        keyed = df.groupBy(*cols).agg(F.count("*").alias("n"))
        one = keyed.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"), F.count_if(F.col("n") > 1).alias("n_repeated_keys"))
        one = one.select(F.lit(",".join(cols)).alias("columns"), "n_rows", "n_keys", "n_repeated_keys", (F.col("n_repeated_keys") == 0).alias("is_unique"))
        out = one if out is None else out.unionByName(one)
    return out


def unmatched(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of left without a partner; NULL keys match NULL keys."""
    cond = [left[c].eqNullSafe(right[c]) for c in on]
    return left.join(right.select(*on).distinct(), cond, "left_anti")


def map_rows(rows: DataFrame, full: DataFrame, on: list[str], idx: str) -> DataFrame:
    """rows with the ``idx`` of their one partner in full; NULL keys match NULL keys; unmatched rows get NULL."""
    target = full.select(*[F.col(c).alias(f"__{c}") for c in on], idx)
    cond = None
    for c in on:
        one = rows[c].eqNullSafe(F.col(f"__{c}"))
        cond = one if cond is None else cond & one
    return rows.join(target, cond, "left").drop(*[f"__{c}" for c in on])


def repeated_targets(mapped: DataFrame, idx: str) -> DataFrame:
    return mapped.groupBy(idx).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def split_overlap(assigned: DataFrame, by: list[str], idx: str) -> DataFrame:
    """Ids that are in more than one split of a run."""
    return assigned.groupBy(*by, idx).agg(F.count_distinct("split").alias("n_splits")).filter("n_splits > 1")


def out_of_range(assigned: DataFrame, idx: str, n: int) -> DataFrame:
    return assigned.filter((F.col(idx) < 0) | (F.col(idx) >= n))


def require_empty(df: DataFrame, what: str, show: int = 5) -> None:
    if found := df.limit(show).collect():
        raise ValueError(f"{what}: {', '.join(map(str, found))}")
