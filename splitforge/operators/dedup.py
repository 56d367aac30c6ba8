"""Duplicate resolution by key, with the row of the smallest index as the first row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _first(df: DataFrame, key: str, idx: str, *more) -> DataFrame:
    others = [c for c in df.columns if c not in (key, idx)]
    first = F.min_by(F.struct(idx, *others), F.col(idx)).alias("__first")
    return df.groupBy(key).agg(first, F.count("*").alias("n_rows"), *more)


def keep_first(df: DataFrame, key: str, idx: str) -> DataFrame:
    """The first row of each key; a NULL key is a key."""
    return _first(df, key, idx).select(key, "__first.*")


def mean_labels(df: DataFrame, key: str, idx: str, labels: list[str]) -> DataFrame:
    """First row of each key; labels of repeated keys are means of what is numeric, single rows stay as they are."""
    means = [F.avg(F.expr(f"try_cast(`{c}` as double)")).alias(f"__{c}") for c in labels]
    out = _first(df, key, idx, *means)
    values = {c: F.when(F.col("n_rows") > 1, F.col(f"__{c}")).otherwise(F.expr(f"try_cast(__first.`{c}` as double)")).alias(c) for c in labels}
    others = [c for c in df.columns if c not in (key, *labels)]
    return out.select(key, *[F.col(f"__first.{c}") for c in others], *values.values(), "n_rows")


def drop_conflicts(df: DataFrame, key: str, idx: str, labels: list[str]) -> DataFrame:
    """First row of the keys whose rows all agree in all labels (NULL equals NULL); other keys go as a whole."""
    out = _first(df, key, idx, F.count_distinct(F.struct(*labels)).alias("__labels"))
    return out.filter("__labels = 1").select(key, "__first.*", "n_rows")


def merge_tasks(df: DataFrame, key: str, idx: str, labels: list[str]) -> DataFrame:
    """Each label's first value over a key; keys with two values of any one label go. NULLs never conflict."""
    each = [F.count_distinct(c).alias(f"__n_{c}") for c in labels]
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(idx))).alias(f"__{c}") for c in labels]
    out = _first(df, key, idx, *each, *firsts)
    for c in labels:
        out = out.filter(F.col(f"__n_{c}") <= 1)
    others = [c for c in df.columns if c not in (key, *labels)]
    return out.select(key, *[F.col(f"__first.{c}") for c in others], *[F.col(f"__{c}").alias(c) for c in labels], "n_rows")


def cleaning_summary(df: DataFrame, key: str, by: list[str], labels: list[str]) -> DataFrame:
    """Rows, missing keys, valid rows, repeated keys, conflicting keys and rows removed, per ``by``."""
    keyed = df.groupBy(*by, key).agg(F.count("*").alias("n"), F.count_distinct(F.struct(*labels)).alias("v"))
    has, many = F.col(key).isNotNull(), F.col("n") > 1
    clash = has & many & (F.col("v") > 1)
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return keyed.groupBy(*by).agg(
        F.sum("n").alias("total_rows"),
        n(~has).alias("missing_rows"),
        n(has).alias("valid_rows"),
        F.count_if(has & many).alias("duplicate_groups"),
        F.count_if(clash).alias("conflict_groups"),
        F.coalesce(F.sum(F.when(clash, F.col("n")).when(has, F.col("n") - 1)), F.lit(0)).cast("long").alias("removed_rows"),
    )
