"""Pivots to a fixed domain, differences to a baseline, aligned against unaligned means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import percent_text


def pivot_first(rows: DataFrame, by: list[str], row: str, col: str, value: str, row_order: list[str], col_order: list[str]) -> DataFrame:
    """First value a cell, all of row_order and col_order present, absent cells NULL."""
    wide = rows.groupBy(*by, row).pivot(col, col_order).agg(F.first(value, ignorenulls=True))
    frame = rows.select(*by).distinct() if by else rows.sparkSession.range(1).select()
    domain = frame.select(*by, F.explode(F.array(*map(F.lit, row_order))).alias(row))
    return domain.join(wide, [*by, row], "left")


def delta_vs_baseline(rows: DataFrame, by: list[str], row: str, col: str, value: str, baseline: str) -> DataFrame:
    """(by, row, col, delta): value less the baseline row's of the same column; NULL where either is absent."""
    base = rows.filter(F.col(row) == baseline).groupBy(*by, col).agg(F.first(value).alias("__base"))
    return rows.filter(F.col(row) != baseline).join(base, [*by, col], "left").select(*by, row, col, (F.col(value) - F.col("__base")).alias("delta"))


def aligned_effect(deltas: DataFrame, by: list[str], aligned: Column) -> DataFrame:
    """Means of aligned and other deltas, their difference, and it relative to the others' size, with its percent text."""
    means = deltas.groupBy(*by).agg(F.avg(F.when(aligned, F.col("delta"))).alias("aligned_mean"), F.avg(F.when(~aligned, F.col("delta"))).alias("unaligned_mean"))
    diff = F.col("aligned_mean") - F.col("unaligned_mean")
    out = means.withColumn("difference", diff).withColumn("relative_effect", F.try_divide("difference", F.abs("unaligned_mean")))
    return out.withColumn("relative_effect_pct", percent_text(F.col("relative_effect")))
