"""Target counts, random and group-wise splits, split summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import greedy
from .shared import hash_order, matched, numbered, ranked

SPLITS = ("train", "val", "test")
RATIOS = (0.8, 0.1, 0.1)
TOLERANCE = 1e-8


def check_ratios(ratios: tuple[float, ...] = RATIOS) -> None:
    if any(not 0 <= r <= 1 for r in ratios) or abs(sum(ratios) - 1) > TOLERANCE:
        raise ValueError("split fractions must be in [0, 1] and sum to 1")


def compute_target_counts(totals: DataFrame, by: list[str], ratios: tuple[float, ...] = RATIOS) -> DataFrame:
    """(by, split, ord, target) from (by, total): largest remainders first, ties to train, val, test in this order."""
    check_ratios(ratios)
    each = F.array(*[F.struct(F.lit(s).alias("split"), F.lit(k).alias("ord"), F.lit(float(r)).alias("r")) for k, (s, r) in enumerate(zip(SPLITS, ratios))])
    x = totals.select(*by, "total", F.explode(each).alias("s")).select(*by, "total", "s.split", "s.ord", (F.col("total") * F.col("s.r")).alias("raw"))
    x = x.withColumn("whole", F.floor("raw").cast("long"))
    left = F.col("total") - F.sum("whole").over(W.partitionBy(*by))
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(F.col("raw") - F.col("whole")), "ord"))
    return x.select(*by, "split", "ord", (F.col("whole") + F.when(rank <= left, 1).otherwise(0)).cast("long").alias("target"))


POLICIES = {"quota": "share", "post_target": "fill"}


def greedy_split(groups: DataFrame, by: list[str], group: str, policy: str = "quota", ratios: tuple[float, ...] = RATIOS, order: str | None = None, seed: int | None = None) -> DataFrame:
    """(groups' columns, split) for groups (by, group, n_rows): whole groups, largest first.

    Ties in size go by ``order`` (default the group key), or by the md5 of seed and key.  Only
    the histogram of sizes of a ``by`` is folded (see ``greedy``); groups are numbered within
    their size over many tasks and take their splits in parallel.
    """
    check_ratios(ratios)
    rule, tie = POLICIES[policy], F.col(order or group)
    sizes = groups.groupBy(*by, "n_rows").agg(F.count("*").alias("n"))
    each = sizes.groupBy(*by).agg(F.collect_list(F.struct(F.col("n_rows").cast("long").alias("n_rows"), "n")).alias("sizes"))
    runs = each.select(*by, greedy.runs(rule, ratios)("sizes").alias("x")).select(*by, F.explode("x.runs").alias("r"), "x.target").select(*by, "r.*", "target")
    placed = numbered(groups.withColumn("__order", tie if seed is None else hash_order(tie, seed)), [*by, "n_rows"], "__order", "__place")
    name = F.element_at(F.array(*map(F.lit, SPLITS)), greedy.chosen(rule, F.col("__place") - 1) + 1)
    return matched(placed, runs, [*by, "n_rows"]).select(*groups.columns, name.alias("split"))


def random_split(df: DataFrame, key: str, seed: int, ratios: tuple[float, ...] = RATIOS) -> DataFrame:
    """(key, split): rows in hash order cut at the target counts; the same in any engine."""
    check_ratios(ratios)
    rows = ranked(df.select(key, hash_order(F.col(key), seed).alias("h")), [], "h")
    cut = greedy.targets(df.count(), ratios)
    split = F.when(F.col("rank") <= cut[0], SPLITS[0]).when(F.col("rank") <= cut[0] + cut[1], SPLITS[1]).otherwise(SPLITS[2])
    return rows.select(key, split.alias("split"))


def split_summary(assigned: DataFrame, by: list[str]) -> DataFrame:
    """(by, split, n_rows, n_groups, fraction) from assigned groups (by, n_rows, split)."""
    sums = assigned.groupBy(*by, "split").agg(F.sum("n_rows").alias("n_rows"), F.count("*").alias("n_groups"))
    total = F.sum("n_rows").over(W.partitionBy(*by))
    return sums.select(*by, "split", "n_rows", "n_groups", (F.col("n_rows") / total).alias("fraction"))
