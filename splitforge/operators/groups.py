"""Group sizes and how concentrated a dataset is in few groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean_text, safe_ratio

NO_GROUP = "[NO_GROUP]"


def group_counts(df: DataFrame, group: str, by: list[str] | None = None) -> DataFrame:
    """(by, group, n_rows); a missing or blank group is ``[NO_GROUP]``."""
    label = F.coalesce(clean_text(F.col(group)), F.lit(NO_GROUP)).alias(group)
    return df.select(*(by or []), label).groupBy(*(by or []), group).agg(F.count("*").alias("n_rows"))


def top_groups(counts: DataFrame, group: str, k: int = 5) -> DataFrame:
    return counts.orderBy(F.desc("n_rows"), F.asc(group)).limit(k)


def concentration(counts: DataFrame, group: str, by: list[str], top: int = 5) -> DataFrame:
    """Totals, share of the empty group, top-1 and top-5 shares, shares of groups of size 1 to 3, and Gini, per ``by``.

    All of it follows from the histogram of sizes, of which n rows have at most sqrt(2 n): k
    groups of one size hold k places in a row, whose ranks sum up in closed form.
    """
    empty = F.coalesce(F.sum(F.when(F.col(group) == NO_GROUP, F.col("n_rows"))), F.lit(0))
    sizes = counts.groupBy(*by, "n_rows").agg(F.count("*").alias("k"), empty.alias("empty"))
    n, total = F.sum("k"), F.sum(F.col("k") * F.col("n_rows"))
    of_size = lambda k: safe_ratio(F.coalesce(F.sum(F.when(F.col("n_rows") == k, F.col("k"))), F.lit(0)), n)
    x = sizes.groupBy(*by).agg(
        total.alias("total_rows"),
        n.alias("total_groups"),
        safe_ratio(F.sum("empty"), total).alias("no_group_ratio"),
        safe_ratio(F.max("n_rows"), total).alias("top1_ratio"),
        of_size(1).alias("singleton_ratio"),
        of_size(2).alias("doubleton_ratio"),
        of_size(3).alias("tripleton_ratio"),
        F.sort_array(F.collect_list(F.struct(F.col("n_rows").alias("size"), "k"))).alias("up"),
    )

    def largest(acc: Column, s: Column) -> Column:
        taken = F.least(s["k"], F.lit(top) - acc["groups"])
        return F.struct((acc["groups"] + taken).alias("groups"), (acc["rows"] + taken * s["size"]).alias("rows"))

    def ranks(acc: Column, s: Column) -> Column:
        """Adds the ranks acc.below + 1 ... acc.below + k, each times the size."""
        k = s["k"].cast("double")
        return F.struct((acc["below"] + k).alias("below"), (acc["sum"] + s["size"] * (k * acc["below"] + k * (k + 1) / 2)).alias("sum"))

    zero = F.lit(0).cast("long")
    most = F.aggregate(F.reverse("up"), F.struct(zero.alias("groups"), zero.alias("rows")), largest)["rows"]
    weighted = F.aggregate("up", F.struct(F.lit(0.0).alias("below"), F.lit(0.0).alias("sum")), ranks)["sum"]
    gini = F.try_divide(2.0 * weighted, F.col("total_groups") * F.col("total_rows").cast("double")) - (F.col("total_groups") + 1) / F.col("total_groups")
    names = ["total_rows", "total_groups", "no_group_ratio", "top1_ratio", "top5_ratio", "singleton_ratio", "doubleton_ratio", "tripleton_ratio", "gini"]
    return x.withColumns({"top5_ratio": safe_ratio(most, F.col("total_rows")), "gini": F.coalesce(gini, F.lit(0.0))}).select(*by, *names)
