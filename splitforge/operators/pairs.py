"""Bit signatures, count vectors and what describes single pairs of them; joins by a threshold are in ``similarity``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .similarity import popcount


def signature_words(bits: Column, n_bits: int, word: int = 62) -> Column:
    """array<bigint> of ``word`` bits each, from an array whose positive entries are set bits."""
    words = []
    for lo in range(0, n_bits, word):
        w = F.lit(0).cast("long")
        for k in range(lo, min(lo + word, n_bits)):
            w = w.bitwiseOR(F.when(F.get(bits, k) > 0, F.lit(1 << (k - lo)).cast("long")).otherwise(F.lit(0).cast("long")))
        words.append(w)
    return F.array(*words)


def tanimoto(x: Column, y: Column) -> Column:
    """Shared bits over bits of either, of two arrays of words; 1 for two empty signatures."""
    bits = lambda f: popcount(F.zip_with(x, y, f))
    return F.coalesce(F.try_divide(bits(lambda a, b: a.bitwiseAND(b)), bits(lambda a, b: a.bitwiseOR(b))), F.lit(1.0))


def count_vectors(counts: DataFrame, id_: str, feature: str, cnt: str) -> DataFrame:
    """(id, counts map): one map an entity, zeros left out."""
    return counts.filter(F.col(cnt) > 0).groupBy(id_).agg(F.map_from_entries(F.collect_list(F.struct(F.col(feature).cast("string"), F.col(cnt).cast("double")))).alias("counts"))


def generate_param_grid(low: float, high: float, gap: float) -> list[float]:
    """low, low + gap, ... and high, in decimal steps, both ends included."""
    from decimal import Decimal

    lo, hi, step = (Decimal(str(x)) for x in (low, high, gap))
    if step <= 0 or hi < lo:
        raise ValueError("gap must be positive and high at least low")
    out = [lo + k * step for k in range(int((hi - lo) / step) + 1)]
    return [float(x) for x in (out if out[-1] == hi else [*out, hi])]


def active_rows(counts: DataFrame, id_: str, feature: str, cnt: str, a: int, b: int) -> DataFrame:
    """Features that a or b has, with both counts, whose they are, and their gap."""
    mine = lambda v, name: counts.filter((F.col(id_) == v) & (F.col(cnt) > 0)).select(feature, F.col(cnt).alias(name))
    x = mine(a, "count_a").join(mine(b, "count_b"), feature, "full").na.fill(0, ["count_a", "count_b"])
    whose = F.when(F.col("count_b") == 0, "a_only").when(F.col("count_a") == 0, "b_only").otherwise("shared")
    gap = F.abs(F.col("count_a") - F.col("count_b")) / F.greatest("count_a", "count_b")
    return x.select(feature, "count_a", "count_b", whose.alias("membership"), gap.alias("gap"))


def vocabulary_summary(counts: DataFrame, vocabulary: DataFrame, feature: str, id_: str, cnt: str) -> DataFrame:
    """(feature, n_entities, total, ever_hit) for every vocabulary entry."""
    hits = counts.filter(F.col(cnt) > 0).groupBy(feature).agg(F.count_distinct(id_).alias("n_entities"), F.sum(cnt).alias("total"))
    return vocabulary.join(hits, feature, "left").na.fill(0, ["n_entities", "total"]).withColumn("ever_hit", F.col("n_entities") > 0)


def vocabulary(counts: DataFrame, feature: str, most: int = 10_000) -> list[str]:
    """The features in order, to be columns; an error if there are more than a wide table can have."""
    names = [r[0] for r in counts.select(feature).distinct().orderBy(feature).limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} features; use the long form")
    return names


def feature_matrix(counts: DataFrame, id_: str, feature: str, cnt: str, vocabulary: list[str]) -> DataFrame:
    """One column a vocabulary entry, zeros where absent."""
    wide = counts.groupBy(id_).pivot(feature, vocabulary).agg(F.sum(cnt))
    return wide.na.fill(0, vocabulary)
