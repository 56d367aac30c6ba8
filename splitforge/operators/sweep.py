from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clusters import butina_clusters, cluster_groups, of_members, summarize_clusters
from .leaders import leader_clusters
from .shared import components, saved
from .similarity import combine_distances, dense_sums, entity_classes, two_distances
from .splits import greedy_split, split_summary


def sweep_tunable_splits(entities: DataFrame, id_: str, weights: list[float], cutoffs: list[float]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clusters, splits, summary) for every weight and cutoff; entities: id, words, counts.

    Distances are between classes of equal entities.  Where no index prunes, all pairs are met
    in blocks and no link is written (``leaders``).  Else the grid multiplies only the linked
    pairs.  Links of a low cutoff are among those of a higher one, so connected components are
    found once a weight, at the widest cutoff, and serve all its cutoffs: a task solves one
    part of one weight and cutoff.
    """
    if any(not 0 <= w <= 1 for w in weights):
        raise ValueError("weights must be in [0, 1]")
    by = ["weight", "cutoff"]
    found, of = entity_classes(entities, id_)
    dense = dense_sums(found, id_, max(cutoffs))
    if dense is not None:
        clusters = saved(leader_clusters(*dense, [(float(w), float(c)) for w in weights for c in cutoffs]))
    else:
        clusters = saved(_linked_clusters(found, id_, weights, cutoffs))
    splits = saved(greedy_split(cluster_groups(clusters, by), by, "center", "post_target", order="least"))
    sizes = split_summary(splits, by).groupBy(*by).pivot("split", ["train", "val", "test"]).agg(F.first("n_rows")).na.fill(0)
    return of_members(clusters, of, id_), splits, summarize_clusters(clusters, by).join(sizes, by)


def _linked_clusters(found: DataFrame, id_: str, weights: list[float], cutoffs: list[float]) -> DataFrame:
    """Clusters from a table of links, where an index finds them among few candidates."""
    by = ["weight", "cutoff"]
    grid = F.array(*[F.struct(F.lit(w).alias("weight"), F.lit(c).alias("cutoff")) for w in weights for c in cutoffs])
    total = lambda w: combine_distances(F.col("d_structure"), F.col("d_counts"), w).cast("double")
    pairs = saved(two_distances(found, id_, max(cutoffs), weights))
    each = pairs.select("i", "j", F.explode(F.array(*[F.struct(F.lit(w).alias("weight"), total(F.lit(w)).alias("d")) for w in weights])).alias("x")).select("i", "j", "x.*")
    each = saved(each.filter(F.col("d") <= max(cutoffs)))
    linked = each.select("weight", "i", "j", "d", F.explode(F.array(*map(F.lit, cutoffs))).alias("cutoff")).filter("d <= cutoff").select(*by, "i", "j")
    ids = found.select(F.col(id_).alias("id"), "size", F.explode(grid).alias("g")).select("g.*", "id", "size")
    return butina_clusters(ids, linked, by, dynamic=False, parts=components(each.select("weight", "i", "j"), ["weight"]))
