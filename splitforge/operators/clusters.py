"""Butina clustering of a similarity graph.

The sequential rule takes the free entity with the most free neighbours (itself
included; ties to the lowest id), makes it a center with those neighbours, and goes
on until only single entities are left.  With ``dynamic=False`` counts stay those of
the whole graph.  An id may stand for ``size`` entities that are alike: they have the
same neighbours and each other, so they join a cluster together and count ``size`` times.

Clusters never cross connected components.  Components of at most ``LINKS`` links are
solved by the rule itself: those over ``BUNDLE`` links in a task each, smaller ones by
hash in bundles of about that many links.  Larger components:

With counts of the whole graph the order is known beforehand.  An id is a center unless a
center before it is its neighbour, and joins the first such center.  So, round by round, ids
without an open neighbour before them are centers and their neighbours are not (``_in_order``).

Otherwise, a task gets the ids with the highest counts, as many as have ``LEAD`` links
together, with all their neighbours.  Counts only fall, so as long as the best of them stays
ahead of the best that was left out, it is the next center; there the round ends, and what
has been taken leaves the graph (``_leaders``).  A round with one center or more is sure,
and what is left below the bound is solved in one task as above.
The clusters are the sequential ones; results do not depend on these numbers.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, running, saved

LINKS, BUNDLE, LEAD = 2_000_000, 100_000, 2_000_000


def _solve(edges: pd.DataFrame, dynamic: bool) -> tuple[np.ndarray, np.ndarray]:
    """(centers, ids) of all clusters of two ids or more, from links (i, j, size of i, size of j)."""
    ends = [edges[c].to_numpy() for c in ("i", "j", "size", "size_j")]
    i, j, size_i = (np.concatenate([ends[a], ends[b]]) for a, b in ((0, 1), (1, 0), (2, 3)))
    order = np.lexsort((j, i))
    new = np.append(True, (i[order[1:]] != i[order[:-1]]) | (j[order[1:]] != j[order[:-1]]))[: len(i)]
    order = order[new]
    i, j = i[order], j[order]
    node, first, links = np.unique(i, return_index=True, return_counts=True)
    near, ends = np.searchsorted(node, j), first + links
    size = size_i[order][first]
    count = size + np.add.reduceat(size[near], first)
    heap = list(zip((-count).tolist(), range(len(node))))
    heapq.heapify(heap)
    free = np.ones(len(node), bool)
    centers, ids = [], []
    while heap:
        c, k = heapq.heappop(heap)
        if not free[k] or -c != count[k]:
            continue
        around = near[first[k] : ends[k]]
        taken = np.append(k, around[free[around]])
        if len(taken) == 1:
            continue
        free[taken] = False
        centers.append(np.full(len(taken), k))
        ids.append(taken)
        if dynamic:
            touched = np.concatenate([near[first[m] : ends[m]] for m in taken.tolist()])
            lost = np.repeat(size[taken], links[taken])
            np.subtract.at(count, touched, lost)
            touched = np.unique(touched[free[touched]])
            for entry in zip((-count[touched]).tolist(), touched.tolist()):
                heapq.heappush(heap, entry)
    if not ids:
        return node[:0], node[:0]
    return node[np.concatenate(centers)], node[np.concatenate(ids)]


def _in_order(sized: DataFrame, by: list[str]) -> DataFrame:
    """(by, center, id): clusters of two ids or more by counts n of the whole graph; sized has each link both ways (by, i, j, n)."""
    counts = sized.select(*by, F.col("i").alias("j"), F.col("n").alias("n_j")).distinct()
    before = (F.col("n_j") > F.col("n")) | ((F.col("n_j") == F.col("n")) & (F.col("j") < F.col("i")))
    links = saved(sized.join(counts, [*by, "j"]).filter(before).select(*by, F.col("i").alias("late"), F.col("j").alias("early"), F.col("n_j").alias("n")))
    open_, taken = links.select(*by, "late", "early"), None
    while not open_.isEmpty():
        waiting = open_.select(*by, F.col("late").alias("early")).distinct()
        sure = open_.select(*by, "early").distinct().join(waiting, [*by, "early"], "left_anti")
        gone = saved(open_.join(sure, [*by, "early"], "left_semi").select(*by, "late").distinct())
        taken = gone if taken is None else taken.unionByName(gone)
        open_ = open_.join(gone, [*by, "late"], "left_anti").join(gone.withColumnRenamed("late", "early"), [*by, "early"], "left_anti")
        open_ = saved(open_)
    taken = saved(links.select(*by, "late").limit(0) if taken is None else taken)
    of_centers = links.join(taken.withColumnRenamed("late", "early"), [*by, "early"], "left_anti")
    first = saved(of_centers.groupBy(*by, F.col("late").alias("id")).agg(F.max_by("early", F.struct("n", -F.col("early"))).alias("center")))
    return first.select(*by, "center", "id").unionByName(first.select(*by, "center", F.col("center").alias("id")).distinct())


def _lead(edges: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(centers, ids) of the clusters that are sure, from all links (i, j, size_j) of the ids with the highest counts n; the best other is (n_next, next)."""
    edges = edges.sort_values(["i", "j"], ignore_index=True)
    node, first, links = np.unique(edges["i"].to_numpy(), return_index=True, return_counts=True)
    other, near = np.unique(edges["j"].to_numpy(), return_inverse=True)
    size = np.zeros(len(other), np.int64)
    size[near] = edges["size_j"].to_numpy()
    count, ends = edges["n"].to_numpy()[first].copy(), first + links
    at = np.searchsorted(other, node)  # where an id of the highest is among all ends, if it is
    at = np.where((at < len(other)) & (other[np.minimum(at, len(other) - 1)] == node), at, -1)
    mine = np.full(len(other), -1)
    mine[at[at >= 0]] = np.flatnonzero(at >= 0)
    back = np.argsort(near, kind="stable")
    starts = np.searchsorted(near[back], np.arange(len(other) + 1))
    owner = np.repeat(np.arange(len(node)), links)[back]
    bound = None if pd.isna(edges["n_next"].iloc[0]) else (-int(edges["n_next"].iloc[0]), int(edges["next"].iloc[0]))
    heap = list(zip((-count).tolist(), node.tolist(), range(len(node))))
    heapq.heapify(heap)
    free, gone = np.ones(len(other), bool), np.zeros(len(node), bool)
    centers, ids = [], []
    while heap:
        c, name, k = heapq.heappop(heap)
        if gone[k] or -c != count[k]:
            continue
        if bound is not None and (c, name) > bound:
            break
        around = near[first[k] : ends[k]]
        taken = around[free[around]]
        gone[k] = True
        if not len(taken):
            continue
        if at[k] >= 0:
            free[at[k]] = False
        free[taken] = False
        gone[mine[taken][mine[taken] >= 0]] = True
        centers.append(np.full(len(taken) + 1, name))
        ids.append(np.append(name, other[taken]))
        lost = [taken, at[k : k + 1]] if at[k] >= 0 else [taken]
        lost = np.concatenate(lost)
        which = np.repeat(lost, starts[lost + 1] - starts[lost])
        touched = owner[np.concatenate([np.arange(starts[m], starts[m + 1]) for m in lost.tolist()])]
        np.subtract.at(count, touched, size[which])
        touched = np.unique(touched[~gone[touched]])
        for entry in zip((-count[touched]).tolist(), node[touched].tolist(), touched.tolist()):
            heapq.heappush(heap, entry)
    if not ids:
        return node[:0], node[:0]
    return np.concatenate(centers), np.concatenate(ids)


def _leaders(sized: DataFrame, by: list[str]) -> DataFrame:
    """(by, center, id): the next clusters of the sequential rule, one or more for each of ``by``; sized has each link both ways (by, i, j, size of i)."""
    sizes = sized.select(*by, F.col("i").alias("j"), F.col("size").alias("size_j")).distinct()
    each = sized.join(sizes, [*by, "j"])
    counts = saved(each.groupBy(*by, "i").agg((F.sum("size_j") + F.first("size")).alias("n"), F.count("*").alias("links")))
    # the highest counts whose ids have ``LEAD`` links together, one id at least
    ranked = running(counts.withColumn("place", F.struct(-F.col("n"), "i")), by, "place", ["links"])
    high = saved(ranked.withColumn("in", F.col("links_before") < LEAD).select(*by, "i", "n", "in"))
    following = high.filter(~F.col("in")).groupBy(*by).agg(F.max(F.struct("n", (-F.col("i")).alias("m"))).alias("x")).select(*by, F.col("x.n").alias("n_next"), (-F.col("x.m")).alias("next"))
    top = high.filter("in").select(*by, "i", "n").join(following, by, "left")
    schema = sized.select(*by, F.col("i").alias("center"), F.col("i").alias("id")).schema

    def lead(pdf: pd.DataFrame) -> pd.DataFrame:
        centers, found = _lead(pdf)
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * len(found) for c in by}, "center": centers, "id": found})

    return each.join(top, [*by, "i"]).select(*by, "i", "j", "size_j", "n", "n_next", "next").groupBy(*by).applyInPandas(lead, schema)


def _bundled(nodes: DataFrame, by: list[str], most: int) -> DataFrame:
    """nodes (by, i, part, links, ...) of components of at most ``most`` links, with where they are solved: alone, or in a bundle of small ones."""
    few = nodes.groupBy(*by, "part").agg(F.sum("links").alias("all")).filter(F.col("all") <= 2 * most)
    small = few.filter(F.col("all") <= BUNDLE)
    bundles = small.groupBy(*by).agg(F.ceil(F.sum("all") / BUNDLE).alias("bundles"))
    small = small.join(bundles, by).select(*by, "part", F.lit(None).cast("long").alias("alone"), F.pmod(F.xxhash64("part"), "bundles").alias("bundle"))
    alone = few.filter(F.col("all") > BUNDLE).select(*by, "part", F.col("part").alias("alone"), F.lit(None).cast("long").alias("bundle"))
    return nodes.join(small.unionByName(alone), [*by, "part"])


def butina_clusters(ids: DataFrame, pairs: DataFrame, by: list[str], dynamic: bool = True, most: int = LINKS, parts: DataFrame | None = None) -> DataFrame:
    """(by, center, id, size) for ids (by, id[, size]) and linked pairs (by, i, j); size is the cluster's, in entities.

    Components of more than ``most`` links go through rounds until less is left of them.
    ``parts`` (some of by, node, part) are known sets that no link leaves, such as components
    for a wider cutoff; only where one is larger than ``most``, components are looked for.
    Links are moved once to where they are solved: all that is decided before is decided on ids.
    """
    ids = ids if "size" in ids.columns else ids.withColumn("size", F.lit(1).cast("long"))
    both = lambda links: links.select(*by, F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("e")).select(*by, "e.i", "e.j")
    rest = pairs.filter("i <> j").select(*by, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    sizes = ids.select(*by, F.col("id").alias("i"), "size")
    schema = rest.select(*by, F.col("i").alias("center"), F.col("i").alias("id")).schema

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        centers, found = _solve(pdf, dynamic)
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * len(found) for c in by}, "center": centers, "id": found})

    done = []
    while True:
        known, parts = components(rest, by) if parts is None else parts, None
        on = [c for c in by if c in known.columns]
        nodes = both(rest).groupBy(*by, "i").agg(F.count("*").alias("links")).join(known.withColumnRenamed("node", "i"), [*on, "i"])
        nodes = saved(nodes.join(sizes, [*by, "i"]))
        more = nodes.select(*by, "i", "size")
        far = more.select(*by, F.col("i").alias("j"), F.col("size").alias("size_j"))
        near = _bundled(nodes, by, most).select(*by, "i", "alone", "bundle").join(more, [*by, "i"])
        each = rest.join(near, [*by, "i"]).join(far, [*by, "j"])
        done.append(saved(each.groupBy(*by, "alone", "bundle").applyInPandas(solve, schema)))
        large = nodes.groupBy(*by, "part").agg(F.sum("links").alias("all")).filter(F.col("all") > 2 * most)
        left = nodes.join(large, [*by, "part"], "left_semi").select(*by, "i", "size")
        if left.isEmpty():
            break
        rest = saved(rest.join(left, [*by, "i"]).select(*by, "i", "j").distinct())
        if len(on) < len(by):
            continue
        sized = both(rest).join(sizes, [*by, "i"])
        if not dynamic:
            of = sizes.select(*by, F.col("i").alias("j"), F.col("size").alias("of"))
            fixed = sized.join(of, [*by, "j"]).groupBy(*by, "i").agg((F.sum("of") + F.first("size")).alias("n"))
            done.append(_in_order(sized.join(saved(fixed), [*by, "i"]), by))
            break
        found = saved(_leaders(sized, by))
        done.append(found)
        gone = found.select(*by, "id")
        rest = rest.join(gone.withColumnRenamed("id", "i"), [*by, "i"], "left_anti").join(gone.withColumnRenamed("id", "j"), [*by, "j"], "left_anti")
        rest = saved(rest)
        if rest.isEmpty():
            break
    every = done[0]
    for p in done[1:]:
        every = every.unionByName(p)
    single = ids.join(every.select(*by, "id"), [*by, "id"], "left_anti").select(*by, F.col("id").alias("center"), "id")
    every = every.unionByName(single).join(ids.select(*by, "id", "size"), [*by, "id"])
    return every.join(every.groupBy(*by, "center").agg(F.sum("size").alias("whole")), [*by, "center"]).select(*by, "center", "id", F.col("whole").alias("size"))


def of_members(clusters: DataFrame, of: DataFrame, id_: str) -> DataFrame:
    """Clusters of classes as clusters of their members (id, of)."""
    each = clusters.join(of.select(F.col(id_).alias("__id"), F.col("of").alias("id")), "id")
    return each.drop("id").withColumnRenamed("__id", "id").select(*clusters.columns)


def summarize_clusters(clusters: DataFrame, by: list[str]) -> DataFrame:
    sizes = clusters.groupBy(*by, "center").agg(F.max("size").alias("size"))
    return sizes.groupBy(*by).agg(F.count("*").alias("n_clusters"), F.max("size").alias("largest"), F.min("size").alias("smallest"), F.count_if(F.col("size") == 1).alias("n_singletons"))


def cluster_groups(clusters: DataFrame, by: list[str]) -> DataFrame:
    """Clusters as groups for the greedy split: (by, center, n_rows, least)."""
    return clusters.groupBy(*by, "center").agg(F.max("size").alias("n_rows"), F.min("id").alias("least"))
