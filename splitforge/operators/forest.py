"""Random forests whose trees are dealt over the tasks.

Features are cut once into at most ``BINS`` codes, by quantiles of the training rows.  A
task holds the codes of all rows, one byte a feature, and grows its trees one after the
other, a level of nodes at a time: the sums of each node by feature and code give the best
cut.  Rows to predict go down with the training rows, so no tree is kept or sent: only
what the trees of a task say together about each row leaves it.

A tree draws rows by a Poisson rule and a node draws its features, both by hashes of the
seed, the tree and the row's id or the node, so results do not depend on partitions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import saved

BINS, CELLS, ROWS, TASKS, ONE = 32, 1 << 18, 1 << 15, 24, 1 << 32
POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 17)]))


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 even bits from 64 bits."""
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x


def _seeded(seed: int, tree: int, what: int) -> np.uint64:
    return _mixed(np.array([(seed << 40) + (tree << 8) + what + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0]


def drawn(row: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often a tree draws each row, by the row's hash: Poisson with mean 1."""
    u = (_mixed(row.view(np.uint64) ^ _seeded(seed, tree, 0)) >> np.uint64(11)) / float(1 << 53)
    return np.searchsorted(POISSON, u, "right")


def features_of(path: np.ndarray, n: int, pick: int, seed: int, tree: int) -> np.ndarray:
    """The features that each node may cut, in order; nodes are named by their paths from the root (1)."""
    mixed = _mixed(path.astype(np.uint64)[:, None] * np.uint64(n) + np.arange(n, dtype=np.uint64) ^ _seeded(seed, tree, 1))
    return np.sort(np.argpartition(mixed, pick - 1, axis=1)[:, :pick], axis=1)


def _sums(at: np.ndarray, n: int, y: np.ndarray, weight: np.ndarray, classes: int) -> list[np.ndarray]:
    """The weights of each class by ``at``, or without classes those of y and of all."""
    if classes:
        return list(np.bincount(at + y * n, weight, classes * n).reshape(classes, n))
    return [np.bincount(at, weight * y, n), np.bincount(at, weight, n)]


def best_cuts(codes: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray, features: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature, highest code on the left) that lowers the impurity of each node most, -1 where no code differs."""
    pick, n = features.shape[1], codes.shape[1]
    order = np.argsort(at, kind="stable")
    codes, at, y, weight = codes[order].reshape(-1), at[order], y[order], weight[order]
    step = max(1, CELLS // (pick * BINS))
    feature, cut = np.full(len(features), -1), np.zeros(len(features), np.int64)
    for lo in range(0, len(features), step):
        hi = min(lo + step, len(features))
        a, b = np.searchsorted(at, [lo, hi])
        sums = None
        for c in range(a, b, ROWS):
            d = min(c + ROWS, b)
            keys = features[at[c:d]]
            keys += np.arange(c * n, d * n, n)[:, None]
            keys = codes.take(keys).astype(np.int64)
            keys += ((at[c:d] - lo) * (pick * BINS))[:, None]
            keys += np.arange(0, pick * BINS, BINS)
            own = _sums(keys.reshape(-1), (hi - lo) * pick * BINS, np.repeat(y[c:d], pick), np.repeat(weight[c:d], pick), classes)
            sums = own if sums is None else [s + t for s, t in zip(sums, own)]
        sums = [np.cumsum(s.reshape(hi - lo, pick, BINS), axis=2) for s in sums]
        whole = [s[:, :1, -1:] for s in sums]
        w, every = (sum(sums[1:], sums[0]), sum(whole[1:], whole[0])) if classes else (sums.pop(), whole.pop())
        rest = every - w
        some = (w > 1e-12 * every) & (rest > 1e-12 * every)
        gain = np.zeros(w.shape)
        with np.errstate(divide="ignore", invalid="ignore"):
            for part, of in zip(sums, whole):
                other = of - part
                part *= part
                part /= w
                other *= other
                other /= rest
                gain += part
                gain += other
        gain[~some] = -1
        gain = gain.reshape(hi - lo, -1)
        best = gain.argmax(1)
        found = np.flatnonzero(gain[np.arange(hi - lo), best] >= 0)
        feature[lo + found] = features[lo + found, best[found] // BINS]
        cut[lo + found] = best[found] % BINS
    return feature, cut


def leaf_means(codes: np.ndarray, row: np.ndarray, y: np.ndarray, weight: np.ndarray, classes: int, pick: int, depth: int, seed: int, tree: int) -> np.ndarray:
    """What one tree says about each row: the shares of the classes in its leaf, or without classes the mean of y; rows of weight 0 only go down."""
    out = np.zeros((len(row), max(classes, 1)))
    weight = weight * drawn(row, seed, tree)
    if not weight.any():
        return out
    rows, node, path = np.arange(len(row)), np.zeros(len(row), np.int64), np.ones(1, np.int64)
    for level in range(depth + 1):
        mine = weight[rows] > 0
        own, at = rows[mine], node[mine]
        sums = _sums(at, len(path), y[own], weight[own], classes)
        means = np.stack(sums if classes else sums[:1], 1) / (sum(sums) if classes else sums[1])[:, None]
        if classes:
            several = sum(s > 0 for s in sums) > 1
        else:
            low, high = np.full(len(path), np.inf), np.full(len(path), -np.inf)
            np.minimum.at(low, at, y[own])
            np.maximum.at(high, at, y[own])
            several = low < high
        feature, cut = np.full(len(path), -1), np.zeros(len(path), np.int64)
        mixed = np.flatnonzero(several & (level < depth))
        if len(mixed):
            number = np.full(len(path), -1)
            number[mixed] = np.arange(len(mixed))
            at = number[at]
            own, at = own[at >= 0], at[at >= 0]
            features = features_of(path[mixed], codes.shape[1], pick, seed, tree)
            feature[mixed], cut[mixed] = best_cuts(codes[own], at, y[own], weight[own], features, classes)
        chosen = feature[node]
        ends = chosen < 0
        out[rows[ends]] = means[node[ends]]
        rows, node = rows[~ends], node[~ends]
        if not len(rows):
            break
        right = codes[rows, chosen[~ends]] > cut[node]
        inner = np.flatnonzero(feature >= 0)
        first = np.zeros(len(path), np.int64)
        first[inner] = 2 * np.arange(len(inner))
        path, node = (2 * path[inner][:, None] + [0, 1]).reshape(-1), first[node] + right
    return out


def coded(rows: DataFrame, features: str, train: str) -> tuple[DataFrame, int]:
    """rows with ``codes``, a byte a feature, instead of the features, cut by quantiles of the rows with ``train``; and how many features there are."""
    each = rows.filter(train).select(F.posexplode(F.col(features).cast("array<double>")).alias("k", "x"))
    at = [k / (BINS - 1) for k in range(BINS - 1)]
    found = each.groupBy("k").agg(F.percentile_approx("x", at, 10_000).alias("cuts")).collect()
    cuts = [np.unique(r.cuts) for r in sorted(found, key=lambda r: r.k)]
    rest = [c for c in rows.columns if c != features]

    def run(batches):
        for batch in batches:
            lists = batch.column(len(rest)).to_numpy(zero_copy_only=False)
            x = np.array(lists.tolist(), np.float64).reshape(len(lists), len(cuts))
            codes = np.stack([np.searchsorted(c, x[:, k]) for k, c in enumerate(cuts)], 1).astype(np.uint8) if cuts else np.zeros((len(x), 0), np.uint8)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([c.tobytes() for c in codes], pa.binary())], names=[*rest, "codes"])

    types = dict(rows.dtypes)
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in rest], "codes binary"])
    return rows.select(*rest, F.col(features).cast("array<double>")).mapInArrow(run, schema), len(cuts)


def forest_means(rows: DataFrame, features: str, weights: list[float] | None, trees: int, depth: int, share: float, seed: int) -> DataFrame:
    """(id, means): the mean over all trees of what they say about each id that is asked for.

    ``rows``: id, hash, y, train, asked, features; those with ``train`` fit the trees, and an id may come once for that and once to be
    asked.  ``weights`` are those of the classes 0, 1, ...; without weights, y is a number.
    """
    binned, n = coded(rows, features, "train")
    once = binned.groupBy("id", "hash").agg(F.max(F.when(F.col("train"), F.col("y"))).alias("y"), F.bool_or("train").alias("train"), F.bool_or("asked").alias("asked"), F.first("codes").alias("codes"))
    once = saved(once)
    pick, k = max(1, round(n * share)), len(weights or [])
    keys = min(trees, max(TASKS, 2 * rows.sparkSession.sparkContext.defaultParallelism))

    def solve(key: tuple[pa.Scalar, ...], held: pa.Table) -> pa.Table:
        row, train, asked = held.column("hash").to_numpy(), *(held.column(c).to_numpy().astype(bool) for c in ("train", "asked"))
        y = np.nan_to_num(held.column("y").to_numpy().astype(float))
        y = y.astype(np.int64) if k else y
        codes = np.frombuffer(b"".join(held.column("codes").to_pylist()), np.uint8).reshape(len(row), n)
        weight = np.array(weights)[y] * train if k else train.astype(float)
        total = np.zeros((len(row), max(k, 1)))
        for tree in range(key[0].as_py(), trees, keys):
            said = leaf_means(codes, row, y, weight, k, pick, depth, seed, tree)
            total += np.round(said * ONE) if k else said
        return pa.table({"id": held.column("id"), **{f"m{c}": t for c, t in enumerate(total.T)}}).filter(pa.array(asked))

    each = F.explode(F.sequence(F.lit(0), F.lit(keys - 1))).alias("key")
    dealt = once.select(each, "id", "hash", "y", "train", "asked", "codes").repartition(4 * keys, "key")
    names = [f"m{c}" for c in range(max(k, 1))]
    told = dealt.groupBy("key").applyInArrow(solve, ", ".join([f"id {dict(rows.dtypes)['id']}", *[f"{m} double" for m in names]]))
    return told.groupBy("id").agg(F.array(*[F.sum(m) / (trees * (ONE if k else 1)) for m in names]).alias("means"))
