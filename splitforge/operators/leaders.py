"""Butina clusters by counts of the whole graph, for many settings at once and without a table of links.

For graphs in which a good part of all pairs are links: with each setting (weight of two
distances, cutoff) links grow with the square of the rows, so none is written.  All pairs are
met once in blocks, and only the number of neighbours leaves a task.  The order of the
sequential rule is then known: an id is a center unless a center before it is its neighbour,
and joins the first such center.  A round takes the first ids that are still open (``HEAD``
a setting), finds the centers among them in one task a setting, sends these to all rows,
and every open row looks for its first center.  What the head holds is settled then, and
often much more.

A row's distances of counts to a block are taken once for all rows with the same counts.
They and the size of a signature say how many bits a linked row must share at least, a whole
number; where rounding could change it, the distance itself decides.  So a pair costs one
popcount and a comparison of bytes a setting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import in_blocks
from .shared import numbered, saved
from .signatures import centers_among, codes_of, first_center, packed
from .similarity import signature_bits

BLOCK, HEAD, STEP, RANKS, NEAR, TILE = 32_768, 32_768, 64, 256, 1e-9, 1 << 18
COLUMNS, MOST = 32_768, 1e200


class Rows:
    """One block: ids, packed signatures, and counts of features (features down) with what divides by them."""

    def __init__(self, rows: pa.Table | pa.RecordBatch, sums: list[str]) -> None:
        self.id, self.codes = rows.column("id").to_numpy(), codes_of(rows)
        self.counts = np.stack([rows.column(s).to_numpy() for s in sums]) if sums else np.zeros((0, len(self.id)))
        self._derive()

    def _derive(self) -> None:
        self.bits = self.codes.size.astype(np.float64)
        self.over = np.where(self.counts > 0, 1 / np.where(self.counts > 0, self.counts, 1), MOST)
        self.words = [np.ascontiguousarray(self.codes.words[:, k]) for k in range(self.codes.words.shape[1])]

    def __len__(self) -> int:
        return len(self.id)

    def take(self, at: np.ndarray | slice) -> Rows:
        out = object.__new__(Rows)
        out.id, out.codes, out.counts = self.id[at], self.codes.take(at), np.ascontiguousarray(self.counts[:, at])
        out._derive()
        return out


def gaps(a: Rows, k: int, b: Rows) -> np.ndarray:
    """The distance of counts of row k of a to every row of b, but for rounding."""
    kept, x, y = np.zeros(len(b)), np.empty(len(b)), np.empty(len(b))
    lacking = np.flatnonzero(a.counts[:, k] == 0)
    for f in np.flatnonzero(a.counts[:, k]).tolist():
        v = float(a.counts[f, k])
        np.multiply(b.over[f], v, out=x)
        np.multiply(b.counts[f], 1 / v, out=y)
        kept += np.minimum(x, y, out=x)
    own = len(a.counts) - len(lacking)
    if own and not len(lacking):
        kept *= -1 / own
        kept += 1
        return kept
    either = own + (b.counts[lacking] > 0).sum(0)
    return np.where(either > 0, 1 - kept / np.maximum(either, 1), 0.0)


def exact_gaps(a: Rows, k: int, b: Rows, at: np.ndarray) -> np.ndarray:
    """The distance of counts of row k of a to some rows of b, features in order."""
    x, y = a.counts[:, k, None], b.counts[:, at]
    if not len(y):
        return np.zeros(len(at))
    high = np.maximum(x, y)
    some = high > 0
    gap = np.where(some, np.abs(x - y) / np.where(some, high, 1), 0)
    return np.cumsum(gap, axis=0)[-1] / np.maximum(some.sum(0), 1)


def exact_total(structure: np.ndarray, counts: np.ndarray, weight: float) -> np.ndarray:
    return np.clip(weight * structure + (1 - weight) * counts, 0, 1).astype(np.float32).astype(np.float64)


def _structure(shared: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.where(sizes > shared, 1 - shared / np.maximum(sizes - shared, 1), 0.0)


class Setting:
    """A weight and a cutoff: which rows are linked, as ``combine_distances`` says."""

    def __init__(self, weight: float, cutoff: float, width: int) -> None:
        self.weight, self.cutoff, self.width = weight, cutoff, width
        self.kind = np.uint8 if width < 127 else np.uint16 if width < 32_767 else np.uint32
        self.slack = NEAR * (width + 1) / weight if weight else 0
        # the middle between the last single that is within the cutoff and the next
        last = np.float32(cutoff) if float(np.float32(cutoff)) <= cutoff else np.nextafter(np.float32(cutoff), np.float32(-1))
        self.limit = (float(last) + float(np.nextafter(last, np.float32(2)))) / 2
        self.table = np.zeros(2 * width + 1, self.kind)  # by the sum of sizes, for signatures alone
        for s in range(2 * width + 1):
            shared = np.arange(s // 2 + 1)
            enough = exact_total(_structure(shared, np.full(len(shared), s)), np.zeros(len(shared)), 1.0) <= cutoff
            self.table[s] = np.argmax(enough) if enough.any() else s // 2 + 1

    def by_counts(self, a: Rows, k: int, b: Rows, d: np.ndarray) -> np.ndarray:
        """Whether each row of b is linked to row k of a by the distances of counts alone, d."""
        out = d <= self.limit
        x = d - self.limit
        near = np.abs(x, out=x) <= NEAR
        if np.count_nonzero(near):
            at = np.flatnonzero(near)
            out[at] = exact_total(np.zeros(len(at)), exact_gaps(a, k, b, at), 0.0) <= self.cutoff
        return out

    def share(self, d: np.ndarray) -> np.ndarray:
        """The part of both sizes' sum that must be shared at these distances of counts."""
        x = -(1 - self.weight) / self.weight * d
        x += self.limit / self.weight  # the widest distance of signatures
        np.minimum(x, 1.5, out=x)
        out = 1 - x
        out /= np.subtract(2, x, out=x)
        return out

    def least(self, a: Rows, k: int, b: Rows, share: np.ndarray | None, sizes: np.ndarray | None) -> np.ndarray:
        """The number of bits that each row of b must share with row k of a to be linked; sizes are summed."""
        if self.weight == 1:
            return self.table[b.codes.size + a.codes.size[k]]
        low = share * sizes
        low -= self.slack
        out = np.ceil(low)
        near = np.subtract(out, low, out=low) <= 2 * self.slack
        np.maximum(out, 0, out=out)
        if np.count_nonzero(near):
            at = np.flatnonzero(near)
            shared, whole = out[at].astype(np.int64), b.codes.size[at] + a.codes.size[k]
            total = exact_total(_structure(shared, whole), exact_gaps(a, k, b, at), self.weight)
            out[at] += total > self.cutoff
        return out.astype(self.kind)


def shared_bits(a: Rows, rows: np.ndarray, b: Rows, kind: type) -> np.ndarray:
    out = np.bitwise_count(a.words[0][rows, None] & b.words[0]).astype(kind, copy=False)
    for x, y in zip(a.words[1:], b.words[1:]):
        out = out + np.bitwise_count(x[rows, None] & y)
    return out


def linked_to(a: Rows, k: int, b: Rows, setting: Setting) -> np.ndarray:
    """Whether each row of b is linked to row k of a."""
    if not setting.weight:
        return setting.by_counts(a, k, b, gaps(a, k, b))
    share = setting.share(gaps(a, k, b)) if setting.weight < 1 else None
    return shared_bits(a, np.array([k]), b, setting.kind)[0] >= setting.least(a, k, b, share, b.bits + a.bits[k])


def leaders(rows: Rows, setting: Setting) -> np.ndarray:
    """Which of the rows, in their order, are centers."""
    if setting.weight == 1:
        return centers_among(rows.codes, setting.table)
    centers, open_, at = [], rows, np.arange(len(rows))
    while len(at):
        free = np.ones(len(at), bool)
        for _ in range(STEP):
            k = int(free.argmax())
            if not free[k]:
                break
            centers.append(at[k])
            free &= ~linked_to(open_, k, open_, setting)
            free[k] = False
        open_, at = open_.take(np.flatnonzero(free)), at[free]
    return np.array(centers, np.int64)


def first_leader(rows: Rows, centers: Rows, setting: Setting) -> np.ndarray:
    """The number of the first center that each row is linked to, -1 for none."""
    if setting.weight == 1:
        return first_center(rows.codes, centers.codes, setting.table)
    out, at = np.full(len(rows), -1), np.arange(len(rows))
    for lo in range(0, len(centers), STEP):
        at = at[out[at] < 0]
        if not len(at):
            break
        some = rows.take(at)
        for k in range(lo, min(lo + STEP, len(centers))):
            near = at[linked_to(centers, k, some, setting)]
            out[near[out[near] < 0]] = k
    return out


def neighbour_weights(a: Rows, b: Rows, settings: list[Setting]) -> tuple[np.ndarray, np.ndarray]:
    """For every setting the summed weights of the rows that each row of a, and of b, is linked to."""
    n_a, n_b = np.zeros((len(settings), len(a)), np.int64), np.zeros((len(settings), len(b)), np.int64)
    alone, mixed = ([(k, s) for k, s in enumerate(settings) if (s.weight > 0) is some] for some in (False, True))
    counts, behind = any(s.weight < 1 for s in settings), np.argsort(b.codes.weight != 1, kind="stable")
    b = b.take(behind)  # rows of more than one entity last
    order = np.lexsort([a.codes.size, *a.counts])
    value, size = a.counts[:, order], a.codes.size[order]
    new = np.append(True, (value[:, 1:] != value[:, :-1]).any(0))[: len(order)]
    part = new | np.append(True, size[1:] != size[:-1])[: len(order)]
    cuts = [*np.flatnonzero(new).tolist(), len(order)]
    parts = np.append(np.flatnonzero(part), len(order))
    step = max(1, min(255, TILE // COLUMNS))
    for left in range(0, len(b), COLUMNS):
        own = b if len(b) <= COLUMNS else b.take(slice(left, left + COLUMNS))
        of, held = slice(left, left + len(own)), 0
        few = int(np.searchsorted(own.codes.weight != 1, True))
        extra = own.codes.weight[few:] - 1
        bytes_ = np.zeros((len(settings), len(own)), np.uint8)
        tables: dict[tuple[int, int], np.ndarray] = {}
        for lo, hi in zip(cuts, cuts[1:]):
            first, run = int(order[lo]), order[lo:hi]
            d = gaps(a, first, own) if counts else None
            for k, setting in alone:
                near = setting.by_counts(a, first, own, d)
                n_b[k, of] += a.codes.weight[run].sum() * near
                n_a[k, run] += own.codes.weight[near].sum()
            share = {k: setting.share(d) for k, setting in mixed if setting.weight < 1}
            ends = parts[np.searchsorted(parts, lo) : np.searchsorted(parts, hi, "right")].tolist() if mixed else []
            for x, y in zip(ends, ends[1:]):
                one, least = int(order[x]), {}
                sizes = own.bits + a.bits[one]
                for k, setting in mixed:
                    key = (k, int(size[x]))
                    if setting.weight < 1:
                        least[k] = setting.least(a, one, own, share[k], sizes)
                    elif key not in tables:
                        tables[key] = setting.least(a, one, own, None, None)
                    least[k] = least[k] if k in least else tables[key]
                for z in range(x, y, step):
                    rows = order[z : min(z + step, y)]
                    shared = shared_bits(a, rows, own, mixed[0][1].kind)
                    more = np.flatnonzero(a.codes.weight[rows] != 1)
                    if held + len(rows) > 255:
                        n_b[:, of] += bytes_
                        bytes_[:], held = 0, 0
                    held += len(rows)
                    for k, _ in mixed:
                        near = shared >= least[k]
                        for r, at in enumerate(rows.tolist()):
                            bytes_[k] += near[r].view(np.uint8)
                            n_a[k, at] += np.count_nonzero(near[r]) + (near[r, few:] @ extra if len(extra) else 0)
                        for r in more.tolist():
                            n_b[k, of] += (a.codes.weight[rows[r]] - 1) * near[r]
        n_b[:, of] += bytes_
    out = np.empty_like(n_b)
    out[:, behind] = n_b
    return n_a, out


def _neighbours(rows: DataFrame, sums: list[str], settings: list[Setting]) -> DataFrame:
    """(id, n0, n1, ...): the sizes of each row's neighbours and its own, summed, by setting."""
    names = [f"n{k}" for k in range(len(settings))]

    def each(one: pa.Table, other: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
        if not one.num_rows or not other.num_rows:
            return
        a = Rows(one, sums)
        b = a if same else Rows(other, sums)
        n_a, n_b = neighbour_weights(a, b, settings)
        for side, n in [(a, n_a)] if same else [(a, n_a), (b, n_b)]:
            yield pa.RecordBatch.from_arrays([pa.array(side.id), *map(pa.array, n)], names=["id", *names])

    found = in_blocks(rows, "id", ["code", *sums, "size"], each, ", ".join(f"{c} long" for c in ["id", *names]), BLOCK)
    return found.groupBy("id").agg(*[F.sum(n).alias(n) for n in names])


def leader_clusters(rows: DataFrame, id_: str, sums: list[str], settings: list[tuple[float, float]]) -> DataFrame:
    """(weight, cutoff, center, id, size) for rows (id, words, sums, size), every setting; size is the cluster's."""
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = signature_bits(rows)
    rows = saved(packed(rows, id_, bits, sums))
    kinds = [Setting(w, c, len(bits)) for w, c in settings]
    less = [-F.col(f"n{k}") for k in range(len(settings))]
    each = _neighbours(rows, sums, kinds).select("id", F.posexplode(F.array(*less)).alias("setting", "less"))
    placed = numbered(each.withColumn("place", F.struct("less", "id")), ["setting"], "place")
    ranks = placed.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("setting", "rank"))), lambda x: x["rank"]).alias("ranks"))
    # a rank goes to -1 as soon as the center is known
    none = F.array_repeat(F.lit(0).cast("long"), len(settings)).alias("centers")
    state = saved(rows.join(ranks, "id").select("id", "code", *sums, "size", "ranks", none).repartition(spread, "id"))
    schema = state.schema
    done = []
    while True:
        bounds = _bounds(state, len(settings))
        if not any(bounds):
            break
        state = saved(_round(state.repartition(spread, "id"), sums, kinds, bounds))
        done.append(state.filter("array_max(ranks) < 0"))
        state = state.filter("array_max(ranks) >= 0")
    every = state.sparkSession.createDataFrame([], schema)
    for d in done:
        every = every.unionByName(d)
    named = F.array(*[F.struct(F.lit(w).alias("weight"), F.lit(c).alias("cutoff"), F.get("centers", k).alias("center")) for k, (w, c) in enumerate(settings)])
    long = saved(every.select(F.explode(named).alias("x"), "id", F.col("size").alias("own")).select("x.*", "id", "own"))
    by = ["weight", "cutoff", "center"]
    return long.join(long.groupBy(*by).agg(F.sum("own").alias("size")), by).select(*by, "id", "size")


def _bounds(state: DataFrame, n: int) -> list[int]:
    """For each setting the rank below which about ``HEAD`` rows are open, 0 where none is."""
    open_ = state.select(F.posexplode("ranks").alias("setting", "rank")).filter("rank >= 0")
    counts = sorted(map(tuple, open_.groupBy("setting", F.floor(F.col("rank") / RANKS).alias("at")).count().collect()))
    bounds, held = [0] * n, [0] * n
    for setting, at, count in counts:
        if not held[setting] or held[setting] + count <= HEAD:
            held[setting] += count
            bounds[setting] = (at + 1) * RANKS
        else:
            held[setting] = HEAD + 1
    return bounds


def _round(state: DataFrame, sums: list[str], settings: list[Setting], bounds: list[int]) -> DataFrame:
    """The state after one round."""
    columns = ["id", "code", *sums, "size"]
    limit = F.element_at(F.array(*map(F.lit, bounds)), F.col("setting") + 1)
    head = state.select(F.posexplode("ranks").alias("setting", "rank"), *columns).filter((F.col("rank") >= 0) & (F.col("rank") < limit))

    def among(key: tuple[pa.Scalar, ...], held: pa.Table) -> pa.Table:
        held = held.sort_by("rank").combine_chunks()
        return held.take(pa.array(leaders(Rows(held, sums), settings[key[0].as_py()])))

    found = head.repartition(2 * len(settings), "setting").groupBy("setting").applyInArrow(among, head.schema).toArrow()
    found = found.sort_by([("setting", "ascending"), ("rank", "ascending")]).combine_chunks()
    sent = state.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = sent.value.column("setting").to_numpy()
        centers = Rows(sent.value, sums)
        own = [centers.take(np.flatnonzero(of == k)) for k in range(len(settings))]
        for batch in batches:
            rows = Rows(batch, sums)
            ranks, to = (np.array(batch.column(c).flatten().to_numpy()).reshape(batch.num_rows, len(settings)) for c in ("ranks", "centers"))
            for k, setting in enumerate(settings):
                open_ = np.flatnonzero(ranks[:, k] >= 0)
                if len(open_) and len(own[k]):
                    first = first_leader(rows.take(open_), own[k], setting)
                    to[open_[first >= 0], k] = own[k].id[first[first >= 0]]
                    ranks[open_[first >= 0], k] = -1
            names = batch.schema.names
            new = {"ranks": pa.array(list(ranks)), "centers": pa.array(list(to))}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in names], names=names)

    return state.mapInArrow(run, state.schema)
