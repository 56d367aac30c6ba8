"""Near-duplicate groups: SimHash fingerprints linked through BK-trees.

Fingerprints are made in one scan and only (doc_id, fingerprint) is ever
shuffled.  Equal fingerprints are one node (with ``similarity`` equal sets of shingles).  The 64 bits are cut into blocks; two
fingerprints at most ``radius`` bits apart agree on at least
``blocks - radius`` whole blocks, so every choice of that many blocks is a key
under which each linked pair meets at least once.  The fewest blocks are taken, and
so the largest trees, whose shards hold ``TREE`` nodes or less on average.  A shard
is one key's nodes: it grows into a BK-tree (children keyed by integer Hamming
distance to the parent) and each node is looked up on the way in, following only
edges within the radius.  A shard emits one edge for each node that joins another,
towards the shard's own root of that group, never all pairs.

No tree holds more than twice ``SHARD_NODES``: the nodes of a key with more are cut into
parts, and every two parts are a shard of their own, so all pairs still meet.  Shard
trees are dealt by key, not broadcast: all trees together grow with the corpus, so
no size bound for a broadcast can be proven.

64 bits cannot tell a similarity of 0.8 from 0.7.  With ``similarity`` a link is a
pair of texts whose sets of shingles have at least that Jaccard similarity, counted
exactly on the sets of 64-bit shingle hashes.  With ``bands=0`` the fingerprints and their
trees find who may be alike, at a wide radius, and sets are fetched and counted only
within the components that they make.  Otherwise shards are the values of ``bands``
groups of ``BAND_ROWS`` min-wise hashes instead of blocks of bits: ten bands miss 1
pair in 200 at 0.8, and unlike texts seldom meet.  Within a shard every pair whose
min-wise sketches (``SKETCH`` bytes, standard error 0.025 at 0.8) agree to within
``SLACK`` of the limit is counted, the most alike first, unless the two are linked already.
The first ``FIRST_BANDS`` bands come first; of the others only those that hold texts of
several components are looked at.  A band of more than ``SHARD_TEXTS`` texts (or ``SHARD_BYTES`` of their sets) is cut into
parts, each linked by itself; then one text a component and part stands for it in the
next round, until a band fits or no round joins more.  Texts of one component need no
more comparison, so a band of near copies, however large, is done: each text was dealt
once.  Where texts of several components are left in such a band, those outside its
largest component are compared with all parts of it and with each other, in shards of
two parts of ``CROSS_TEXTS`` texts with their sets: no pair of texts is ever a row.

Nulls: a null or empty text has fingerprint zero and links like any other; rows
with a null doc_id get fingerprints, take part in linking and are never a
component's representative unless no member has an id (then component_id is
null).  Repeated rows each get their row.  Very long texts are hashed whole, one at a
time.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesops as B
from .common import components, few, removed, table, written
from .common import united as _join

SHINGLE, RADIUS, SEED, SKETCH, BAND_ROWS, SLACK = 4, 4, 42, 256, 4, 0.1
TREE, SHARD_NODES, SHARD_TEXTS, SHARD_BYTES, CROSS_TEXTS, FIRST_BANDS, FEW_BYTES, STEP = 2_000, 20_000, 500, 64 << 20, 2_000, 2, 8 << 20, 256


_rng = np.random.Generator(np.random.PCG64(7))
_TURNS = _rng.integers(1, 2**63, SKETCH, dtype=np.int64).astype(np.uint64) | np.uint64(1)


def _hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of each word shingle; of the whole sequence if it is shorter."""
    words = text.split()  # bytes.split() cuts at exactly the six ASCII white-space bytes
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, stops[:-1] + 1)[: len(words) - shingle + 1].tolist()
    digest, seed = xxhash.xxh64_intdigest, SEED
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops[shingle - 1 :].tolist())], np.uint64)


def _fingerprint(hashes: np.ndarray) -> int:
    """Bit b is set if it is set in over half of the hashes; zero without any."""
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 65_536):  # very long texts in parts
        counts += np.unpackbits(hashes[lo : lo + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def _least(hashes: np.ndarray, size: int) -> np.ndarray:
    """The least value under each of ``size`` multiplications: two texts agree in as many as their shingle sets overlap."""
    least = np.full(size, 2**64 - 1, np.uint64)
    for lo in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[lo : lo + 2048] * _TURNS[:size, None]).min(1), out=least)
    return least


def _bands(least: np.ndarray, bands: int) -> np.ndarray:
    """(row, band) -> one 64-bit hash of the band's ``BAND_ROWS`` least values and its number."""
    out = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(least), bands))
    for j in range(BAND_ROWS):
        out = B.mix(out * np.uint64(31) + least[:, j : bands * BAND_ROWS : BAND_ROWS])
    return out.view(np.int64)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, sketch: int = 0, bands: int = 0, sets: bool = False) -> DataFrame:
    """(doc_id, fp long[, sketch binary, bands array<long>][, set_id binary]): A-Z lower-cased, words between ASCII white space, XXH64 of word shingles with repeats.

    ``set_id`` is the XXH128 of the distinct shingle hashes in order.
    """
    if bands * BAND_ROWS > sketch or sketch > SKETCH:
        raise ValueError("bands * BAND_ROWS <= sketch <= SKETCH")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, ids, least = [], [], np.zeros((batch.num_rows, sketch), np.uint64)
            for i, t in enumerate(batch.column(1)):
                hashes = _hashes(t.as_py().lower() if t.is_valid else b"", shingle)
                fps.append(_fingerprint(hashes))
                if sketch or sets:
                    distinct = np.unique(hashes)
                    ids.append(xxhash.xxh128_digest(distinct.tobytes()))
                if sketch:
                    least[i] = _least(distinct, sketch)
            columns, names = [batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"]
            if sketch:
                columns.append(pa.array([row.tobytes() for row in (B.mix(least) & np.uint64(255)).astype(np.uint8)], pa.binary()))
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * bands), pa.array(_bands(least, bands).reshape(-1))))
                names += ["sketch", "bands"]
            if sketch or sets:
                columns.append(pa.array(ids, pa.binary()))
                names.append("set_id")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, fp long" + (", sketch binary, bands array<long>" if sketch else "") + (", set_id binary" if sketch or sets else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def _few(rows: DataFrame, width: int) -> DataFrame:
    return few(rows, width, FEW_BYTES)


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, members, ...) for ``wanted`` (node, set_id, id, ...): the distinct shingle hashes in order, from the documents of these ids.

    Where documents share an id, a node may come several times.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, _ in B.chunks(batches, "text"):
            sets = [np.unique(_hashes(t.as_py().lower() if t.is_valid else b"", shingle)).tobytes() for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([xxhash.xxh128_digest(x) for x in sets], pa.binary()), pa.array(sets, pa.binary())], names=["id", "set_id", "members"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
    some = texts.join(_few(wanted.select("id"), 16), "id", "left_semi").union(texts.filter("id is null"))
    found = some.mapInArrow(run, "id long, set_id binary, members binary")
    named = wanted.withColumnsRenamed({"set_id": "of", "id": "at"})
    return found.join(_few(named, 96), F.expr("set_id = of and id <=> at")).select("node", "members", *[c for c in wanted.columns if c not in ("node", "set_id", "id")])


def _ranges(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the range, member) for ranges start .. start + count."""
    which = np.repeat(np.arange(len(start)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + start[which]


class BKForest:
    """One BK-tree a shard, grown and searched level by level for all shards of a batch at once.

    ``shard`` is sorted; the first value of a shard is its root.  A child hangs
    below its parent at their integer Hamming distance; values of a shard are distinct.
    """

    def __init__(self, shard: np.ndarray, values: np.ndarray) -> None:
        n = len(values)
        new = np.append(True, shard[1:] != shard[:-1])[:n]
        self.values, self.top = values, np.maximum.accumulate(np.where(new, np.arange(n), 0))
        parent, edge, at = np.full(n, -1), np.zeros(n, np.int64), self.top.copy()
        moving = np.flatnonzero(~new)
        while len(moving):
            d = np.bitwise_count(values[moving] ^ values[at[moving]]).astype(np.int64)
            key = at[moving] * 65 + d
            by = np.argsort(key, kind="stable")
            moving, key, d = moving[by], key[by], d[by]
            lead = np.append(True, key[1:] != key[:-1])
            child = moving[np.maximum.accumulate(np.where(lead, np.arange(len(moving)), 0))]
            parent[moving[lead]], edge[moving[lead]] = at[moving[lead]], d[lead]
            at[moving] = child
            moving = np.sort(moving[~lead])
        by = np.lexsort((edge, parent))
        self.child, self.edge = by, edge[by]
        self.first = np.searchsorted(parent[by], np.arange(n))
        self.count = np.bincount(parent[parent >= 0], minlength=n)

    def linked(self, radius: int, step: int = 4_000_000) -> np.ndarray:
        """The least index linked to each value; a link is a distance within the radius."""
        n = len(self.values)
        root = np.arange(n)
        load = np.cumsum(np.bincount(self.top, minlength=n)[self.top])
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(load, (load[lo - 1] if lo else 0) + step, "right")))
            who = np.arange(lo, hi)
            at = self.top[who]
            while len(who):
                d = np.bitwise_count(self.values[who] ^ self.values[at]).astype(np.int64)
                near = (d <= radius) & (at < who) & (root[at] != root[who])
                if near.any():
                    _join(root, at[near], who[near])
                which, slot = _ranges(self.first[at], self.count[at])
                keep = np.abs(self.edge[slot] - d[which]) <= radius
                who, at = who[which[keep]], self.child[slot[keep]]
            lo = hi
        return root


def _block_masks(blocks: int) -> list[int]:
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]


def _similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sets, as sorted arrays, have that Jaccard similarity."""
    few, many = sorted((len(x), len(y)))
    if few < similarity * many:
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if few else 0
    return both == many or both >= similarity * (len(x) + len(y) - both)


class _Sets:
    """Sets of a shard, given as sorted arrays; one is compared with ``STEP`` others at a time."""

    def __init__(self, sets: list[np.ndarray], similarity: float) -> None:
        self.size, self.similarity = np.fromiter(map(len, sets), np.int64, len(sets)), similarity
        self.start = np.cumsum(self.size) - self.size
        values, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
        self.at, self.marked = at.astype(np.int32), np.zeros(len(values), bool)

    def similar(self, i: int, others: np.ndarray) -> np.ndarray:
        """Of the others, in their order, those that ``_similar`` accepts with i."""
        n = self.size[others]
        others = others[np.minimum(n, self.size[i]) >= self.similarity * np.maximum(n, self.size[i])]
        own = self.at[self.start[i] : self.start[i] + self.size[i]]
        self.marked[own] = True
        which, slot = _ranges(self.start[others], self.size[others])
        both = np.bincount(which[self.marked[self.at[slot]]], minlength=len(others))
        self.marked[own] = False
        n = self.size[others]
        return others[(both == np.maximum(n, len(own))) | (both >= self.similarity * (n + len(own) - both))]

    def joined(self, root: np.ndarray, i: int, others: np.ndarray) -> Iterator[tuple[int, int]]:
        """Joins i with each similar one of the others that is not joined to it already; gives the pairs."""
        lo, step = 0, 1  # the first are the most alike: often one joins all
        while lo < len(others):
            some = others[lo : lo + step]
            for j in self.similar(i, some[root[some] != root[i]]).tolist():
                if root[i] != root[j]:
                    _join(root, np.array([j]), np.array([i]))
                    yield i, j
            lo, step = lo + step, min(2 * step, STEP)
            if not (root[others[lo:]] != root[i]).any():
                return


def _sketches(rows: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column(2).to_pylist()), np.uint8).reshape(rows.num_rows, -1)


def _once(rows: pa.Table) -> pa.Table:
    """Sorted (key, node, ...) without rows that repeat the one before."""
    key, node = (rows.column(i).to_numpy() for i in (0, 1))
    new = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))[: len(key)]
    return rows if new.all() else rows.filter(pa.array(new))


def _pairs(pairs: list[np.ndarray]) -> pa.RecordBatch:
    found = np.concatenate([np.zeros((0, 2), np.int64), *pairs])
    return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["u", "v"])


def _alike(similarity: float):
    """Sorted (key, node, sketch, members) -> edges (u, v) of the similarity or more, by the sets of members; each run of equal keys is one shard."""

    def linked(sketch: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        root, known = np.arange(len(sets)), _Sets(sets, similarity)
        for i in range(1, len(sets)):
            agree = np.count_nonzero(sketch[:i] == sketch[i], axis=1) / sketch.shape[1]
            near = np.flatnonzero(agree >= similarity - SLACK)
            yield from known.joined(root, i, near[np.argsort(-agree[near], kind="stable")])

    def links(rows: pa.Table) -> pa.RecordBatch:
        rows = _once(rows)
        key, node = (rows.column(i).to_numpy() for i in (0, 1))
        sketch = _sketches(rows)
        cuts = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
        out = []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            sets = [np.frombuffer(m, np.uint64) for m in rows.column(3).slice(lo, hi - lo).to_pylist()]
            out += [node[[[lo + i, lo + j]]] for i, j in linked(sketch[lo:hi], sets)]
        return _pairs(out)

    return _by_shard(links, 32 << 20)


def _alike_across(similarity: float):
    """Sorted (key, node, sketch, members, component, side) -> edges (u, v) that join components of one shard; of side 0 only with side 1, of side 2 with all."""

    def links(rows: pa.Table) -> pa.RecordBatch:
        rows = _once(rows)
        key, node, component, side = (rows.column(i).to_numpy() for i in (0, 1, 4, 5))
        sketch = _sketches(rows)
        cuts = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
        out = []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            own, at, bits = side[lo:hi], node[lo:hi], sketch[lo:hi]
            sets = [np.frombuffer(m, np.uint64) for m in rows.column(3).slice(lo, hi - lo).to_pylist()]
            _, first, group = np.unique(component[lo:hi], return_index=True, return_inverse=True)
            known = _Sets(sets, similarity)
            root = first[group]  # the first text of the component, the least: ``first`` is of first occurrences
            for i in np.flatnonzero(own > 0).tolist():
                others = np.flatnonzero((root != root[i]) & ((own == 0) | (np.arange(hi - lo) < i) & (own == 2)))
                agree = np.count_nonzero(bits[others] == bits[i], axis=1) / bits.shape[1]
                near = agree >= similarity - SLACK
                out += [at[[[i, j]]] for i, j in known.joined(root, i, others[near][np.argsort(-agree[near], kind="stable")])]
        return _pairs(out)

    return _by_shard(links, 32 << 20)


def _near_others(similarity: float):
    """Sorted (key, node, sketch, component) -> (key, node) of texts that have one of another component in their shard whose sketch agrees."""

    def kept(rows: pa.Table) -> pa.RecordBatch:
        key, node, component = (rows.column(i).to_numpy() for i in (0, 1, 3))
        sketch = _sketches(rows)
        cuts = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
        near = np.zeros(len(key), bool)
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            for i in range(lo + 1, hi):
                agree = np.count_nonzero(sketch[lo:i] == sketch[i], axis=1) / sketch.shape[1]
                others = (agree >= similarity - SLACK) & (component[lo:i] != component[i])
                near[lo:i] |= others
                near[i] |= others.any()
        return pa.RecordBatch.from_arrays([pa.array(key[near]), pa.array(node[near])], names=["key", "node"])

    return _by_shard(kept, 8 << 20)


def _shards(radius: int):
    """Sorted (key, fp, node) -> edges (u, v): each run of equal keys is one shard."""

    def links(rows: pa.Table) -> pa.RecordBatch:
        key, fp, node = (rows.column(i).to_numpy() for i in range(3))
        root = BKForest(key, fp.view(np.uint64)).linked(radius)
        joined = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(node[joined]), pa.array(node[root[joined]])], names=["u", "v"])

    return _by_shard(links, 1 << 20)


def _by_shard(links, least: int):
    """Calls ``links`` on whole shards of the rows, which are sorted by key, some ``least`` bytes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.nbytes
            if n < least:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            key = rows.column(0).to_numpy()
            other = np.flatnonzero(key != key[-1])
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield links(rows.slice(0, cut))
            held, n = rows.slice(cut).to_batches(), 0 if cut else n // 2
        if held:
            yield links(pa.Table.from_batches(held).combine_chunks())

    return run


def _keys(radius: int, blocks: int, agree: int | None):
    agree = blocks - radius if agree is None else agree
    if not 0 <= radius <= 64 or not 1 <= agree <= blocks <= 64:
        raise ValueError("0 <= radius <= 64 and 1 <= agree <= blocks <= 64")
    keys = []
    for k, chosen in enumerate(combinations(_block_masks(blocks), agree)):
        mask = sum(chosen)
        keys.append(F.xxhash64(F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)), F.lit(k)))
    return F.array(*keys)


def blocks_for(nodes: int, radius: int) -> int:
    """The fewest blocks with ``TREE`` nodes or less a shard, if fingerprints are spread evenly."""
    blocks = radius + 1
    while blocks < 64 and nodes > TREE * 2 ** (64 * (blocks - radius) // blocks):
        blocks += 1
    return blocks


def _split(dealt: DataFrame, most: int) -> DataFrame:
    """``dealt`` (key, node, ...); keys of more than ``most`` rows are cut into parts, and every two parts share a new key.

    Only the large keys, at most one in ``most`` rows, are joined, so rows stay where they are until they are dealt.
    """
    large = written(dealt.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > most))
    parts = F.ceil(F.col("n") / most).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(5)), parts).cast("int")
    others = F.filter(F.sequence(F.lit(0), parts - 1), lambda q: q != F.col("own"))
    keys = F.when(F.col("n").isNull(), F.array("key")).otherwise(F.transform(others, lambda q: F.xxhash64("key", F.least("own", q), F.greatest("own", q))))
    return dealt.join(_few(large, 32), "key", "left").withColumn("own", own).withColumn("key", F.explode(keys)).drop("n", "own")


def link_edges(nodes: DataFrame, radius: int = RADIUS, blocks: int | None = None, agree: int | None = None, most: int = SHARD_NODES) -> DataFrame:
    """(u, v) edges, some of them repeated, between ``nodes`` (node long, fp long; fp distinct) whose closure links every pair within the radius.

    ``agree`` whole blocks make a key.  Left out, it is blocks - radius, and no pair
    within the radius can be missed; set higher for wide radii, a pair is met if it
    agrees on that many blocks.
    """
    blocks = blocks or blocks_for(nodes.count(), radius)
    dealt = _split(nodes.select(F.explode(_keys(radius, blocks, agree)).alias("key"), "fp", "node"), most)
    return dealt.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_shards(radius), "u long, v long")


def _linked_bands(dealt: DataFrame, members: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(edges, bands, named): the links found within bands or stars of the same components, the (key) of those that had to be cut, and the components if they are known.

    ``dealt`` (key, node, sketch, bytes[, members]) has the texts of bands that others share.
    """
    edges, alive, before, first = None, dealt, None, None
    while True:
        sizes = alive.groupBy("key").agg(F.count("*").alias("n"), F.sum("bytes").alias("all"))
        parts = F.ceil(F.greatest(F.col("n") / SHARD_TEXTS, F.col("all") / SHARD_BYTES)).cast("int")
        hot = written(sizes.select("key", parts.alias("parts")).filter("parts > 1"))
        cut = alive.join(_few(hot, 32), "key", "left").withColumn("key", F.when(F.col("parts").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.pmod(F.xxhash64("node", F.lit(5)), F.col("parts")))))
        rows = cut if "members" in alive.columns else _few(cut.select("key", "node", "sketch"), 48 + SKETCH).join(members, "node")
        rows = rows.select("key", "node", "sketch", "members")
        found = written(rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_alike(similarity), "u long, v long"))
        edges = found if edges is None else edges.unionByName(found)
        hot = hot.select("key")
        first = hot if first is None else first
        if hot.isEmpty():
            return edges, first, None
        named = components(edges)
        edges = named.select(F.col("component").alias("u"), F.col("node").alias("v"))
        standing = alive.select("key", "node", "sketch", "bytes").join(_few(hot, 24), "key", "left_semi").join(_few(named, 16), "node", "left").withColumn("component", F.coalesce("component", "node"))
        alive = written(standing.groupBy("key", "component").agg(F.min_by(F.struct("node", "sketch", "bytes"), "node").alias("x")).select("key", "x.*"))
        n = alive.count()
        if before is not None and n > 0.9 * before:
            return edges, first, named
        before = n


def similar_edges(nodes: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(u, v) edges between ``nodes`` (node, least, sketch, bands, set_id), each of the similarity or more by the sets of shingles of their texts in ``docs``.

    Their closure links every such pair that shares a band.
    """
    each = nodes.select(F.posexplode("bands").alias("band", "key"), "node", "sketch")
    shared = written(each.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    each = written(each.join(shared.select("key"), "key", "left_semi"))
    wanted = nodes.join(each.select("node").distinct(), "node", "left_semi").select("node", "set_id", F.col("least").alias("id"))
    members = written(_sets(docs, written(wanted), shingle).dropDuplicates(["node"]))
    dealt = written(each.join(members.select("node", F.octet_length("members").cast("long").alias("bytes")), "node"))
    edges, large, _ = _linked_bands(dealt.filter(F.col("band") < FIRST_BANDS).drop("band"), members, similarity)
    # the first bands link most copies; of the others only those with texts of several components are left to look at
    rest = dealt.filter(F.col("band") >= FIRST_BANDS).join(components(edges), "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = rest.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).filter("low <> high").select("key", "n")
    still = written(rest.join(open_, "key").select("key", "node", "sketch", "bytes", "component", "n"))
    # sets are fetched only for texts whose sketch agrees with one of another component; bands over the bound go to the rounds whole
    small = still.filter(F.col("n") <= SHARD_TEXTS).select("key", "node", "sketch", "component")
    near_others = small.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_near_others(similarity), "key long, node long")
    columns = ["key", "node", "sketch", "bytes"]
    more = written(still.join(near_others, ["key", "node"], "left_semi").select(columns).unionByName(still.filter(F.col("n") > SHARD_TEXTS).select(columns)))
    removed(still)
    if not more.isEmpty():
        later, cut, _ = _linked_bands(more, members, similarity)
        edges, large = written(edges.unionByName(later).distinct()), large.unionByName(cut)
    if large.isEmpty():
        removed(shared, each, dealt, members, more)
        return edges
    edges = _across(dealt, large, edges, members, similarity)
    removed(shared, each, dealt, members, more)
    return edges


def fingerprint_edges(nodes: DataFrame, docs: DataFrame, shingle: int, similarity: float, radius: int, blocks: int | None, agree: int | None) -> DataFrame:
    """(u, v) edges between ``nodes`` (node, least, fp, set_id), each of the similarity or more by the sets of shingles of their texts in ``docs``.

    BK-trees link fingerprints within the radius; their closure links every similar pair of one
    component.  The bits of a fingerprint serve as the sketch by which pairs are chosen.
    """
    fps = written(nodes.groupBy("fp").agg(F.min("node").alias("node")))
    near = components(link_edges(fps, radius, blocks, agree))
    of = written(fps.join(_few(near, 16), "node", "left").select("fp", F.coalesce("component", "node").alias("key")))
    named = written(nodes.join(_few(of, 16), "fp").select("key", "node", F.col("least").alias("id"), "set_id", "fp"))
    shared = written(named.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"))
    each = written(named.join(_few(shared, 8), "key", "left_semi"))
    removed(of, named, shared)
    # sets are written where they are made, with their keys: they move once, to the shard that counts them
    dealt = written(_sets(docs, each, shingle).select("key", "node", "fp", "members").mapInArrow(_bit_sketches, "key long, node long, sketch binary, bytes long, members binary"))
    members = dealt.select("node", "members")
    edges, large, named = _linked_bands(dealt, members, similarity)
    if not large.isEmpty():
        edges = _across(dealt, large, edges, members, similarity, named)
    removed(fps, each, dealt)
    return edges


def _bit_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node, fp, members) with a byte for each bit of the fingerprint in its place, and the bytes of the members."""
    for batch in batches:
        bits = np.unpackbits(batch.column(2).to_numpy().view(np.uint8).reshape(-1, 8), axis=1)
        columns = [batch.column(0), batch.column(1), pa.array([row.tobytes() for row in bits], pa.binary()), pc.binary_length(batch.column(3)).cast(pa.int64()), batch.column(3)]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "node", "sketch", "bytes", "members"])


def _across(dealt: DataFrame, large: DataFrame, edges: DataFrame, members: DataFrame, similarity: float, named: DataFrame | None = None) -> DataFrame:
    """``edges`` and those that are missing in the bands ``large`` (key) that were cut: texts of different components may still be alike.

    The largest component and the rest are cut into parts; a part of the rest meets each part of both.
    """
    named = components(edges) if named is None else named
    rows = dealt.select("key", "node", "sketch", "bytes").join(_few(large, 24), "key", "left_semi").join(_few(named, 16), "node", "left")
    left = written(rows.select("key", "node", "sketch", "bytes", F.coalesce("component", "node").alias("component")))
    groups = left.groupBy("key", "component").agg(F.count("*").alias("m"), F.sum("bytes").alias("b"))
    tops = groups.groupBy("key").agg(F.max_by(F.struct("component", "m", "b"), F.struct("m", "component")).alias("top"), F.sum("m").alias("n"), F.sum("b").alias("all")).filter("n > top.m")
    parts = lambda n, size: F.ceil(F.greatest(n / CROSS_TEXTS, 2 * size / SHARD_BYTES)).cast("int")
    tops = written(tops.select("key", F.col("top.component").alias("top"), parts(F.col("top.m"), F.col("top.b")).alias("main_parts"), parts(F.col("n") - F.col("top.m"), F.col("all") - F.col("top.b")).alias("rest_parts")))
    main = F.col("component") == F.col("top")
    sided = left.join(_few(tops, 40), "key").withColumn("own", F.pmod(F.xxhash64("node", F.lit(6)), F.when(main, F.col("main_parts")).otherwise(F.col("rest_parts"))).cast("int"))
    shard = lambda kind, a, b, side: F.struct(F.xxhash64("key", F.lit(kind), a, b).alias("key"), side.alias("side"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    of_main = F.transform(upto("rest_parts"), lambda q: shard(0, F.col("own"), q, F.lit(0)))
    to_main = F.transform(upto("main_parts"), lambda q: shard(0, q, F.col("own"), F.lit(1)))
    to_rest = F.transform(upto("rest_parts"), lambda q: shard(1, F.least("own", q), F.greatest("own", q), F.when(F.col("own") == q, 2).when(F.col("own") < q, 0).otherwise(1)))
    own = _few(sided.withColumn("at", F.when(main, of_main).otherwise(F.concat(to_main, to_rest))).select("node", "sketch", "component", "at"), 64 + SKETCH).join(members, "node")
    rows = own.select(F.explode("at").alias("at"), "node", "sketch", "members", "component").select("at.key", "node", "sketch", "members", "component", "at.side")
    found = rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_alike_across(similarity), "u long, v long")
    edges = edges.unionByName(written(found))
    removed(left, tops)
    return edges


def near_duplicate_groups(
    docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, blocks: int | None = None, agree: int | None = None, similarity: float | None = None, bands: int = 10
) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links.

    Links are fingerprints within ``radius`` bits or, with ``similarity``, texts that are at least
    that similar and share one of ``bands`` or, with ``bands=0``, a component of fingerprints.
    """
    return _groups(docs, shingle, radius, blocks, agree, similarity, bands)[0]


def _groups(
    docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, blocks: int | None = None, agree: int | None = None, similarity: float | None = None, bands: int = 10
) -> tuple[DataFrame, list[DataFrame]]:
    """The groups and the tables that they read."""
    bands = 0 if similarity is None else bands
    marked = written(fingerprints(docs, shingle, SKETCH if bands else 0, bands, similarity is not None))
    # A node is a fingerprint or, with similarity, a set of shingles: texts of one fingerprint can be unlike each other.
    # Its number is its smallest doc_id; nodes of rows without ids get negative numbers of their own.
    by, rest = ("fp", []) if similarity is None else ("set_id", ["sketch", "bands"] if bands else ["fp"])
    extra = [F.min(F.struct(*rest)).alias("x")] if rest else []
    nodes = marked.groupBy(by).agg(F.min("doc_id").alias("least"), *extra)
    nodes = nodes.select(by, "least", *(["x.*"] if rest else []))
    nodes = written(nodes.withColumn("node", F.coalesce("least", F.xxhash64(by).bitwiseOR(F.lit(-(2**63))))))
    if similarity is None:
        edges = link_edges(nodes, radius, blocks, agree)
    elif bands:
        edges = similar_edges(nodes, docs, shingle, similarity)
    else:
        edges = fingerprint_edges(nodes, docs, shingle, similarity, radius, blocks, agree)
    groups = components(edges)
    named = written(nodes.select(by, "least", "node").join(_few(groups, 16), "node", "left").select(by, "least", F.coalesce("component", "node").alias("component")))
    removed(nodes)
    # Stand-ins are negative, so a component named by a number from 0 on has its least real id for a name.
    # Only below 0 the least real id is looked for: no stand-in ever is a component_id.
    below = named.filter("component < 0")
    by_node = named.filter("component >= 0").select(by, F.col("component").alias("component_id"))
    if not below.isEmpty():
        names = below.groupBy("component").agg(F.min("least").alias("component_id"))
        by_node = by_node.union(below.join(names, "component").select(by, "component_id"))
    return marked.select(*{"doc_id": 0, "fp": 0, by: 0}).join(_few(by_node, 32), by).select("doc_id", "fp", "component_id"), [marked, named]


def representatives(docs: DataFrame, **options) -> DataFrame:
    """One document of each group, the one with the smallest doc_id; columns as in docs.

    Rows are told apart by a row number that is written once, so rows that share a
    doc_id, or have none, are documents of their own.  Of equal doc_ids the first row
    scanned stays; rows without one stay only if no member of the group has one.
    """
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc")))
    groups, tables = _groups(rows.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text")), **options)
    place = F.struct(F.col("doc.doc_id").isNull(), F.col("doc.doc_id"), "row")
    groups = written(groups.select(F.col("doc_id").alias("row"), "component_id"))
    named = written(rows.select("row", place.alias("place")).join(_few(groups, 16), "row"))
    keep = written(named.groupBy("component_id").agg(F.min_by("row", "place").alias("row")).select("row"))
    dropped = written(named.join(_few(keep, 8), "row", "left_anti").select("row"))
    removed(*tables, groups, named)
    if 8 * dropped.count() <= FEW_BYTES:  # texts stay where they are
        return rows.join(F.broadcast(dropped), "row", "left_anti").select("doc.*")
    return rows.join(keep, "row", "left_semi").select("doc.*")


def op10_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicate_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
