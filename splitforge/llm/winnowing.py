"""Benchmark decontamination by winnowing fingerprints and extension of their hits.

Of all k-word grams, each sliding window of ``window - k + 1`` grams keeps its
least hash.  Two texts that share ``window`` consecutive words share that
window's kept fingerprint, so joining the kept fingerprints of documents and
benchmark finds every shared span; each hit is then extended to the windows around
it.  A window is looked up once among the distinct windows of the benchmark, each
with the list of its items, so repeated words cost no pairs of occurrences.  Words
are compared byte by byte with the benchmark's vocabulary and windows word by word;
hashes only find candidates.  Items with fewer than ``window`` words are one window
as a whole; for them winnowing promises nothing, so every gram of their lengths is
looked up.

The benchmark goes to the tasks as a broadcast of at most ``block_bytes`` of
text.  A larger one is cut into blocks by item and the documents are scanned once
a block; the blocks' results are merged by a row number that is written first, so no
bound is put on the benchmark.

Nulls: a null text (document or item) has no words.  Items without words have no
window.  A null item_id is ignored in the list and the count, its windows still
hit.  Repeated rows each get their row; rows of a repeated item_id count as one
item with all their windows; of equal fingerprints in a window all are kept.  Very
long texts are looked at whole, one at a time.  Extra columns of ``docs`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesops as B
from .common import table, written

WINDOW, GRAM, BLOCK_BYTES = 10, 5, 16 << 20
_STEP = 0x2545F4914F6CDD1D


def _grams(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each k-word gram by its first word, and whether it stays in one document."""
    if len(h) < k:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(_STEP) + h[j : j + n]
    return B.mix(out), doc[k - 1 :] == doc[:n]


def _winnow(h: np.ndarray, doc: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the kept grams; of equal least hashes in a window all are kept."""
    grams, ok = _grams(h, doc, k)
    width = window - k + 1
    if len(grams) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(grams) - width + 1
    least = grams[:n].copy()
    for j in range(1, width):
        np.minimum(least, grams[j : j + n], out=least)
    whole = doc[window - 1 :] == doc[:n]
    kept = np.zeros(len(grams), bool)
    for j in range(width):
        kept[j : j + n] |= whole & (grams[j : j + n] == least)
    at = np.flatnonzero(kept & ok)
    return at, grams[at]


def _same_bytes(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> np.ndarray:
    """Whether the spans of a and b, each (bytes, start, end), hold the same bytes."""
    (x, xs, xe), (y, ys, ye) = a, b
    x, y = (np.frombuffer(np.append(z, np.zeros(8, np.uint8)).tobytes(), np.uint8) for z in (x, y))
    x, y = (np.ndarray((len(z) - 7,), "<u8", z, strides=(1,)) for z in (x, y))
    same = xe - xs == ye - ys
    todo, k = np.flatnonzero(same), 0
    while len(todo):
        left = xe[todo] - xs[todo] - k
        mask = ~np.uint64(0) >> (np.uint64(8) * (8 - np.minimum(left, 8)).astype(np.uint64))
        equal = (x[xs[todo] + k] ^ y[ys[todo] + k]) & mask == 0
        same[todo[~equal]] = False
        todo, k = todo[equal & (left > 8)], k + 8
    return same


class Windows:
    """The distinct n-word windows of a block of items, by hash, with the items of each."""

    def __init__(self, ids: np.ndarray, h: np.ndarray, item: np.ndarray, first: np.ndarray, n: int) -> None:
        """Windows start at the words ``first``; ids are exact, h are hashes of the words."""
        self.n = n
        _, at, which = np.unique(ids[first[:, None] + np.arange(n)], axis=0, return_index=True, return_inverse=True)
        hashes = self.hashes(h, first[at])
        order = np.argsort(hashes, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.hash, self.ids = hashes[order], ids[first[at[order]][:, None] + np.arange(n)]
        pairs = np.unique(np.stack([place[which.reshape(-1)], item[first]], 1), axis=0)
        self.items, self.cut = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(order) + 1))

    def hashes(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        out = np.zeros(len(first), np.uint64)
        for j in range(self.n):
            out = out * np.uint64(_STEP) + h[first + j]
        return B.mix(out)

    def found(self, ids: np.ndarray, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, number of the equal window) of the windows at ``first`` that are known."""
        hashes = self.hashes(h, first)
        lo = np.searchsorted(self.hash, hashes, "left")
        starts, windows = [], []
        while len(first):  # more than one round only where hashes of different windows agree
            near = lo < len(self.hash)
            near[near] = self.hash[lo[near]] == hashes[near]
            first, hashes, lo = first[near], hashes[near], lo[near]
            same = np.ones(len(first), bool)
            for j in range(self.n):
                same &= ids[first + j] == self.ids[lo, j]
            starts.append(first[same])
            windows.append(lo[same])
            first, hashes, lo = first[~same], hashes[~same], lo[~same] + 1
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *starts]), np.concatenate([none, *windows])


class Lookup:
    """A block of items: vocabulary, fingerprints, distinct windows."""

    def __init__(self, items: list[tuple[object, bytes]], window: int, k: int) -> None:
        self.window, self.k, hasher = window, k, B.Hasher()
        self.names = [i for i, _ in items]
        texts = [t for _, t in items]
        at = np.cumsum([0, *map(len, texts)])
        buf = B.LOWER[np.frombuffer(b"".join(texts), np.uint8)]
        start, end, item = B.words(buf, at, B.ALNUM)
        h = hasher.spans(hasher.prefix(buf), start, end)
        known: dict[bytes, int] = {}
        raw = buf.tobytes()
        ids = np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(start.tolist(), end.tolist())], np.int64)
        _, one = np.unique(ids, return_index=True)
        one = one[np.argsort(h[one], kind="stable")]
        self.buf, self.start, self.end, self.word, self.id = buf, start[one], end[one], h[one], ids[one]
        self.fps = np.unique(_winnow(h, item, window, k)[1])
        size = np.bincount(item, minlength=len(items))
        first = np.cumsum(size) - size
        whole = np.flatnonzero(item[window - 1 :] == item[: max(len(item) - window + 1, 0)])
        self.windows = Windows(ids, h, item, whole, window)
        self.short = [Windows(ids, h, item, first[size == n], int(n)) for n in np.unique(size[(size > 0) & (size < window)])]

    def word_ids(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Number of each word in the vocabulary, -1 if it is not in it."""
        out = np.full(len(h), -1, np.int64)
        todo, lo = np.arange(len(h)), np.searchsorted(self.word, h, "left")
        while len(todo):  # more than one round only where hashes of different words agree
            near = lo < len(self.word)
            near[near] = self.word[lo[near]] == h[todo[near]]
            todo, lo = todo[near], lo[near]
            same = _same_bytes((buf, start[todo], end[todo]), (self.buf, self.start[lo], self.end[lo]))
            out[todo[same]] = self.id[lo[same]]
            todo, lo = todo[~same], lo[~same] + 1
        return out

    def hits(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (document, item) of matching windows, and which words are hit."""
        window, k, n = self.window, self.k, len(h)
        hit, pairs = np.zeros(n + 1, np.int64), [np.zeros((0, 2), np.int64)]
        ids = self.word_ids(buf, start, end, h)
        at, fps = _winnow(h, doc, window, k)
        lo = np.searchsorted(self.fps, fps)
        lo[lo == len(self.fps)] = 0
        at = at[self.fps[lo] == fps] if len(self.fps) else at[:0]
        near = np.zeros(n, bool)
        for shift in range(window - k + 1):  # the windows of which the gram is a part
            near[(at - shift)[at >= shift]] = True
        for windows in (self.windows, *self.short):
            first = np.flatnonzero(near) if windows is self.windows else np.flatnonzero(ids >= 0)
            first = first[first + windows.n <= n]
            first = first[doc[first] == doc[first + windows.n - 1]]
            first, which = windows.found(ids, h, first)
            np.add.at(hit, first, 1)
            np.add.at(hit, first + windows.n, -1)
            each = np.unique(np.stack([doc[first], which], 1), axis=0)
            count = windows.cut[each[:, 1] + 1] - windows.cut[each[:, 1]]
            left = np.repeat(np.arange(len(each)), count)
            right = np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count) + windows.cut[each[left, 1]]
            pairs.append(np.stack([each[left, 0], windows.items[right]], 1))
        pairs = np.unique(np.concatenate(pairs), axis=0)
        return pairs[:, 0], pairs[:, 1], np.cumsum(hit)[:-1] > 0


def _scan(lookup):
    """(doc_id, text, ...) batches -> row results: words, hit word ranges, items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, hasher = lookup.value, B.Hasher()
        for batch, buf, at in B.chunks(batches, "text"):
            buf = B.LOWER[buf]
            start, end, doc = B.words(buf, at, B.ALNUM)
            h = hasher.spans(hasher.prefix(buf), start, end)
            docs, items, hit = look.hits(buf, start, end, doc, h)
            n = batch.num_rows
            size = np.bincount(doc, minlength=n)
            first = np.cumsum(size) - size
            found: list[set] = [set() for _ in range(n)]
            for d, i in zip(docs.tolist(), items.tolist()):
                if look.names[i] is not None:
                    found[d].add(str(look.names[i]))
            edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
            spans: list[list] = [[] for _ in range(n)]
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                while a < b:  # a run of hit words may go on in the next document
                    d = int(doc[a])
                    stop = min(b, int(first[d] + size[d]))
                    spans[d].append([a - int(first[d]), stop - int(first[d])])
                    a = stop
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "text"),
                    pa.array(size, pa.int64()),
                    pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                    pa.array([sorted(x) for x in found], pa.list_(pa.string())),
                ],
                names=[*(x for x in batch.schema.names if x != "text"), "n_words", "hit_words", "items"],
            )

    return run


def _lookups(spark: SparkSession, benchmark: DataFrame, window: int, gram: int, block_bytes: int) -> list:
    """Broadcasts of at most about ``block_bytes`` of benchmark text each."""
    if not 1 <= gram <= window:
        raise ValueError("1 <= gram <= window")
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    out = []
    for k in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        out.append(spark.sparkContext.broadcast(Lookup([(r.item_id, bytes(r.text)) for r in mine.toLocalIterator()], window, gram)))
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without any window of the benchmark; columns as in docs, no shuffle."""

    def keep(lookup):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            look, hasher = lookup.value, B.Hasher()
            for batch, buf, at in B.chunks(batches, "text"):
                buf = B.LOWER[buf]
                start, end, doc = B.words(buf, at, B.ALNUM)
                _, _, hit = look.hits(buf, start, end, doc, hasher.spans(hasher.prefix(buf), start, end))
                clean = np.ones(batch.num_rows, bool)
                clean[doc[hit]] = False
                yield batch.filter(pa.array(clean))

        return run

    for lookup in _lookups(docs.sparkSession, benchmark, window, gram, block_bytes):
        docs = docs.mapInArrow(keep(lookup), docs.schema)
    return docs


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, hit_words, items): hit word ranges [from, to) and the sorted ids of items with a window in the text."""
    lookups = _lookups(docs.sparkSession, benchmark, window, gram, block_bytes)
    blocks = len(lookups)
    parts = []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *([F.monotonically_increasing_id().alias("row")] if blocks > 1 else []))
    if blocks > 1:
        rows = written(rows)
    for lookup in lookups:
        schema = "doc_id long, " + ("row long, " if blocks > 1 else "") + "n_words long, hit_words array<array<long>>, items array<string>"
        parts.append(rows.mapInArrow(_scan(lookup), schema))
    if blocks == 1:
        return parts[0]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("hit_words")).alias("hit_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    ).drop("row")


def hit_count(ranges):
    """Words in the union of ranges [from, to)."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    grown = F.aggregate(
        F.array_sort(ranges),
        start,
        lambda acc, r: F.struct((acc.n + F.greatest(F.lit(0).cast("long"), r[1] - F.greatest(r[0], acc.to))).alias("n"), F.greatest(acc.to, r[1]).alias("to")),
    )
    return grown.n


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = hit_count(F.col("hit_words"))
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
