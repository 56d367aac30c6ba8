"""Exact removal of repeated substrings with a sparse, range-partitioned suffix array.

A byte goes if a ``length``-byte string that covers it also starts earlier in
the corpus (smaller doc_id, or same document and earlier start).  Strings are
judged on the input.

Sorting every suffix of 100 TB would shuffle the corpus many times over, so only
suffixes that can matter are sorted.  Each ``length``-byte window belongs to one
*anchor*, the position of the least hash among its ``lead``-byte grams; equal
windows have equal anchors at equal offsets.  Consecutive windows with one
anchor form a *bundle* (about 140 bytes of text and 40 window starts).

1. Scan: bundles as (anchor hash, content hash, place), about one row for 38
   bytes.  Bundles equal to an earlier one in the same block of a task, byte for
   byte, are repeats already and leave as ranges: hot copies are combined before
   the shuffle.
2. Dealt by anchor and content hash, so that an anchor with many contents is spread:
   later copies of a bundle are matches with the first.  Matches are joined along
   their diagonals, the bytes of the first copy are sent to the later one in blocks
   of ``PIECE``, and every match is compared byte by byte before anything is cut.
3. First copies matter further only if their anchor also has other contents (one
   count and one join by anchor, which Spark can split).  They get their bytes, and
   their suffixes are dealt by Spark's sampled range splitters, first by the leading
   ``lead`` bytes.  Leads with more than ``crowd`` contents (a line that many documents
   hold) are dealt by the ``length - GROUP + 1`` bytes that neighbouring windows share
   instead.  Each bucket sorts its windows by multikey quicksort, eight bytes a key;
   all windows but the first of an equal run are repeats.  A run of one key that is
   longer than ``RUN_ROWS`` is folded to its distinct windows as it goes.
4. A splitter may fall inside a key: each bucket hands on the first places of its
   first and last key's windows, and these are compared across the boundaries.
5. Ranges meet the text once more, are merged and cut.

Nulls: a null text is empty; a null doc_id comes before all others.  Rows are told
apart by a row number that is written once: rows that share a doc_id (or have none)
are documents of their own, the one scanned first comes first.  Texts shorter than
``length`` lose nothing; very long texts are scanned in overlapping parts.  Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesops as B
from .common import removed, table, written

LENGTH, LEAD, CROWD, GROUP, PIECE = 100, 16, 64, 5, 256
BLOCK_BUNDLES, RUN_ROWS = 1 << 20, 20_000
SEGMENT = 8 << 20
_BUNDLE = ["h", "c", "doc", "row", "lo", "code"]  # code: offset of the anchor << 8 | windows - 1; of a finished range minus its end
_MATCH = ["h", "row", "lo", "code", "hrow", "hlo"]  # hrow: row of the first copy (code is the end), or _FIRST, or _SURE
_FIRST, _SURE = -2, -1
_NULL_DOC = -(2**63)
_IDX = np.uint64(0xFFFFFF)


def _longs(names: list[str]) -> str:
    return ", ".join(f"{n} long" for n in names)


def _sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while 2 * step <= width:
        a = np.minimum(a[:-step], a[step:])
        step *= 2
    rest = width - step
    return np.minimum(a[: len(a) - rest], a[rest:]) if rest else a


def _bundles(buf: np.ndarray, at: np.ndarray, length: int, lead: int, hasher: B.Hasher) -> tuple[np.ndarray, ...]:
    """Of the bundles of a chunk: row, first window start and last window start in the buffer, anchor, anchor hash, content hash."""
    n, width = len(buf), length - lead + 1
    if n < length:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    prefix = hasher.prefix(buf)
    i = np.arange(n - lead + 1)
    hashes = hasher.spans(prefix, i, i + lead)
    key = (hashes & ~_IDX) | i.astype(np.uint64)
    least = _sliding_min(key, width)
    stop = np.repeat(at[1:], np.diff(at))
    p = np.flatnonzero(stop[: len(least)] >= np.arange(len(least)) + length)
    if not len(p):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    anchor = (least[p] & _IDX).astype(np.int64)
    row = np.searchsorted(at, p, "right") - 1
    new = np.ones(len(p), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (p[1:] != p[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(p)) - 1
    first, last, anchor = p[head], p[tail], anchor[head]
    content = hasher.spans(prefix, first, last + length)
    content = B.mix(content ^ ((anchor - first).astype(np.uint64) << np.uint64(8)))
    return row[head], first, last, anchor, hashes[anchor], content


def _segments(buf: np.ndarray, at: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int, int]]:
    """(row offset, bytes, offsets, place of the first byte in its text, window starts owned): very long texts come in overlapping parts."""
    if len(buf) <= SEGMENT:
        yield 0, buf, at, 0, len(buf)
        return
    for k in range(len(at) - 1):
        text = buf[at[k] : at[k + 1]]
        for lo in range(0, max(1, len(text)), SEGMENT):
            part = text[lo : lo + SEGMENT + length - 1]
            yield k, part, np.array([0, len(part)]), lo, SEGMENT


def _merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and adjacent ranges of a document made one; ranges sorted on the way."""
    if not len(doc):
        return doc, lo, hi
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    new_doc = np.ones(len(doc), bool)
    new_doc[1:] = doc[1:] != doc[:-1]
    which = np.cumsum(new_doc) - 1
    span = int(hi.max()) + 2
    reach = np.maximum.accumulate(hi + which * span) - which * span
    new = new_doc.copy()
    new[1:] |= lo[1:] > reach[:-1]
    head = np.flatnonzero(new)
    return doc[head], lo[head], reach[np.append(head[1:], len(doc)) - 1]


def _batch(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64, copy=False)) for c in columns], names=names)


def _words_at(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one big-endian number."""
    raw = np.concatenate([buf, np.zeros(8, np.uint8)]).tobytes()
    return np.ndarray((len(raw) - 7,), dtype=">u8", buffer=raw, strides=(1,))


def _equal(words: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` (8 at least) bytes at a and b are the same."""
    same = np.ones(len(a), bool)
    for k in range(0, int(size.max(initial=8)), 8):
        step = np.minimum(k, size - 8)
        same &= words[a + step] == words[b + step]
    return same


def _flush(parts: list[tuple], texts: list[np.ndarray], length: int) -> Iterator[pa.RecordBatch]:
    """Of a block's (h, c, doc, row, lo, code, place in texts): first copies as they are, equal later ones as byte ranges."""
    h, c, doc, row, lo, code, at = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((lo, row, doc, code, c, h))
    h, c, doc, row, lo, code, at = (x[order] for x in (h, c, doc, row, lo, code, at))
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1]) & (code[1:] == code[:-1])
    head = np.maximum.accumulate(np.where(again, 0, np.arange(len(h))))
    later = np.flatnonzero(again)
    again[later] = _equal(_words_at(np.concatenate(texts)), at[later], at[head[later]], (code[later] & 255) + length)
    keep = ~again
    yield _batch(_BUNDLE, *(x[keep] for x in (h, c, doc, row, lo, code)))
    r, a, b = _merged(row[again], lo[again], lo[again] + (code[again] & 255) + length)
    if len(r):
        yield _batch(_BUNDLE, B.mix(r.view(np.uint64)), r, r, r, a, -b)


def _place(length: int, lead: int):
    """Scan side: (row, doc, text) -> bundles that are new in their block, and finished ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, parts, texts, n, size = B.Hasher(), [], [], 0, 0
        for batch, buf, at in B.chunks(batches, "text"):
            rows, docs = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for k, part, offs, base, own in _segments(buf, at, length):
                r, first, last, anchor, h, c = _bundles(part, offs, length, lead, hasher)
                if base or own < len(part):  # a bundle that crosses a part is cut there
                    ok = first < own
                    r, first, last, anchor, h, c = (x[ok] for x in (r, first, last, anchor, h, c))
                parts.append((h, c, docs[r + k], rows[r + k], first - offs[r] + base, ((anchor - first) << 8) | (last - first), first + size))
                texts.append(part)
                n, size = n + len(h), size + len(part)
                if n >= BLOCK_BUNDLES:
                    yield from _flush(parts, texts, length)
                    parts, texts, n, size = [], [], 0, 0
        if n:
            yield from _flush(parts, texts, length)

    return run


def _resolve(length: int):
    """Sorted (h, c, code, doc, row, lo) -> first copies, matches of later copies with them, and finished ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None
        for batch in batches:
            h, c, doc, row, lo, code = (x.to_numpy() for x in batch.columns)
            sure = code < 0
            none = np.zeros(len(h), np.int64)
            yield _batch(_MATCH, none[sure], row[sure], lo[sure], -code[sure], none[sure] + _SURE, none[sure])
            columns = [x[~sure] for x in (h, c, doc, row, lo, code)]
            if not len(columns[0]):
                continue
            old = carried is not None
            if old:  # the first copy of the run that the last batch ended in
                columns = [np.append(x, y) for x, y in zip(carried, columns)]
            h, c, doc, row, lo, code = columns
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1]) | (code[1:] != code[:-1])
            head = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            carried = [x[head[-1]] for x in columns]
            first = np.flatnonzero(new)[int(old) :]
            none = np.zeros(len(first), np.int64)
            yield _batch(_MATCH, h[first], row[first], lo[first], code[first], none + _FIRST, none)
            later = np.flatnonzero(~new)
            yield _batch(_MATCH, np.zeros(len(later), np.int64), row[later], lo[later], lo[later] + (code[later] & 255) + length, row[head[later]], lo[head[later]])

    return run


def _diagonals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches and ranges, dealt by row -> longest ones (row, lo, hi, hrow, hlo), cut where the first copy crosses a multiple of ``PIECE``."""
    for batch in batches:
        row, lo, hi, hrow, hlo = (x.to_numpy() for x in batch.columns)
        hlo = np.where(hrow == _SURE, lo, hlo)
        order = np.lexsort((hlo - lo, hrow, row))
        row, lo, hi, hrow, hlo = (x[order] for x in (row, lo, hi, hrow, hlo))
        shift = hlo - lo
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (hrow[1:] != hrow[:-1]) | (shift[1:] != shift[:-1])
        which, lo, hi = _merged(np.cumsum(new) - 1, lo, hi)
        row, hrow, shift = (x[new][which] for x in (row, hrow, shift))
        sure = hrow == _SURE
        yield _batch(["row", "lo", "hi", "hrow", "hlo"], row[sure], lo[sure], hi[sure], hrow[sure], lo[sure])
        row, lo, hi, hrow, hlo = row[~sure], lo[~sure], hi[~sure], hrow[~sure], (lo + shift)[~sure]
        first = hlo // PIECE
        n = (hlo + hi - lo - 1) // PIECE - first + 1
        k = np.repeat(np.arange(len(row)), n)
        block = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n) + first[k]
        a = np.maximum(hlo[k], block * PIECE)
        b = np.minimum(hlo[k] + hi[k] - lo[k], (block + 1) * PIECE)
        yield _batch(["row", "lo", "hi", "hrow", "hlo"], row[k], lo[k] + a - hlo[k], lo[k] + b - hlo[k], hrow[k], a)


def _contents(length: int, lead: int, crowd: int):
    """(row, doc, text, asked) -> (key, doc, row, lo, body): open bundles by lead or, of crowded leads, by what neighbouring windows share; blocks of first copies without a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, docs = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for lo_row in range(0, batch.num_rows, 256):
                part, out = batch.slice(lo_row, 256), []
                for row, doc, text, asked in zip(rows[lo_row : lo_row + 256].tolist(), docs[lo_row : lo_row + 256].tolist(), part.column(2), part.column(3)):
                    text = text.as_py() or b""
                    for lo, code, n in zip(*(x.to_pylist() for x in asked.values.flatten())):
                        if code < 0:
                            out.append((None, doc, row, lo, text[lo : lo + PIECE]))
                            continue
                        anchor, last = lo + (code >> 8), lo + (code & 255)
                        if n <= crowd:
                            out.append((text[anchor : anchor + lead], doc, row, lo, text[lo : last + length]))
                            continue
                        for g in range((anchor - last) // GROUP, (anchor - lo) // GROUP + 1):
                            a, b = max(lo, anchor - g * GROUP - GROUP + 1), min(last, anchor - g * GROUP)
                            core = anchor - g * GROUP
                            out.append((text[core : core + length - GROUP + 1], doc, row, a, text[a : b + length]))
                columns = list(zip(*out)) or [()] * 5
                types = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=["key", "doc", "row", "lo", "body"])

    return run


def multikey_quicksort(buf: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the equal-length strings at ``start``; returns the members of runs of two or more and their run numbers.

    Level d sorts by bytes 8d to 8d+8 as one key and goes on with the blocks
    that are still equal; blocks in which that key does not differ are not moved.
    """
    key_at = _words_at(buf)
    order, block = np.arange(len(start)), np.zeros(len(start), np.int64)
    for depth in [*range(0, length - 8, 8), length - 8]:
        if not len(order):
            break
        key = key_at[start[order] + depth].astype(np.uint64)
        differs = (key[1:] != key[:-1]) & (block[1:] == block[:-1])
        if differs.any():
            mixed = np.zeros(int(block[-1]) + 1, bool)
            mixed[block[1:][differs]] = True
            move = np.flatnonzero(mixed[block])
            by = np.argsort(key[move], kind="quicksort") if len(mixed) == 1 else np.lexsort((key[move], block[move]))
            order[move], key[move] = order[move][by], key[move][by]
        new = np.ones(len(order), bool)
        new[1:] = (key[1:] != key[:-1]) | (block[1:] != block[:-1])
        block = np.cumsum(new) - 1
        many = np.bincount(block)[block] > 1
        order, block = order[many], block[many]
        if len(block):
            block = np.cumsum(np.append(True, block[1:] != block[:-1])) - 1
    return order, block


def _starts(at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(bundle, start in the buffer) of every window of the bundles at ``at``."""
    windows = np.diff(at) - length + 1
    bundle = np.repeat(np.arange(len(windows)), windows)
    return bundle, np.arange(len(bundle)) - np.repeat(np.cumsum(windows) - windows, windows) + at[bundle]


class _Windows:
    """Windows of a bucket: their bytes lie in ``buf`` from ``start`` on, their place is (doc, row, lo)."""

    def __init__(self, buf, start, key, doc, row, lo) -> None:
        self.buf, self.start, self.key, self.doc, self.row, self.lo = buf, start, key, doc, row, lo

    @classmethod
    def of(cls, rows: pa.Table, keys: np.ndarray, length: int) -> _Windows:
        buf, at = B.buffers(rows.column("body").combine_chunks())
        bundle, start = _starts(at, length)
        doc, row, lo = (rows.column(x).to_numpy()[bundle] for x in ("doc", "row", "lo"))
        return cls(buf, start, keys[bundle], doc, row, lo + start - at[bundle])

    def strings(self, which: np.ndarray, length: int) -> np.ndarray:
        return self.buf[self.start[which, None] + np.arange(length)]

    def chosen(self, which: np.ndarray, length: int) -> _Windows:
        return _Windows(self.strings(which, length).reshape(-1), np.arange(len(which)) * length, *(x[which] for x in (self.key, self.doc, self.row, self.lo)))

    def with_(self, other: _Windows | None) -> _Windows:
        if other is None:
            return self
        pairs = zip((self.buf, self.start, self.key, self.doc, self.row, self.lo), (other.buf, other.start + len(self.buf), other.key, other.doc, other.row, other.lo))
        return _Windows(*(np.concatenate(x) for x in pairs))

    def later(self, length: int) -> np.ndarray:
        """Which windows also start earlier."""
        out = np.zeros(len(self.start), bool)
        order, run_no = multikey_quicksort(self.buf, self.start, length)
        if len(order):
            by = np.lexsort((self.lo[order], self.row[order], self.doc[order], run_no))
            order, run_no = order[by], run_no[by]
            out[order[1:][run_no[1:] == run_no[:-1]]] = True
        return out


def _bucket(length: int):
    """A bucket's bundles, sorted by key -> byte ranges of windows that also start earlier, and the first places of the windows of its first and last key."""
    names, types = ["window", "doc", "row", "lo", "hi"], [pa.binary(), *[pa.int64()] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, edge, folded = [], 0, None, None

        def judged(rows: pa.Table, keys: np.ndarray, whole: bool, last) -> Iterator[pa.RecordBatch]:
            nonlocal folded
            windows = _Windows.of(rows, keys, length).with_(folded)
            later = windows.later(length)
            r, a, b = _merged(windows.row[later], windows.lo[later], windows.lo[later] + length)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(r), pa.binary()), pa.array(r), pa.array(r), pa.array(a), pa.array(b)], names=names)
            if not whole:  # the run goes on
                folded = windows.chosen(np.flatnonzero(~later), length)
                return
            folded = None
            at_edge = np.flatnonzero(~later & ((windows.key == edge) | (windows.key == last)))
            for lo in range(0, len(at_edge), 50_000):
                some = at_edge[lo : lo + 50_000]
                strings = [x.tobytes() for x in windows.strings(some, length)]
                yield pa.RecordBatch.from_arrays([pa.array(strings, types[0]), *(pa.array(x[some]) for x in (windows.doc, windows.row, windows.lo)), pa.array(windows.lo[some] + length)], names=names)

        keys = np.zeros(0, object)
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n < RUN_ROWS:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            keys = rows.column("key").combine_chunks().to_numpy(zero_copy_only=False)
            edge = keys[0] if edge is None else edge
            other = np.flatnonzero(keys != keys[-1])
            if len(other):
                cut = int(other[-1]) + 1
                yield from judged(rows.slice(0, cut), keys[:cut], True, None)
                held, n = rows.slice(cut).to_batches(), rows.num_rows - cut
                if n < RUN_ROWS:
                    continue
                rows, keys = rows.slice(cut), keys[cut:]
            yield from judged(rows, keys, False, None)
            held, n = [batch.slice(0, 0)], 0
        if held:
            rows = pa.Table.from_batches(held).combine_chunks()
            last = rows.column("key").combine_chunks().to_numpy(zero_copy_only=False)
            edge = edge if edge is not None else last[0]
            yield from judged(rows, last, True, last[-1] if len(last) else keys[-1])

    return run


def repeated_ranges(docs: DataFrame, length: int = LENGTH, lead: int = LEAD, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """(texts, ranges): texts as (row, doc, doc_id, text binary); ranges as (row, lo, hi, same), possibly overlapping; ``same``: the bytes that the range must hold."""
    if not 8 <= lead <= length <= 200:
        raise ValueError("8 <= lead <= length <= 200")
    doc_id = F.col("doc_id").cast("long")
    texts = written(docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(doc_id, F.lit(_NULL_DOC)).alias("doc"), doc_id.alias("doc_id"), F.col("text").cast("binary").alias("text")))
    placed = texts.select("row", "doc", "text").filter(F.octet_length("text") >= length).mapInArrow(_place(length, lead), _longs(_BUNDLE))
    resolved = written(placed.repartition("h", "c").sortWithinPartitions("h", "c", "code", "doc", "row", "lo").mapInArrow(_resolve(length), _longs(_MATCH)))

    matches = resolved.filter(F.col("hrow") != _FIRST).select("row", "lo", F.col("code").alias("hi"), "hrow", "hlo")
    matches = written(matches.repartition("row").sortWithinPartitions("row", "hrow", "lo").mapInArrow(_diagonals, "row long, lo long, hi long, hrow long, hlo long"))
    claims, block = matches.filter("hrow >= 0"), F.col("hlo") - F.col("hlo") % PIECE

    # written, so that both sides of the join are plain shuffles, which Spark can split at an anchor with many contents
    first = resolved.filter(F.col("hrow") == _FIRST).select("h", "row", "lo", "code")
    rivals = written(first.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"))
    asked = first.join(rivals, "h").select("row", "lo", "code", "n")
    none = F.lit(-1).cast("long")
    asked = asked.unionByName(claims.select(F.col("hrow").alias("row"), block.alias("lo")).distinct().select("row", "lo", none.alias("code"), none.alias("n")))
    asked = asked.groupBy("row").agg(F.collect_list(F.struct("lo", "code", "n")).alias("asked"))
    contents = texts.join(asked, "row").select("row", "doc", "text", "asked").mapInArrow(_contents(length, lead, crowd), "key binary, doc long, row long, lo long, body binary")
    bodies = written(contents)

    removed(resolved, rivals)

    splitter = F.substring("body", 1, 16)  # spreads a key over several buckets
    buckets = bodies.filter("key is not null").repartitionByRange("key", splitter).sortWithinPartitions("key", splitter)
    found = written(buckets.mapInArrow(_bucket(length), "window binary, doc long, row long, lo long, hi long"))
    edges = found.filter("window is not null").groupBy("window").agg(F.array_sort(F.collect_list(F.struct("doc", "row", "lo"))).alias("places")).filter(F.size("places") > 1)
    across = edges.select(F.explode(F.slice("places", F.lit(2), F.size("places") - 1)).alias("p")).select("p.row", "p.lo", (F.col("p.lo") + length).alias("hi"))

    pieces = bodies.filter("key is null").select(F.col("row").alias("hrow"), F.col("lo").alias("block"), "body")
    same = F.substring("body", (F.col("hlo") - F.col("block") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int"))
    claimed = claims.withColumn("block", block).join(pieces, ["hrow", "block"]).select("row", "lo", "hi", same.alias("same"))
    sure = matches.filter("hrow < 0").select("row", "lo", "hi").unionByName(found.filter("window is null").select("row", "lo", "hi")).unionByName(across)
    return texts, sure.withColumn("same", F.lit(None).cast("binary")).unionByName(claimed)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for text, ranges in zip(batch.column("text"), batch.column("ranges")):
            text = text.as_py() or b""
            spans: list[list[int]] = []
            if ranges.is_valid:
                lo, hi, same = ranges.values.flatten()
                lo, hi = lo.to_numpy(), hi.to_numpy()
                for a, b, x in zip(lo.tolist(), hi.tolist(), same):
                    if x.is_valid and x.as_py() != text[a:b]:
                        raise RuntimeError("two strings with equal anchor and content hashes differ; change the hash's base")
                _, lo, hi = _merged(np.zeros(len(lo), np.int64), lo, hi)
                spans = [[a, b] for a, b in zip(lo.tolist(), hi.tolist())]
            pieces, last = [], 0
            for a, b in spans:
                pieces.append(text[last:a])
                last = b
            pieces.append(text[last:])
            out.append((len(text), b"".join(pieces), spans))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([n for n, _, _ in out], pa.int64()),
                pa.array([s for _, _, s in out], pa.list_(pa.list_(pa.int64()))),
                pa.array([hashlib.sha256(k).hexdigest() for _, k, _ in out], pa.string()),
                pa.array([k for _, k, _ in out], pa.binary()),
            ],
            names=["doc_id", "n_bytes", "spans", "kept_sha256", "kept"],
        )


def dedup_substrings(docs: DataFrame, length: int = LENGTH, lead: int = LEAD, keep_text: bool = True, crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_bytes, spans, kept_sha256[, kept]): per row its removed byte ranges and what is left, as bytes."""
    texts, ranges = repeated_ranges(docs, length, lead, crowd)
    gathered = ranges.groupBy("row").agg(F.collect_list(F.struct("lo", "hi", "same")).alias("ranges"))
    out = texts.join(gathered, "row", "left").select("doc_id", "text", "ranges").mapInArrow(_cut, "doc_id long, n_bytes long, spans array<array<long>>, kept_sha256 string, kept binary")
    return out.select("doc_id", "n_bytes", "spans", "kept_sha256", *(["kept"] if keep_text else []))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"), keep_text=False)
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s[1] - s[0])
    return out.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
