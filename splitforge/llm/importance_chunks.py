r"""Importance resampling towards a target distribution, with overlap chunking of long texts.

Features are all runs of 1 to ``order`` consecutive words, hashed into ``buckets``; a
bucket's gain is the log ratio of its share of the target's features to its share of
the source's, and a document's weight is the mean gain of its features.

A text of more than ``chunk_bytes`` is cut at word boundaries into chunks that are
dealt over the tasks, so one very long text is no task of its own.  A chunk owns the
words that start in its range and carries the next ``order - 1`` words, so every
feature is counted once, by the chunk that owns its first word; a single word is never
cut.  Chunks leave their features as (bucket, count) lists in a written table; bucket
totals are summed inside each task before they are shuffled (``buckets`` numbers a
task), and chunk counts and weights are summed by document.

The draw adds Gumbel noise from a hash of doc_id to the weight and takes the highest
scores.  Scores are whole numbers, of which there are few (the noise spans some 26,000,
a mean gain some 60,000 at most), so ranks are a running sum over the histogram of
scores plus the place within a score; only rows at or above the last score drawn are
sorted.

Nulls: a null text has no words (weight 0); a null doc_id is hashed as an empty one and
comes last among equal scores.  Repeated rows each get their row and their draw; among
equal scores and doc_ids the order is that of the scan.  Empty tables give no rows; an
empty target gives gains from its empty counts.  Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bytesops as B
from .common import table, written

ORDER, BUCKETS, CHUNK_BYTES, MIN_WORDS, PERCENT, SEED = 1, 10_000, 1 << 14, 20, 10, 2024
_SHORT = 64


def _crc_table() -> np.ndarray:
    """The remainders of all bytes for CRC-32 (reversed polynomial 0xEDB88320)."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, out >> 1 ^ np.uint32(0xEDB88320), out >> 1)
    return out


_CRC = _crc_table()


def crc32(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of every span of the buffer, byte by byte for all spans at once; long spans one by one."""
    size = end - start
    out = np.full(len(start), 0xFFFFFFFF, np.uint32)
    by = np.argsort(-np.minimum(size, _SHORT + 1).astype(np.int16), kind="stable")
    long_ = int((size > _SHORT).sum())
    at, left, crc = start[by[long_:]], size[by[long_:]], out[long_:]
    n = len(at) - np.searchsorted(left[::-1], np.arange(_SHORT), "right")
    for k in range(int(left[0]) if len(left) else 0):
        m = int(n[k])
        crc[:m] = _CRC[(crc[:m] ^ buf[at[:m] + k]) & 255] ^ crc[:m] >> np.uint32(8)
    found = np.empty(len(start), np.uint32)
    found[by] = ~out
    for k in by[:long_].tolist():
        found[k] = zlib.crc32(buf[start[k] : end[k]].tobytes())
    return found


def _spaced(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with one space after each, and their new places."""
    size = end - start
    first = np.cumsum(size + 1) - size - 1
    out = np.full(int((size + 1).sum()), 0x20, np.uint8)
    which = np.repeat(np.arange(len(size)), size)
    inside = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
    out[first[which] + inside] = buf[start[which] + inside]
    return out, first, first + size


def _cut(chunk_bytes: int, carry: int):
    """Pieces (row, doc_id, chunk, own, text) of each text: own words, and at most ``carry`` more words after them."""

    def piece(part: pa.RecordBatch, chunk: int, own: int, text: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([chunk], pa.int64()), pa.array([own], pa.int64()), pa.array([text])], names=["row", "doc_id", "chunk", "own", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offsets in B.chunks(batches, "text", 1):
            start, end, _ = B.words(B.LOWER[buf], offsets, B.ALNUM)
            if not len(start):
                yield piece(part, 0, 0, b"")
                continue
            firsts = np.flatnonzero(np.append(True, start[1:] // chunk_bytes != start[:-1] // chunk_bytes))
            for k, (lo, hi) in enumerate(zip(firsts.tolist(), [*firsts[1:].tolist(), len(start)])):
                yield piece(part, k, hi - lo, buf[start[lo] : end[min(hi + carry, len(end)) - 1]].tobytes())

    return run


def _counted(order: int, buckets: int):
    """(row, doc_id, n_words, n_features, bucket array, n array) of pieces; own NULL: all words are owned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offsets in B.chunks(batches, "text"):
            docs = part.num_rows
            buf = B.LOWER[buf]
            start, end, doc = B.words(buf, offsets, B.ALNUM)
            own = part.column(2).fill_null(np.iinfo(np.int64).max).to_numpy()
            before = np.searchsorted(doc, np.arange(docs))
            mine = np.arange(len(doc)) - before[doc] < own[doc]
            if order > 1:
                buf, start, end = _spaced(buf, start, end)
            keys = []
            for length in range(1, order + 1):
                first = np.flatnonzero(mine[: max(len(doc) - length + 1, 0)] & (doc[: max(len(doc) - length + 1, 0)] == doc[length - 1 :]))
                keys.append(doc[first] * buckets + crc32(buf, start[first], end[first + length - 1]) % buckets)
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            at = np.searchsorted(key, np.arange(docs + 1) * buckets).astype(np.int32)
            features = np.append(0, np.cumsum(n))[at]
            columns = [part.column(0), part.column(1), pa.array(np.bincount(doc[mine], minlength=docs)), pa.array(features[1:] - features[:-1])]
            columns += [pa.ListArray.from_arrays(pa.array(at), pa.array(x.astype(np.int32))) for x in (key % buckets, n)]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_words", "n_features", "bucket", "n"])

    return run


def features(docs: DataFrame, id_: str = "doc_id", order: int = ORDER, buckets: int = BUCKETS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(row, doc_id, n_words, n_features, bucket array<int>, n array<int>) of every chunk; row tells documents apart, odd for those in chunks."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_).cast("long").alias("doc_id"), text.alias("text"))
    long_ = F.octet_length("text") > chunk_bytes
    short = rows.filter(~long_).select((F.col("row") * 2).alias("row"), "doc_id", F.lit(None).cast("long").alias("own"), "text")
    pieces = rows.filter(long_).select((F.col("row") * 2 + 1).alias("row"), "doc_id", "text").mapInArrow(_cut(chunk_bytes, order - 1), "row long, doc_id long, chunk long, own long, text binary")
    dealt = pieces.repartition("row", "chunk").drop("chunk")
    counted = "row long, doc_id long, n_words long, n_features long, bucket array<int>, n array<int>"
    return short.select("row", "doc_id", "own", "text").unionByName(dealt).mapInArrow(_counted(order, buckets), counted)


def bucket_totals(found: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features a bucket over all documents; each task sums its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            bucket, n = (batch.column(k).flatten().to_numpy() for k in (0, 1))
            np.add.at(total, bucket, n)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return found.select("bucket", "n").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """A gain for each bucket, from two tables of bucket totals (at most ``buckets`` rows each)."""
    s, t = ({r.bucket: r.n for r in x.collect()} for x in (source, target))
    all_s, all_t = sum(s.values()) + float(buckets), sum(t.values()) + float(buckets)
    return [math.floor(1000 * math.log((t.get(b, 0) + 1.0) * all_s / ((s.get(b, 0) + 1.0) * all_t))) for b in range(buckets)]


def weights(found: DataFrame, gain: list[int]) -> DataFrame:
    """(row, doc_id, n_words, n_features, n_chunks, weight) of every document: chunk counts and weights summed."""
    values = np.array(gain, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, bucket, n = batch.column(4).offsets.to_numpy(), batch.column(4).flatten().to_numpy(), batch.column(5).flatten().to_numpy()
            total = np.append(0, np.cumsum(values[bucket] * n))[at - at[0]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(total[1:] - total[:-1])], names=["row", "doc_id", "n_words", "n_features", "total"])

    each = found.mapInArrow(run, "row long, doc_id long, n_words long, n_features long, total long")
    whole = each.filter("row % 2 = 0").withColumn("n_chunks", F.lit(1).cast("long"))
    sums = [F.sum(c).alias(c) for c in ("n_words", "n_features", "total")]
    cut = each.filter("row % 2 = 1").groupBy("row").agg(F.first("doc_id").alias("doc_id"), *sums, F.count("*").alias("n_chunks"))
    weight = F.coalesce(F.floor(F.try_divide(F.col("total").cast("double"), F.col("n_features"))), F.lit(0)).cast("long")
    return whole.unionByName(cut).select("row", "doc_id", "n_words", "n_features", "n_chunks", weight.alias("weight"))


def draw(weighted: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """``weighted`` with score and rank: the highest scores among documents of ``min_words``, NULL for those not drawn."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    scored = written(weighted.withColumn("score", F.col("weight") + noise).withColumn("may", F.col("n_words") >= min_words))
    by_score = scored.filter("may").groupBy("score").agg(F.count("*").alias("n"))
    running = by_score.select("score", (F.sum("n").over(W.orderBy(F.desc("score"))) - F.col("n")).alias("head"), F.floor(F.sum("n").over(W.partitionBy()) * percent / 100).alias("size"))
    heads = written(running.filter("head < size"))
    last = F.lit(heads.agg(F.min("score")).first()[0]).cast("long")
    high = F.coalesce(F.col("may") & (F.col("score") >= last), F.lit(False))
    place = F.col("head") + F.row_number().over(W.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "row"))
    top = scored.filter(high).join(heads, "score").withColumn("place", place).withColumn("rank", F.when(F.col("place") <= F.col("size"), F.col("place")).cast("long"))
    rest = scored.filter(~high).withColumn("rank", F.lit(None).cast("long"))
    return top.select(*weighted.columns, "score", "rank").unionByName(rest.select(*weighted.columns, "score", "rank"))


def resample(docs: DataFrame, target: DataFrame, target_id: str = "item_id", order: int = ORDER, buckets: int = BUCKETS, chunk_bytes: int = CHUNK_BYTES, **options) -> DataFrame:
    """(row, doc_id, n_words, n_features, n_chunks, weight, score, rank) of every document of docs."""
    found = written(features(docs, "doc_id", order, buckets, chunk_bytes))
    wanted = features(target, target_id, order, buckets, chunk_bytes)
    gain = gains(bucket_totals(found, buckets), bucket_totals(wanted, buckets), buckets)
    return draw(weights(found, gain), **options)


def op12_importance_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP12_SQL = f"""
WITH tab AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS ws FROM documents),
b AS MATERIALIZED (SELECT unnest({_WORDS}) AS w FROM benchmark),
dw AS MATERIALIZED (SELECT rid, w, count(*) AS n FROM (SELECT rid, unnest(ws) AS w FROM d) GROUP BY 1, 2),
v AS MATERIALIZED (SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(hex(w)) // 2 + 1), lambda i: CAST(concat('0x', substr(hex(w), 2 * i - 1, 2)) AS BIGINT))),
  lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 10000 AS k FROM (SELECT w FROM dw UNION SELECT w FROM b), tab),
s AS (SELECT k, sum(n) AS n FROM dw JOIN v USING (w) GROUP BY 1), t AS (SELECT k, count(*) AS n FROM b JOIN v USING (w) GROUP BY 1),
g AS MATERIALIZED (SELECT k, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1e0) * (coalesce((SELECT sum(n) FROM s), 0) + 10000e0) / ((coalesce(s.n, 0) + 1e0) * (coalesce((SELECT sum(n) FROM t), 0) + 10000e0)))) AS BIGINT) AS gain FROM s FULL JOIN t USING (k)),
m AS (SELECT rid, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / sum(n)) AS BIGINT) AS weight FROM dw JOIN v USING (w) JOIN g USING (k) GROUP BY 1),
x AS (SELECT rid, doc_id, len(ws) AS n_features, coalesce(weight, 0) AS weight, CAST(concat('0x', substr(sha256(concat('2024:', doc_id)), 1, 8)) AS BIGINT) AS h FROM d LEFT JOIN m USING (rid)),
y AS MATERIALIZED (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5e0) / 4294967296e0))) AS BIGINT) AS score, n_features >= 20 AS may FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN may AND r <= floor(10 * (SELECT count(*) FROM y WHERE may) / 100) THEN r END AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY may ORDER BY score DESC, doc_id, rid) AS r FROM y)
"""
