r"""Interaction of document filters over all orders of applying them, with duplicates by partition refinement.

Duplicates: rows are split by code-point length, then by the hash of one block of the
text after the other (``BLOCKS`` bytes, then the rest); after each step rows that are
alone in their class drop out, so each step looks at fewer rows, and only rows of a
fixed size are moved.  The full texts of the classes that are left are compared: a
second scan sends on only texts that can belong to one of them (a bitmap of
``BITS`` bits of class hashes, of a fixed size and so broadcast, keeps the others back; what
it lets through by chance is dropped by the comparison), and rows are grouped by class and
whole text, equal ones combined before the shuffle.  Rows whose id is not the least of
their text are duplicates.  Should two texts of a class differ, its rows are matched by
their texts.

Every row has a mask of the filters it fails.  Masks are counted by part, and the
numbers of all orders follow from those counts: after a set of filters is applied, the
rows without any of its bits are left.

Nulls: a null text is empty; a null part is the empty string; a null doc_id is neither
a duplicate nor makes one, and has no label.  Repeated rows count each, and with equal
ids are no duplicates of each other; a document with several label rows has a label if
any row has it.  Very long texts are measured whole.  An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesops as B
from .common import table, written

FILTERS, MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = "ABCDE", 50, 65, 5
BLOCKS, BITS = (64, 1024), 1 << 23
_MARK = re.compile(rb"[#$%&*|]")
_CAPITAL = B.table(range(0x41, 0x5B))
KEYS = ["n_points", *[f"b{k}" for k in range(len(BLOCKS) + 1)]]
_KEY_TYPES = ", ".join(f"{k} long" for k in KEYS)


def _mask(text: bytes, points: int, capitals: int) -> int:
    """Bits of the filters A to D that a text fails."""
    words = text.split()  # cuts at exactly the six ASCII white-space bytes
    return (len(words) < MIN_WORDS) | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1 | (100 * capitals > CAPITAL_PERCENT * points) << 2 | bool(_MARK.search(text)) << 3


def _blocks(text: bytes, keep: int) -> list[int]:
    """Signed hashes of the successive blocks of a text, the last of all that is left; only ``keep`` bits of each."""
    cuts = [0, *np.cumsum(BLOCKS).tolist(), max(len(text), sum(BLOCKS))]
    return [xxhash.xxh3_64_intdigest(text[a:b]) % (1 << keep) - (1 << keep - 1) for a, b in zip(cuts, cuts[1:])]


def _measured(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes], np.ndarray, np.ndarray]]:
    """Slices of the batches with their texts, code points and capitals."""
    for part, buf, at in B.chunks(batches, column):
        points, capitals = (np.append(0, np.cumsum(x))[at] for x in ((buf & 0xC0) != 0x80, _CAPITAL[buf]))
        data = buf.tobytes()
        yield part, [data[a:b] for a, b in zip(at.tolist(), at[1:].tolist())], points[1:] - points[:-1], capitals[1:] - capitals[:-1]


def _texts(docs: DataFrame, part: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"))


def profiles(docs: DataFrame, part: str = "source", keep: int = 64) -> DataFrame:
    """(doc_id, part, mask, n_points, b0, b1 ...) of every row: the filters A to D that it fails, its length and block hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts, points, capitals in _measured(batches, "text"):
            masks = [_mask(t, p, c) for t, p, c in zip(texts, points.tolist(), capitals.tolist())]
            blocks = np.array([_blocks(t, keep) for t in texts], np.int64)
            columns = [rows.column(0), rows.column(1), pa.array(masks, pa.int32()), pa.array(points.astype(np.int64)), *[pa.array(b) for b in blocks.T]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "mask", *KEYS])

    return _texts(docs, part).mapInArrow(run, f"doc_id long, part string, mask int, {_KEY_TYPES}")


def refined(rows: DataFrame) -> DataFrame:
    """The rows that share their length and all block hashes with another row, found block by block."""
    for k in range(1, len(KEYS) + 1):
        classes = rows.groupBy(*KEYS[:k]).agg(F.count("*").alias("n")).filter("n > 1").select(*KEYS[:k])
        rows = written(rows.join(classes, KEYS[:k], "left_semi"))
    return rows


def _bit(keys: list[Column]) -> Column:
    out = keys[0]
    for k in keys[1:]:
        out = out.bitwiseXOR(k)
    return F.pmod(out, F.lit(BITS))


def _bitmap(classes: DataFrame) -> bytes:
    """BITS / 8 bytes with a set bit for each class."""
    bit = classes.select(_bit([F.col(k) for k in KEYS]).alias("p"))
    pieces = bit.groupBy((F.col("p") / 32768).cast("int").alias("at")).agg(F.bitmap_construct_agg(F.col("p") % 32768).alias("bits"))
    out = bytearray(BITS // 8)
    for r in pieces.collect():  # BITS / 32768 rows at most
        out[r.at * 4096 : r.at * 4096 + len(r.bits)] = r.bits
    return bytes(out)


def _candidates(docs: DataFrame, bitmap: bytes, part: str, keep: int) -> DataFrame:
    """(doc_id, n_points, b0 ..., text) of the rows whose class can be one of the bitmap's."""
    held = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(held.value, np.uint8)
        for rows, texts, points, _ in _measured(batches, "text"):
            keys = np.column_stack([points.astype(np.int64), np.array([_blocks(t, keep) for t in texts], np.int64)])
            p = np.bitwise_xor.reduce(keys, axis=1) % BITS
            some = np.flatnonzero(bits[p >> 3] >> (p & 7).astype(np.uint8) & 1)
            columns = [rows.column(0).take(pa.array(some)), *[pa.array(k) for k in keys[some].T], rows.column(2).take(pa.array(some))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *KEYS, "text"])

    return _texts(docs, part).mapInArrow(run, f"doc_id long, {_KEY_TYPES}, text binary")


def duplicates(docs: DataFrame, rows: DataFrame, part: str = "source", keep: int = 64) -> DataFrame:
    """The rows of ``rows`` (profiles, perhaps with more columns) whose text a row with a smaller doc_id has too."""
    alive = refined(rows)
    classes = written(alive.groupBy(*KEYS).agg(F.min("doc_id").alias("least")))
    compared = _candidates(docs, _bitmap(classes), part, keep)
    firsts = compared.groupBy(*KEYS, "text").agg(F.min("doc_id").alias("least"))
    per_class = written(firsts.groupBy(*KEYS).agg(F.count("*").alias("texts"), F.min("least").alias("least")))
    # written, so that both sides of the join are plain shuffles, which Spark can split at a large class
    found = alive.join(per_class.filter("texts = 1").select(*KEYS, "least"), KEYS).filter("doc_id > least").drop("least")
    mixed = per_class.filter("texts > 1").select(*KEYS)
    if mixed.isEmpty():
        return found
    same = written(compared.join(mixed, KEYS, "left_semi"))
    text_firsts = same.groupBy(*KEYS, "text").agg(F.min("doc_id").alias("least"))
    later = same.join(text_firsts, [*KEYS, "text"]).filter("doc_id > least").select("doc_id", *KEYS).distinct()
    return found.unionByName(alive.join(later, ["doc_id", *KEYS], "left_semi").select(*found.columns))


def masks(docs: DataFrame, labels: DataFrame, part: str = "source", keep: int = 64) -> DataFrame:
    """(part, mask, n, good, toxic): rows by the set of filters they fail (bit 0 is A, bit 4 is E), with their labels."""
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = written(profiles(docs, part, keep).join(known, "doc_id", "left").na.fill(0, ["good", "toxic"]))
    count = lambda df, mask, sign: df.groupBy("part", "mask", "good", "toxic").agg((F.count("*") * sign).alias("n")).withColumn("mask", F.col("mask").bitwiseOR(F.lit(mask)))
    copies = written(duplicates(docs, rows, part, keep).select("part", "mask", "good", "toxic"))
    every = count(rows, 0, 1).unionByName(count(copies, 0, -1)).unionByName(count(copies, 16, 1))
    return every.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def audit(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row a part, order of the filters and step, from (part, mask, n, good, toxic)."""
    bits, whole = len(filters), (1 << len(filters)) - 1
    # left["n"][s]: rows that fail none of the filters in the set s
    left = [F.array(*[F.coalesce(F.sum(F.when(F.col("mask").bitwiseAND(F.lit(s)) == 0, F.col(c))), F.lit(0)) for s in range(whole + 1)]).alias(c) for c in ("n", "good", "toxic")]
    parts = counted.groupBy("part").agg(*left)
    gone = lambda c, s, f: F.get(c, s) - F.get(c, s.bitwiseOR(f))
    # each order and step as one number: filters before, the filter, the step
    orders = [[("".join(filters[k] for k in order), sum(1 << k for k in order[:i]), order[i], i + 1) for i in range(bits)] for order in permutations(range(bits))]
    steps = [x for order in orders for x in order]
    names = F.array(*[F.lit(x[0]) for x in steps])
    codes = F.array(*[F.lit(x[1] | x[2] << 8 | x[3] << 16) for x in steps])
    out = parts.select("*", F.posexplode(codes).alias("at", "code")).withColumn("filter_order", F.get(names, F.col("at")))
    before, k = F.col("code").bitwiseAND(F.lit(255)), F.shiftright("code", 8).bitwiseAND(F.lit(255))
    out = out.withColumns({"before": before, "bit": F.element_at(F.array(*[F.lit(1 << i) for i in range(bits)]), k + 1), "step": F.shiftright("code", 16)})
    s, f, none = F.col("before"), F.col("bit"), F.lit(0)
    times = lambda p: factorial(bin(p).count("1")) * factorial(bits - 1 - bin(p).count("1"))
    shapley = None
    for p in range(whole + 1):
        if bin(p).count("1") < bits:
            one = F.when(F.lit(p).bitwiseAND(f) == 0, gone("n", F.lit(p), f) * times(p)).otherwise(0)
            shapley = one if shapley is None else shapley + one
    rest = F.lit(whole).bitwiseXOR(f)
    numbers = {
        "kept": F.get("n", s.bitwiseOR(f)),
        "removed": gone("n", s, f),
        "redundant": gone("n", none, f) - gone("n", s, f),
        "unique_fails": gone("n", rest, f),
        "good_lost": gone("good", s, f),
        "toxic_lost": gone("toxic", s, f),
        "shapley": shapley,
    }
    return out.select("part", "filter_order", F.col("step").cast("int").alias("step"), *[c.cast("long").alias(name) for name, c in numbers.items()])


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP13_SQL = r"""
WITH lab AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS MATERIALIZED (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 5 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
  || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails FROM d LEFT JOIN lab USING (doc_id)),
h AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2),
l(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT concat(a.x, b.x, c.x, e.x, f.x) AS o FROM l a, l b, l c, l e, l f WHERE len(list_distinct([a.x, b.x, c.x, e.x, f.x])) = 5),
s AS (SELECT o, i, substr(o, i, 1) AS f, substr(o, 1, i - 1) AS before FROM o, range(1, 6) r(i)),
x AS (SELECT part, o AS filter_order, CAST(i AS INTEGER) AS step, f, n, good, toxic, contains(fails, f) AS fails_it, fails = f AS alone, before <> '' AND regexp_matches(fails, concat('[', before, '0]')) AS earlier FROM s, h),
y AS (SELECT part, filter_order, step, any_value(f) AS f, coalesce(sum(n) FILTER (WHERE NOT earlier AND NOT fails_it), 0) AS kept, coalesce(sum(n) FILTER (WHERE NOT earlier AND fails_it), 0) AS removed, coalesce(sum(n) FILTER (WHERE earlier AND fails_it), 0) AS redundant,
  coalesce(sum(n) FILTER (WHERE alone), 0) AS unique_fails, coalesce(sum(good) FILTER (WHERE NOT earlier AND fails_it), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE NOT earlier AND fails_it), 0) AS toxic_lost FROM x GROUP BY 1, 2, 3)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM y
"""
