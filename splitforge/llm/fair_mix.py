"""Mixing sources to target weights by weighted fair queueing, in built-in functions only.

Targets: every source gets ``share`` times all words, split by weight; a target
stops at ``max_epochs`` times its source and the rest is dealt again by weight
(water filling: the level is the greatest of (budget - caps before) / (weights
from here on) over sources in order of cap / weight).

Within a source documents are shuffled by md5 of doc_id and seed and queued once an
epoch; a queued document's virtual finish time is the cumulative words of its source
so far divided by the source's target.  The queue is cut at the total budget in
order of finish time.  A histogram of finish times finds the bin in which the budget
ends; a bin of more than ``LAST_ROWS`` entries is cut by a finer histogram, and only
the entries of the last bin are summed up row by row.  Cumulative sums run within
(source, first hex digits of the md5), with the sums of the earlier digits added;
there are as many digits as keep a group under ``GROUP_ROWS`` rows.

Nulls: a null text has size 0; null is a source of its own and comes last; a null
doc_id is shuffled by the md5 of its text.  Rows that agree in doc_id, source and size
are queued in the order of the scan, so ties at the cut are broken row by row.  Texts of
any length are counted whole.  Extra columns are ignored, whatever their names; ``mixed``
returns them unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written

SHARE, MAX_EPOCHS, WEIGHTS, SEED = 1.5, 2, (3, 1, 2), "mix-1"
BINS, LAST_ROWS, GROUP_ROWS, LEVELS = 4096, 50_000, 250_000, 6
BROADCAST_BYTES = 8_000_000
_WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, share: float = SHARE, max_epochs: int = MAX_EPOCHS, weights: tuple = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from rows with source and size; one row a source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(order)
    weighted = per.withColumn("rank", rank).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1))
    budget = F.lit(share) * F.sum("source_size").over(W.partitionBy())
    cap = F.lit(max_epochs) * F.col("source_size")
    by_need = W.orderBy(cap / F.col("weight"), "rank")
    before = F.coalesce(F.sum(cap).over(by_need.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    level = (budget - before) / F.sum("weight").over(by_need.rowsBetween(0, W.unboundedFollowing))
    levelled = weighted.withColumn("level", level).withColumn("level", F.max("level").over(W.partitionBy()))
    return levelled.select("source", "source_size", F.least(cap.cast("double"), F.col("weight") * F.col("level")).alias("target"), (F.col("source_size") * F.lit(share)).alias("__share"))


def mix(docs: DataFrame, share: float = SHARE, max_epochs: int = MAX_EPOCHS, weights: tuple = WEIGHTS, seed: str = SEED) -> DataFrame:
    """(row, doc_id, source, size, source_size, target, epochs): how often the mix takes each row of docs; row numbers those of the scan."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "source")
    return _mix(rows, share, max_epochs, weights, seed)


def _measures(at: str, seed: str) -> list:
    """doc_id, source, size and shuffle key of a document whose columns are found at ``at``."""
    doc_id, text = F.col(f"{at}doc_id"), F.col(f"{at}text")
    name = F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return [
        doc_id.cast("long").alias("doc_id"),
        F.col(f"{at}source").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(name, F.lit(f":{seed}")).cast("binary")).alias("key"),
    ]


def _order() -> list:
    """The columns by which a source is queued, as fields of a struct."""
    return [F.col("key"), F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), F.col("size"), F.col("row")]


def _cut(entries: DataFrame, budget: float, last_rows: int):
    """Whether an entry (at: struct with v first, size) is taken, as a function of ``at``: in order of ``at`` sizes stay within the budget."""
    steps: list[tuple[float, float, int]] = []
    before, low, width, inside = 0, 0.0, 2.0 / BINS, entries

    def slot(v, low: float, width: float):
        return F.greatest(F.lit(0), F.least(F.floor((v - low) / width), F.lit(BINS))).cast("int")

    for _ in range(LEVELS):
        binned = inside.withColumn("bin", slot(F.col("at.v"), low, width))
        sums = sorted(binned.groupBy("bin").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect())  # BINS rows at most
        for one in sums:
            if before + one["size"] > budget:
                break
            before += one["size"]
        else:
            return lambda at: F.lit(True)
        steps.append((low, width, one["bin"]))
        inside = binned.filter(F.col("bin") == one["bin"]).drop("bin")
        if one["n"] <= last_rows or one["bin"] == BINS:
            break
        low, width = low + one["bin"] * width, width / BINS
    upto = before + F.sum("size").over(W.orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    last = inside.withColumn("upto", upto).filter(F.col("upto") <= budget).agg(F.max("at").alias("at")).first()["at"]

    def taken(at):
        less, same = F.lit(False), F.lit(True)
        for low, width, bin_ in steps:
            less = less | (same & (slot(at["v"], low, width) < bin_))
            same = same & (slot(at["v"], low, width) == bin_)
        if last is None:
            return less
        end = F.struct(*[F.lit(last[f.name]).cast(f.dataType).alias(f.name) for f in entries.schema["at"].dataType.fields])
        return less | (same & (at <= end))

    return taken


def _mix(docs: DataFrame, share: float, max_epochs: int, weights: tuple, seed: str, last_rows: int = LAST_ROWS) -> DataFrame:
    return _queue(docs.select("row", *_measures("", seed)), share, max_epochs, weights, last_rows).drop("key")


def _queue(measured: DataFrame, share: float, max_epochs: int, weights: tuple, last_rows: int = LAST_ROWS) -> DataFrame:
    rows = written(measured)
    targets = written(source_targets(rows, share, max_epochs, weights))
    budget, digits = targets.agg(F.sum("__share")).first()[0] or 0.0, 3
    while rows.count() > GROUP_ROWS * 16**digits:
        digits += 1
    rows = rows.withColumn("digits", F.substring("key", 1, digits))

    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    per = rows.groupBy("source", "digits").agg(F.sum("size").alias("n"))
    prefix = per.select("source", "digits", (F.sum("n").over(W.partitionBy("source").orderBy("digits")) - F.col("n")).alias("before"))
    heads = prefix.join(targets, same(prefix, targets)).select(prefix["source"], "digits", "before", "source_size", "target")
    queued = rows.join(heads, same(rows, heads) & (rows["digits"] == heads["digits"])).select(rows["*"], "before", "source_size", "target")
    running = W.partitionBy("source", "digits").orderBy("key", "doc_id", "size", "row").rowsBetween(W.unboundedPreceding, 0)
    queued = written(queued.withColumn("reached", F.col("before") + F.sum("size").over(running)).drop("before", "digits"))

    def place(epoch):
        finish = F.coalesce(F.try_divide(F.col("reached") + epoch * F.col("source_size"), F.col("target")), F.lit(0.0))
        return F.struct(
            finish.alias("v"), F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source"), *_order(), epoch.cast("int").alias("epoch")
        )

    epochs = [F.lit(e) for e in range(max_epochs)]
    taken = _cut(queued.select("size", F.explode(F.array(*map(place, epochs))).alias("at")), budget, last_rows)
    times = sum((taken(place(e)).cast("int") for e in epochs[1:]), taken(place(epochs[0])).cast("int"))
    return queued.select("row", "doc_id", "source", "size", "key", "source_size", "target", times.alias("epochs"))


def mixed(docs: DataFrame, share: float = SHARE, max_epochs: int = MAX_EPOCHS, weights: tuple = WEIGHTS, seed: str = SEED, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents that the mix takes, each as often as it takes them; columns as in docs.

    What an epoch takes of a source is a head of its queue, so its last entry tells
    for every document whether it is taken.  These ends, a row a source, go to the
    documents, whose texts stay where they are; where the ends could pass
    ``broadcast_bytes``, the documents are joined with the mix by row instead.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc"))
    rows = written(rows.select("row", "doc", *_measures("doc.", seed)))
    plan = _queue(rows.drop("doc"), share, max_epochs, weights).filter("epochs > 0")
    at = F.struct(*_order())
    ends = written(plan.groupBy("source").agg(*(F.max(F.when(F.col("epochs") > e, at)).alias(f"end_{e}") for e in range(max_epochs))))
    names = ends.agg(F.count("*").alias("n"), F.sum(F.octet_length("source")).alias("bytes")).first()
    if names["n"] * 128 * (1 + max_epochs) + (names["bytes"] or 0) <= broadcast_bytes:
        last = F.broadcast(ends)
        taken = sum((F.coalesce(at <= F.col(f"end_{e}"), F.lit(False)).cast("int") for e in range(max_epochs)), F.lit(0))
        often = rows.join(last.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).select("doc", taken.alias("epochs"))
    else:
        often = rows.select("row", "doc").join(plan.select("row", "epochs"), "row")
    return often.filter("epochs > 0").select("doc", F.explode(F.array_repeat(F.lit(0), F.col("epochs"))).alias("time")).select("doc.*")


def op8_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("epochs")).alias("taken"), "source")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5(concat(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))), ':mix-1')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
g AS (SELECT *, [3, 1, 2][(rank - 1) % 3 + 1] AS weight, 1.5e0 * sum(source_size) OVER () AS budget FROM r),
l AS (SELECT *, (budget - coalesce(sum(2 * source_size) OVER (ORDER BY CAST(2 * source_size AS DOUBLE) / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY CAST(2 * source_size AS DOUBLE) / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM g),
t AS (SELECT source, source_size, budget, least(CAST(2 * source_size AS DOUBLE), weight * max(level) OVER ()) AS target FROM l),
q AS (SELECT d.doc_id, d.source, size, source_size, target, budget, key, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS reached FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN target > 0 THEN CAST(reached + epoch * source_size AS DOUBLE) / target ELSE 0e0 END AS v FROM q, (VALUES (0), (1)) AS p(epoch)),
c AS (SELECT *, sum(size) OVER (ORDER BY v, source NULLS LAST, key, doc_id, size, epoch ROWS UNBOUNDED PRECEDING) AS upto FROM e)
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN upto <= budget THEN size ELSE 0 END) AS BIGINT) AS taken, source FROM c GROUP BY doc_id, size, source_size, target, source
"""
