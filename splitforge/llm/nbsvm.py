"""Quality scores from Naive Bayes support vectors.

Each document is the set of its n-gram indicators: lower-cased words and pairs of
words, and one- to three-grams of word shapes (runs of letters, digits and symbols collapsed; a word
equal to the one before it is the shape "again").  Indicators are hashed to
``buckets``, scaled by the log-count ratios of the two classes and brought to unit
length.  A linear hinge-loss model is fitted on them by dual coordinate descent,
and a sigmoid fitted on rows that the descent did not see makes margins into
probabilities.

Bound: the model is fitted on at most ``max_train`` labelled rows, the ones with
the least hash of doc_id among all labelled rows outside the held-out fold
(crc32(doc_id) mod ``folds`` = 0), and on as many of these, in this order, as hold
``max_indicators`` indicators together (80 MB in the task that fits; the driver gets the model alone).  Scoring covers every
document and every word, very long texts one at a time.
The model is a vector of ``buckets`` floats, broadcast at a size fixed in advance.

Inputs of a score are text alone.  A null or empty text has no indicators and
gets the score of the bias.  Labels that are null or contradict each other for a
doc_id are not learned from; without two classes the score is the smoothed share
of label 1.  A null doc_id counts as held out.  Repeated rows each get their row; of a
labelled doc_id with several texts the least text is learned from.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesops as B
from .common import table, written

BUCKETS, MAX_TRAIN, MAX_INDICATORS, FOLDS, THRESHOLD = 1 << 18, 8_000, 20_000_000, 5, 0.3
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x30:0x3A] = ord("0")
_SHAPE[0x41:0x5B] = ord("A")
_SHAPE[0x61:0x7B] = ord("a")
_SHAPE[0x80:] = ord("a")
_AGAIN = np.uint64(0x1234567)


def indicators(buf: np.ndarray, at: np.ndarray, buckets: int, hasher: B.Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (row, bucket) of a chunk of texts."""
    start, end, doc = B.words(buf, at, B.NOT_SPACE)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = hasher.spans(hasher.prefix(B.LOWER[buf]), start, end)
    shape = _SHAPE[buf]
    new = np.ones(len(buf), bool)
    new[1:] = shape[1:] != shape[:-1]
    new[start] = True
    place = np.append(0, np.cumsum(new))
    form = hasher.spans(hasher.prefix(shape[new]), place[start], place[end])
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    form[again] = _AGAIN
    grams = [(word * np.uint64(3), doc), (form * np.uint64(5), doc)]
    near = doc[1:] == doc[:-1]
    grams.append((B.mix(word[:-1] * np.uint64(7) + word[1:])[near], doc[1:][near]))
    prior = form
    for n in (2, 3):
        prior = B.mix(prior[:-1] * np.uint64(31) + form[n - 1 :])
        ok = doc[n - 1 :] == doc[: len(doc) - n + 1]
        grams.append((prior[ok], doc[n - 1 :][ok]))
    keys = [(d.astype(np.uint64) << np.uint64(32)) | (B.mix(h + np.uint64(k)) % np.uint64(buckets)) for k, (h, d) in enumerate(grams)]
    keys = np.unique(np.concatenate(keys))
    return (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def _training_sample(docs: DataFrame, labels: DataFrame, folds: int, max_train: int, max_indicators: int, buckets: int) -> DataFrame:
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds))
    clear = usable.groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("y2")).filter("y = y2")
    chosen = clear.withColumn("rank", F.xxhash64("doc_id")).orderBy("rank", "doc_id").limit(max_train).select("doc_id", "y", "rank")
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y", "rank").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = B.Hasher()
        for batch, buf, at in B.chunks(batches, "text"):
            row, bucket = indicators(buf, at, buckets, hasher)
            cut = np.append(0, np.cumsum(np.bincount(row, minlength=batch.num_rows))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(bucket.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), lists], names=["rank", "y", "x"])

    rows = written(texts.select("text", "rank", F.col("y").cast("int").alias("y")).mapInArrow(run, "rank long, y int, x array<int>"))
    sizes = rows.select("rank", F.size("x").alias("n")).toArrow().sort_by("rank")  # two numbers a row
    fit = int((np.cumsum(sizes.column("n").to_numpy()) <= max_indicators).sum())
    if fit < len(sizes):
        rows = rows.filter(F.col("rank") < sizes.column("rank")[fit].as_py())
    return rows


def _training_rows(*args) -> pa.Table:
    """The sample on the driver, in order of rank: to look at, the fit does not use it."""
    return _training_sample(*args).toArrow().sort_by("rank")


def dual_coordinate_descent(x: list[np.ndarray], scale: np.ndarray, norm: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Weights (last: bias) and dual variables of the L1-loss linear SVM over x[i] = scale[features] / norm[i], with a constant feature 1."""
    w, alpha = np.zeros(len(scale) + 1), np.zeros(len(x))
    values = [scale[f] / n for f, n in zip(x, norm)]
    squares = np.array([float(v @ v) + 1.0 for v in values])
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(x)):
            f, v = x[i], values[i]
            g = y[i] * (w[f] @ v + w[-1]) - 1.0
            new = min(max(alpha[i] - g / squares[i], 0.0), cost[i])
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[f] += step * y[i] * v
                w[-1] += step * y[i]
                worst = max(worst, abs(step))
        if worst < 1e-3:
            break
    return w, alpha


def _sigmoid_fit(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a m + b))) by Newton steps on smoothed targets."""
    pos, neg = int(y.sum()), int(len(y) - y.sum())
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        r, s = t - p, p * (1 - p) + 1e-9
        g = np.array([r @ margin, r.sum()]) - 1e-6 * np.array([a, b])
        h = np.array([[s @ (margin * margin), s @ margin], [s @ margin, s.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -5, 5)), b + float(np.clip(step[1], -5, 5))
        if np.abs(step).max() < 1e-6:
            break
    return a, b


class Model:
    """scale: log-count ratios; weights, bias: the SVM; a, b: the sigmoid."""

    def __init__(self, scale: np.ndarray, weights: np.ndarray, bias: float, a: float, b: float) -> None:
        self.scale, self.weights, self.bias, self.a, self.b = scale.astype(np.float32), (weights * scale).astype(np.float32), bias, a, b

    def scores(self, row: np.ndarray, bucket: np.ndarray, rows: int) -> np.ndarray:
        norm = np.sqrt(np.bincount(row, (self.scale**2)[bucket], rows)) + 1e-9
        margin = np.bincount(row, self.weights[bucket], rows) / norm + self.bias
        return 1 / (1 + np.exp(-np.clip(self.a * margin + self.b, -30, 30)))


def _fitted(rows: pa.Table, buckets: int, min_rows: int, epochs: int, cost: float) -> Model:
    """The model of training rows (rank, y, x) in order of rank."""
    y = rows.column("y").to_numpy()
    flat = rows.column("x").combine_chunks() if len(y) else None
    x = [flat[i].values.to_numpy() for i in range(len(y))]
    fitted = np.arange(len(y)) % 5 != 0
    if len(y) < 10 or len(np.unique(y[fitted])) < 2 or len(np.unique(y[~fitted])) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(buckets), np.zeros(buckets), 0.0, 0.0, float(np.log(share / (1 - share))))

    counts = [np.bincount(np.concatenate([x[i] for i in np.flatnonzero(fitted & (y == k))] or [np.zeros(0, np.int32)]), minlength=buckets) for k in (0, 1)]
    rows_of = [int((fitted & (y == k)).sum()) for k in (0, 1)]
    scale = np.log((counts[1] + 1) / (rows_of[1] + 2)) - np.log((counts[0] + 1) / (rows_of[0] + 2))
    scale[counts[0] + counts[1] < min_rows] = 0.0
    norm = np.array([np.sqrt((scale[f] ** 2).sum()) + 1e-9 for f in x])
    use = np.flatnonzero(fitted)
    sign = np.where(y[use] == 1, 1.0, -1.0)
    weight = np.where(y[use] == 1, 1.0, min(10.0, rows_of[1] / rows_of[0]))
    w, _ = dual_coordinate_descent([x[i] for i in use], scale, norm[use], sign, cost * weight, epochs)
    rest = np.flatnonzero(~fitted)
    margin = np.array([w[x[i]] @ scale[x[i]] / norm[i] + w[-1] for i in rest])
    a, b = _sigmoid_fit(margin, y[rest])
    return Model(scale, w[:-1], float(w[-1]), a, b)


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, max_train: int = MAX_TRAIN, max_indicators: int = MAX_INDICATORS, buckets: int = BUCKETS, min_rows: int = 3, epochs: int = 20, cost: float = 1.0) -> Model:
    """The model; labels has doc_id and quality (0 or 1)."""
    rows = _training_sample(docs, labels, folds, max_train, max_indicators, buckets)
    schema = pa.schema([("rank", pa.int64()), ("y", pa.int32()), ("x", pa.list_(pa.int32()))])

    def model_of(sample: pa.Table) -> Model:
        return _fitted(sample.sort_by("rank"), buckets, min_rows, epochs, cost)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(pa.Table.from_batches([b.cast(schema) for b in batches], schema))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)])], names=["model"])

    # one task fits the bounded sample: its memory is not the driver's, and a lost executor only costs another attempt
    found = rows.select("rank", "y", "x").coalesce(1).mapInArrow(run, "model binary").first()
    return pickle.loads(found["model"]) if found else model_of(schema.empty_table())


def _scored(docs: DataFrame, model: Model, buckets: int) -> DataFrame:
    """(doc, score): whole rows as structs, so no column of the caller can clash."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    raw = docs.select(F.struct(*docs.columns).alias("doc"), F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, model = B.Hasher(), shared.value
        for batch, buf, at in B.chunks(batches, "text"):
            row, bucket = indicators(buf, at, buckets, hasher)
            value = model.scores(row, bucket, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value)], names=["doc", "score"])

    return raw.mapInArrow(run, raw.select("doc", F.lit(0.0).alias("score")).schema)


def score(docs: DataFrame, model: Model, name: str = "score", buckets: int = BUCKETS) -> DataFrame:
    """All columns of docs and ``name``, the probability of label 1."""
    if name in docs.columns:
        raise ValueError(f"docs has a column {name}; choose another name")
    return _scored(docs, model, buckets).select("doc.*", F.col("score").alias(name))


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """The documents that score ``threshold`` or more; columns as in docs."""
    return _scored(docs, model, buckets).filter(F.col("score") >= threshold).select("doc.*")


def op4_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
