from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from splitforge.llm import nbsvm as N
from splitforge.llm.common import table

from .helpers import DOCS, awkward, frame, saved

SF = "/root/testdata/sf0.1"


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    for s in np.unique(score):
        rank[score == s] = rank[score == s].mean()
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_accuracy(spark):
    out = N.op4_nbsvm(spark, SF).join(table(spark, SF, "labels").select("doc_id", "quality"), "doc_id").filter("held_out and quality is not null").toPandas()
    score, y = out.score.to_numpy(), out.quality.to_numpy()
    kept = out.predicted.to_numpy() == 1
    assert ((score >= 0) & (score <= 1)).all() and (kept == (score >= 0.3)).all()
    assert auc(score, y) > 0.9
    assert kept[y == 1].mean() > 0.95  # clean documents stay


def test_labels_of_the_held_out_fold_do_not_matter(spark, tmp_path):
    docs, labels = table(spark, SF, "documents").filter("doc_id < 1500"), table(spark, SF, "labels").filter("doc_id < 1500")
    for k, frame_ in enumerate((labels, labels.withColumn("quality", F.when(N.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality"))))):
        docs.write.parquet(f"{tmp_path}/{k}/documents.parquet")
        frame_.write.parquet(f"{tmp_path}/{k}/labels.parquet")
    a, b = ({r.doc_id: r.score for r in N.op4_nbsvm(spark, f"{tmp_path}/{k}").collect()} for k in (0, 1))
    assert a == b
    held = {r.doc_id: r.held_out for r in N.op4_nbsvm(spark, f"{tmp_path}/0").collect()}
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in held.items())


def test_awkward_rows(spark, tmp_path):
    rows = awkward(3)
    saved(frame(spark, rows, extra=True), str(tmp_path), "documents")
    labels = [(r[0], k % 2, 0) for k, r in enumerate(rows)] + [(1, 0, None), (1, 1, None), (2, None, None), (None, 1, 1), (99_999, 1, 0)]
    saved(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), str(tmp_path), "labels")
    got = N.op4_nbsvm(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(r.score is not None and 0 <= r.score <= 1 for r in got)
    assert all(r.held_out for r in got if r.doc_id is None)
    saved(spark.createDataFrame([], "doc_id long, quality int, toxic int"), str(tmp_path), "labels")
    assert {r.score for r in N.op4_nbsvm(spark, str(tmp_path)).collect()} == {0.5}
    model, docs = N.fit(frame(spark, rows), table(spark, str(tmp_path), "labels")), frame(spark, rows, extra=True)
    with pytest.raises(ValueError):
        N.score(docs, model)
    assert N.score(docs, model, "quality").columns == [*docs.columns, "quality"]
    kept = N.accepted(docs.withColumn("__bytes", F.lit("b")), model, 0.5)
    assert kept.columns == [*docs.columns, "__bytes"] and {(r.score, r["__bytes"], r.key) for r in kept.collect()} == {("y", "b", "k")} and kept.count() == len(rows)
    saved(frame(spark, []), str(tmp_path), "documents")
    assert N.op4_nbsvm(spark, str(tmp_path)).count() == 0


def test_descent_reaches_the_dual_optimum():
    rng = np.random.default_rng(1)
    x = [np.unique(rng.integers(0, 30, 8)) for _ in range(60)]
    y = np.where(rng.random(60) < 0.5, 1.0, -1.0)
    scale, norm, cost = rng.normal(size=30), np.ones(60), np.full(60, 0.5)
    w, alpha = N.dual_coordinate_descent(x, scale, norm, y, cost, 2000)
    dense = np.zeros((60, 31))
    for i, f in enumerate(x):
        dense[i, f] = scale[f]
    dense[:, 30] = 1

    def primal(v):
        return 0.5 * v @ v + (cost * np.maximum(0, 1 - y * (dense @ v))).sum()

    best = primal(w)
    assert best - (alpha.sum() - 0.5 * w @ w) < 1e-2 * best and ((alpha >= 0) & (alpha <= cost)).all()
    assert np.allclose(w, (alpha * y) @ dense)
    for _ in range(300):
        assert primal(w + rng.normal(size=31) * 0.01) >= best - 1e-4


def grams(text):
    """The indicators by plain Python: words, word pairs, one- to three-grams of shapes."""
    words = (text or "").split()
    low = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    form = [re.sub(r"(.)\1+", r"\1", re.sub("[a-z]|[^\x00-\x7f]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", w)))) for w in words]
    form = ["again" if i and low[i] == low[i - 1] else f for i, f in enumerate(form)]
    return {("word", w) for w in low} | {("pair", *p) for p in zip(low, low[1:])} | {("shape", *form[i : i + n]) for n in (1, 2, 3) for i in range(len(form) - n + 1)}


def test_log_count_ratios_equal_a_plain_count(spark):
    rng = random.Random(5)
    good = lambda: " ".join(rng.choice(["tree", "river", "Old", "stone", "12", "bridge"]) for _ in range(12))
    bad = lambda: " ".join(rng.choice(["BUY", "now!!", "$$$", "win", "12", "bridge"]) for _ in range(12))
    rows = [(k, (good if k % 2 else bad)(), "en", "s", 1) for k in range(200)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(200)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    model = N.fit(docs, labels)
    learned = [r.doc_id for r in labels.filter(~N.held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    fitted = [d for i, d in enumerate(learned) if i % 5]  # the other fifth is for the sigmoid
    n = [sum(d % 2 == y for d in fitted) for y in (0, 1)]
    count = [Counter(g for d in fitted if d % 2 == y for g in grams(rows[d][1])) for y in (0, 1)]
    want = sorted(np.log((count[1][g] + 1) / (n[1] + 2)) - np.log((count[0][g] + 1) / (n[0] + 2)) for g in count[0] | count[1] if count[0][g] + count[1][g] >= 3)
    got = np.sort(model.scale[model.scale != 0])
    want = np.array([w for w in want if w != 0])
    assert len(got) == len(want) and np.allclose(got, want, atol=1e-5)


def test_the_bound_on_indicators(spark):
    rows = awkward(4)
    labels = spark.createDataFrame([(r[0], k % 2, 0) for k, r in enumerate(rows)], "doc_id long, quality int, toxic int")
    sizes = [len(x) for x in N._training_rows(frame(spark, rows), labels, 5, 8000, 10**9, N.BUCKETS).column("x").to_pylist()]
    most = sum(sizes[:20]) + 1
    assert N._training_rows(frame(spark, rows), labels, 5, 8000, most, N.BUCKETS).num_rows == 20


def test_empty_documents(spark):
    assert N.score(spark.createDataFrame([], DOCS), N.Model(np.zeros(N.BUCKETS), np.zeros(N.BUCKETS), 0.0, 1.0, 0.0)).count() == 0
