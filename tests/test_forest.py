"""Forests over tasks: cuts against all cuts tried one by one, and what the trees say."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from splitforge.operators import forest
from splitforge.operators import metrics as M


@pytest.mark.parametrize("classes", [0, 3])
@pytest.mark.parametrize(("cells", "rows"), [(1, 7), (forest.CELLS, 50), (forest.CELLS, forest.ROWS)])
def test_best_cuts_equal_all_cuts_tried(monkeypatch, classes, cells, rows):
    monkeypatch.setattr(forest, "CELLS", cells)
    monkeypatch.setattr(forest, "ROWS", rows)
    rng = np.random.default_rng(1)
    codes, at = rng.integers(0, 6, (120, 5)).astype(np.uint8), rng.integers(0, 7, 120)
    codes[at == 3] = 2  # nothing to cut
    y, weight = (rng.integers(0, 3, 120) if classes else rng.normal(size=120)), rng.integers(1, 4, 120).astype(float)
    features = np.tile([0, 2, 3], (7, 1))

    def left_over(some):
        w = weight[some]
        if classes:
            return w.sum() - sum(w[y[some] == c].sum() ** 2 for c in range(3)) / w.sum()
        return (w * (y[some] - np.average(y[some], weights=w)) ** 2).sum()

    feature, cut = forest.best_cuts(codes, at, y, weight, features, classes)
    for node in range(7):
        own = at == node
        tried = {}
        for f, c in itertools.product([0, 2, 3], range(6)):
            left, right = own & (codes[:, f] <= c), own & (codes[:, f] > c)
            if left.any() and right.any():
                tried[f, c] = left_over(left) + left_over(right)
        if node == 3:
            assert not tried and feature[node] == -1
        else:
            assert tried[feature[node], cut[node]] == pytest.approx(min(tried.values()))


def _rows(spark, n, parts):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, 4))
    rows = [(k, x[k].tolist(), int((x[k, 0] > 0) != (x[k, 1] > 0)), float(x[k, 2] > 0.5) * 10) for k in range(n)]
    return spark.createDataFrame(rows, "id long, x array<double>, c int, v double").repartition(parts)


def test_the_whole_forest_fits_and_does_not_depend_on_tasks(spark, monkeypatch):
    rows = _rows(spark, 500, 3)
    out = M.forest_predictions(rows.filter("id % 5 > 0"), rows, "id", "x", "c").collect()
    assert len(out) == 500 and {r.pred for r in out} == {0.0, 1.0}
    assert all(r.pred == r.c for r in out if r.id % 5)
    assert np.mean([r.pred == r.c for r in out if r.id % 5 == 0]) > 0.85
    monkeypatch.setattr(forest, "TASKS", 31)
    again = _rows(spark, 500, 7)
    again = M.forest_predictions(again.filter("id % 5 > 0"), again, "id", "x", "c").collect()
    assert {r.id: r.score for r in out} == {r.id: r.score for r in again}


def test_forests_of_numbers_and_of_one_class(spark):
    rows = _rows(spark, 300, 2)
    out = M.forest_predictions(rows.filter("id < 200"), rows, "id", "x", "v", "regression", trees=20).collect()
    assert max(abs(r.pred - r.v) for r in out if r.id < 200) < 5 and np.mean([abs(r.pred - r.v) for r in out]) < 0.5
    one = M.forest_predictions(rows.filter("c = 0"), rows, "id", "x", "c", trees=5).collect()
    assert {(r.pred, r.score) for r in one} == {(0.0, 0.0)}
    with pytest.raises(ValueError):
        M.forest_predictions(rows.filter("v > 0").withColumn("c", rows.c - 1), rows, "id", "x", "c", trees=5)
