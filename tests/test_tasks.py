from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from splitforge.operators import metrics as M
from splitforge.operators import tasks as T
from splitforge.sources import read_summary


def test_duplicates_by_kind(spark):
    rows = spark.createDataFrame([(0, "a", 1, 1), (1, "a", 2, None), (2, "b", 3, 5)], "n int, k string, y int, z int")
    got = lambda kind: {r.k: r.y for r in T.resolve_duplicates(rows, kind, "k", "n", ["y", "z"]).collect()}
    assert got("text_only") == {"a": 1, "b": 3}
    assert got("regression") == {"a": 1.5, "b": 3.0}
    assert got("classification") == {"b": 3} and got("multitask") == {"b": 3}
    with pytest.raises(ValueError):
        got("other")


def test_targets(spark):
    rows = spark.createDataFrame([("1.9",), ("0",)], "y string")
    assert [r[0] for r in rows.select(T.target(F.col("y"), "classification")).collect()] == [1, 0]
    assert [r[0] for r in rows.select(T.target(F.col("y"), "regression")).collect()] == [1.9, 0.0]
    for bad in ("x", None):
        with pytest.raises(Exception, match="target is missing"):
            spark.createDataFrame([(bad,)], "y string").select(T.target(F.col("y"), "regression")).collect()


def test_metrics_and_task_types(spark):
    both = ["val_mae_mean", "test_mae_mean", "val_rmse_mean", "test_rmse_mean", "val_r2_mean", "test_r2_mean"]
    assert T.metrics_for("regression", both) == ["mae", "rmse"]  # r2 is not compared
    with pytest.warns(UserWarning, match="rmse is left out: no column test_rmse_mean"):
        assert T.metrics_for("regression", [c for c in both if c != "test_rmse_mean"]) == ["mae"]
    with pytest.warns(UserWarning):
        for columns in (["mae", "rmse", "r2"], ["val_mae_mean", "train_mae_mean"]):
            with pytest.raises(ValueError, match="no regression metrics"):
                T.metrics_for("regression", columns)
    with pytest.raises(ValueError, match="unknown task"):
        T.metrics_for("other", both)
    rows = spark.createDataFrame([("a", "regression"), ("a", None), ("b", "classification")], "d string, t string")
    assert {(r.d, r.t) for r in T.task_types(rows, "d", "t").collect()} == {("a", "regression"), ("b", "classification")}
    for bad in ([("a", "regression"), ("a", "classification")], [("a", None)]):
        with pytest.raises(Exception, match="not exactly one task"):
            T.task_types(spark.createDataFrame(bad, "d string, t string"), "d", "t").collect()


def test_pairs_and_result_rows(spark):
    i, j = T.random_pair(spark.range(9), "id").first()
    assert 0 <= i < j < 9
    assert T.random_pair(spark.range(1), "id").count() == 0
    rows = spark.createDataFrame([("r", "train", 1.0), ("r", "test", 0.5)], "run string, split string, r2 double")
    assert T.result_rows(rows, ["run"], ["r2"]).first().asDict() == {"run": "r", "train_r2": 1.0, "val_r2": None, "test_r2": 0.5}


def test_kinds_and_choices():
    assert [T.dataset_kind(n) for n in ("bbbp.csv", "/data/solv.csv.gz", "qm9_smiles")] == ["classification", "regression", "text_only"]
    assert T.dataset_kind("mine.csv", {"mine": "multitask"}) == "multitask"
    with pytest.raises(ValueError, match="not known"):
        T.dataset_kind("mine.csv")
    assert T.choices(None, ["a", "b"]) == ["a", "b"] and T.choices(["b"], ["a", "b"]) == ["b"]
    with pytest.raises(ValueError, match="unknown bits: c, d"):
        T.choices(["d", "a", "c"], ["a", "b"], "bits")


def test_summary_becomes_long(spark, tmp_path):
    (tmp_path / "s.csv").write_text("dataset,task,run_count,val_mae_mean,val_mae_std,test_mae_mean,test_mae_std,test_rmse_mean\nd,regression,2,1.5,,2.5,0.5,9\n")
    wide = read_summary(spark, str(tmp_path / "s.csv"), ["dataset", "task"])
    assert M.numeric_columns(wide, ("run_count",)) == ["val_mae_mean", "val_mae_std", "test_mae_mean", "test_mae_std", "test_rmse_mean"]
    with pytest.warns(UserWarning, match="rmse"):
        got = {(r.dataset, r.split, r.metric, r.stat): r.value for r in T.summary_long(wide, ["dataset"], "regression").collect()}
    assert got == {("d", "val", "mae", "mean"): 1.5, ("d", "val", "mae", "std"): None, ("d", "test", "mae", "mean"): 2.5, ("d", "test", "mae", "std"): 0.5}
    (tmp_path / "none.csv").write_text("dataset,task\n")
    for path, keys in (("none.csv", ["dataset"]), ("s.csv", ["absent"])):
        with pytest.raises(ValueError):
            read_summary(spark, str(tmp_path / path), keys)


def test_parameters_as_text():
    assert M.hyperparameters_text("regression") == '{"depth": 30, "features": "0.5", "seed": 42, "trees": 500}'
    assert '"class_weight": "balanced"' in M.hyperparameters_text("classification")
