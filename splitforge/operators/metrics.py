"""Classification and regression metrics of a predictions table, run summaries, forests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .forest import forest_means
from .shared import matched, running, saved

FOREST = {"trees": 500, "depth": 30, "features": "0.5", "seed": 42}


def classification_metrics(rows: DataFrame, by: list[str], positive: int = 1) -> DataFrame:
    """(by, n, accuracy, roc_auc, pr_auc) of rows y, pred, score; both areas are NULL with one class.

    Rows are first combined to one a score, and only these are ordered; their running sums
    are made range by range, so one key may have any number of scores.  A NULL score is the least.
    """
    hit = F.col("y") == positive
    g = rows.groupBy(*by, "score").agg(F.count_if(hit).alias("p"), F.count("*").alias("n"), F.count_if(F.col("y") == F.col("pred")).alias("same"))
    sums = running(g, by, "score", ["p", "n"])
    totals = g.groupBy(*by).agg(F.sum("p").alias("pos"), F.sum("n").alias("all"))
    t = matched(sums, totals, by)
    neg, below = F.col("all") - F.col("pos"), F.col("n_before") - F.col("p_before")
    roc = F.try_divide(F.sum(F.col("p") * (below + 0.5 * (F.col("n") - F.col("p")))), F.max(F.col("pos") * neg))
    # scores from the highest down: hits and rows so far, this score included
    hits, seen = F.col("pos") - F.col("p_before"), F.col("all") - F.col("n_before")
    ap = F.sum(F.try_divide(F.col("p").cast("double"), F.col("pos")) * (hits / seen))
    two = (F.max("pos") > 0) & (F.max(neg) > 0)
    return t.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum("same") / F.sum("n")).alias("accuracy"), F.when(two, roc).alias("roc_auc"), F.when(two, ap).alias("pr_auc"))


def regression_metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, mae, rmse, r2) of rows y, pred in one pass; r2 is NULL for a constant y."""
    e = F.col("y") - F.col("pred")
    n, ss = F.count("y"), F.var_pop("y")
    return rows.groupBy(*by).agg(n.alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.try_divide(F.avg(e * e), ss)).alias("r2"))


def run_summary(rows: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Runs, means and sample deviations by key (NULL keys kept); one run has no deviation."""
    stats = [f(c).alias(f"{c}_{n}") for c in values for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return rows.groupBy(*by).agg(F.count("*").alias("run_count"), *stats)


def hyperparameters_text(task: str) -> str:
    """The forest's parameters as JSON with sorted keys; classification has class weights."""
    return json.dumps(FOREST | ({"class_weight": "balanced"} if task == "classification" else {}), sort_keys=True)


def numeric_columns(df: DataFrame, but: tuple[str, ...] = ()) -> list[str]:
    """The columns of numbers, by the schema."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in but]


def forest_predictions(train: DataFrame, rows: DataFrame, id_: str, features: str, label: str, task: str = "classification", trees: int = FOREST["trees"], depth: int = FOREST["depth"]) -> DataFrame:
    """rows with y, pred and score of a random forest with balanced class weights (classification) fitted on train; labels of classes are 0, 1, ...

    ``id_`` is a key of both tables; what the forest draws goes by its hash.
    """
    row = [F.col(id_).alias("id"), F.xxhash64(id_).alias("hash"), F.col(label).cast("double").alias("y")]
    fitted = train.filter(F.col(label).isNotNull()).select(*row, F.lit(True).alias("train"), F.lit(False).alias("asked"), features)
    both = fitted.unionByName(rows.select(*row, F.lit(False).alias("train"), F.lit(True).alias("asked"), features))
    weights = None
    if task != "regression":
        sizes = {r.y: r["count"] for r in fitted.groupBy("y").count().collect()}
        if any(y < 0 or y != int(y) for y in sizes):
            raise ValueError("classes must be 0, 1, ...")
        weights = [sum(sizes.values()) / (len(sizes) * sizes[c]) if c in sizes else 0.0 for c in range(int(max([*sizes, 1])) + 1)]
    told = saved(forest_means(both, features, weights, trees, depth, float(FOREST["features"]), FOREST["seed"])).withColumnRenamed("id", "__id")
    out = rows.join(told, F.col(id_) == F.col("__id"))
    pred = F.get("means", 0) if weights is None else (F.array_position("means", F.array_max("means")) - 1).cast("double")
    score = F.get("means", 0 if weights is None else 1)
    return out.select(*rows.columns, F.col(label).cast("double").alias("y"), pred.alias("pred"), score.alias("score"))
