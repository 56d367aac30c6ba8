"""What depends on the kind of a dataset or its task: duplicate policies, targets, metrics, result rows."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metric_column
from . import dedup as D

# Fixed names: the metrics that are compared for a task, the splits they must be known of, and the kinds of known datasets.
METRICS = {"classification": ("roc_auc", "pr_auc"), "regression": ("mae", "rmse")}
COMPARED = ("val", "test")
KINDS = {"bbbp": "classification", "freesolv": "regression", "hiv": "classification", "lipophilicity": "regression", "qm9_smiles": "text_only", "solv": "regression", "tox21": "multitask"}


def resolve_duplicates(df: DataFrame, kind: str, key: str, idx: str, labels: list[str]) -> DataFrame:
    """One row a key by the policy of the kind: text_only, regression, classification or multitask."""
    if kind == "text_only":
        return D.keep_first(df, key, idx)
    policies = {"regression": D.mean_labels, "classification": D.drop_conflicts, "multitask": D.merge_tasks}
    if kind not in policies:
        raise ValueError(f"unknown kind of dataset: {kind}")
    return policies[kind](df, key, idx, labels)


def target(value: Column, task: str) -> Column:
    """The label as a number, cut to an integer for classification; what is no number, or missing, is an error when read."""
    if task not in METRICS:
        raise ValueError(f"unknown task: {task}")
    number = F.coalesce(value.try_cast("double"), F.raise_error(F.lit("target is missing or no number")).cast("double"))
    return number.cast("int") if task == "classification" else number


def dataset_kind(name: str, kinds: dict[str, str] = KINDS) -> str:
    """The kind of a dataset by its name or file name; an unknown one is an error."""
    stem = name.rsplit("/", 1)[-1].removesuffix(".gz").removesuffix(".csv")
    if stem not in kinds:
        raise ValueError(f"kind of dataset {stem} is not known; known are {', '.join(sorted(kinds))}")
    return kinds[stem]


def choices(wanted: list[str] | None, known: list[str], what: str = "values") -> list[str]:
    """What is wanted, or all that is known where nothing is; unknown names are an error."""
    if unknown := sorted(set(wanted or []) - set(known)):
        raise ValueError(f"unknown {what}: {', '.join(unknown)}")
    return list(wanted or known)


def metrics_for(task: str, columns: list[str]) -> list[str]:
    """The task's metrics whose means the columns have for both compared splits; the others are warned of, none left is an error."""
    if task not in METRICS:
        raise ValueError(f"unknown task: {task}")
    lacking = {m: [c for s in COMPARED if (c := metric_column(s, m)) not in columns] for m in METRICS[task]}
    for m, absent in lacking.items():
        if absent:
            warnings.warn(f"{task} metric {m} is left out: no column {', '.join(absent)}", stacklevel=2)
    if all(lacking.values()):
        raise ValueError(f"no {task} metrics among the columns")
    return [m for m, absent in lacking.items() if not absent]


def summary_long(wide: DataFrame, keys: list[str], task: str, splits: tuple[str, ...] = ("train", "val", "test"), stats: tuple[str, ...] = ("mean", "std")) -> DataFrame:
    """(keys, split, metric, stat, value) from columns <split>_<metric>_<stat>, for the metrics of the task that can be compared."""
    named = [(s, m, t, c) for s in splits for m in metrics_for(task, wide.columns) for t in stats if (c := f"{s}_{m}_{t}") in wide.columns]
    long = wide.unpivot(keys, [F.col(c).cast("double").alias(c) for *_, c in named], "name", "value")
    part = lambda k: F.create_map(*[F.lit(x) for row in named for x in (row[3], row[k])])[F.col("name")]
    return long.select(*keys, part(0).alias("split"), part(1).alias("metric"), part(2).alias("stat"), "value")


def task_types(rows: DataFrame, dataset: str, task: str) -> DataFrame:
    """(dataset, task): each dataset's one task; one with none or several is an error when read."""
    found = rows.groupBy(dataset).agg(F.min(task).alias("__least"), F.max(task).alias("__most"))
    message = F.concat(F.lit("not exactly one task: "), F.col(dataset).cast("string"))
    one = F.when(F.col("__least") == F.col("__most"), F.col("__least")).otherwise(F.raise_error(F.coalesce(message, F.lit("dataset without a name"))).cast("string"))
    return found.select(dataset, one.alias(task))


def random_pair(ids: DataFrame, id_: str) -> DataFrame:
    """(i, j), i < j: two distinct ids, other ones each time; no row where there are fewer."""
    two = ids.select(id_).distinct().orderBy(F.rand()).limit(2)
    return two.agg(F.min(id_).alias("i"), F.max(id_).alias("j")).filter("i < j")


def result_rows(metrics: DataFrame, by: list[str], names: list[str], splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """(by, <split>_<metric> ...): one row a run from metrics (by, split, names); what a split lacks is NULL."""
    cells = [F.max(F.when(F.col("split") == s, F.col(m))).alias(f"{s}_{m}") for s in splits for m in names]
    return metrics.groupBy(*by).agg(*cells)
