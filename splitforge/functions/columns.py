from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGES = r"^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$"


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, _EDGES, "")


def clean_text(text: Column) -> Column:
    """Stripped text; NULL for blanks and for nan, none and null in any case."""
    t = _stripped(text)
    return F.when((t == "") | F.lower(t).isin("nan", "none", "null"), None).otherwise(t)


def extracted_text(text: Column) -> Column:
    """The laxer rule of key extraction: only blanks and the exact string nan are missing."""
    t = _stripped(text)
    return F.when((t == "") | (t == "nan"), None).otherwise(t)


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or NULL."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def split_tag(method: Column, prefix: str = "butina_") -> Column:
    """What follows the prefix in a method's name, else NULL."""
    return F.when(F.startswith(method, F.lit(prefix)), F.substring(method, len(prefix) + 1, 1 << 20))


def metric_column(split: str, metric: str) -> str:
    return f"{split}_{metric}_mean"


def percent_text(x: Column) -> Column:
    """Half-even percent with two decimals, as text; NULL stays NULL."""
    return F.when(x.isNotNull(), F.format_string("%.2f%%", F.bround(x * 100, 2)))


def sql_round(x: Column, digits: int = 4) -> Column:
    return F.round(x, digits)
