"""Column expressions shared by the operators."""

from .columns import clean_text, extracted_text, metric_column, percent_text, safe_ratio, split_tag, sql_round

__all__ = ["clean_text", "extracted_text", "metric_column", "percent_text", "safe_ratio", "split_tag", "sql_round"]
