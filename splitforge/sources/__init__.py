"""Readers and writers: labelled CSV, split files, run catalogs, distance caches."""

from .readers import file_signatures, input_signature, load_table, read_catalog, read_labelled, read_split_indices, read_summary, require_columns
from .writers import cached_pairs, read_cache, read_failures, read_json, write_cache, write_json, write_labelled, write_split_indices, write_splits

__all__ = [
    "cached_pairs",
    "file_signatures",
    "input_signature",
    "load_table",
    "read_cache",
    "read_catalog",
    "read_failures",
    "read_json",
    "read_labelled",
    "read_split_indices",
    "read_summary",
    "require_columns",
    "write_cache",
    "write_json",
    "write_labelled",
    "write_split_indices",
    "write_splits",
]
