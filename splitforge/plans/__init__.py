"""Registered queries of the splitting operators and their SQL."""

from .queries import QUERIES
from .sql import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]
