"""Registered queries and their DuckDB equivalents."""

from . import more  # noqa: F401  registers its queries
from .queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
