"""Queries over the driver's tables, with the same rows in SQL."""

from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
