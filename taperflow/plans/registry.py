"""Queries by name with their oracle SQL (DuckDB)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def r6(c: str | Column, name: str | None = None) -> Column:
    """Rounded to six places, for comparison between engines."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6).alias(name or c)
