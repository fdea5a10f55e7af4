"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import checks, exports, files, ledger, weather

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for part in (weather, checks, files, exports, ledger):
    QUERIES |= part.QUERIES
    SQL |= part.SQL
