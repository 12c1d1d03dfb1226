"""Registry of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mnemolake.plans.adapters import CTE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def with_tables(sql: str, tables: tuple[str, ...]) -> str:
    """``sql`` after the adapters' common table expressions; a leading comma goes on with its own."""
    if not tables:
        return sql
    return "WITH " + ", ".join(CTE[t] for t in tables) + " " + sql


def query(name: str, sql: str | None = None, *tables: str):
    """Register a query; ``tables`` name the adapters that its SQL reads."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = with_tables(sql, tables)
        return f

    return add
