"""Named queries and their SQL: what the driver reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame, with the DuckDB SQL that gives the same rows."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return put


def load() -> None:
    """Import every module of queries."""
    from threadlake.plans import aggregates, clusters, graphs, knowledge, more, relational, sequential, spoken, state, stores, texts, vectorstores  # noqa: F401
