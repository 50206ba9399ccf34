"""The driver's queries for the cube operators, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name."""

    def add(func: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[func.__name__] = func
        if sql is not None:
            SQL[func.__name__] = sql
        return func

    return add


from cubeweave.plans import axes, cells, groups, more, texts, times  # noqa: E402,F401
