"""Registration of the catalogued queries."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from casario.session import configure

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; ``sql`` is its counterpart where SQL can express it."""

    def register(fn: Query) -> Query:
        @wraps(fn)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(configure(spark), folder)

        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql
        return run

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def sql() -> dict[str, str]:
    return dict(_SQL)
