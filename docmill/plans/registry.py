"""The registered queries of the library's own operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: registers fn(spark, sf_dir) under name, with its DuckDB SQL where there is one."""

    def keep(fn):
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return keep


def _load() -> None:
    from docmill.plans import suites  # noqa: F401  (its modules register themselves)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return _QUERIES["c3_retrieve"](spark, sf_dir) if "c3_retrieve" in _QUERIES else next(iter(_QUERIES.values()))(spark, sf_dir)
