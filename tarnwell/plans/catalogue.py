"""Every query by name, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Registers a function of (t, spark), t being a reader of tables by name."""

    def add(fn):
        _QUERIES[name] = lambda spark, sf_dir: fn(lambda n: table(spark, sf_dir, n), spark)
        if sql:
            _SQL[name] = sql
        return fn

    return add


def _load() -> None:
    from . import queries_actions, queries_analysis, queries_charts, queries_clean, queries_language, queries_shapes  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
