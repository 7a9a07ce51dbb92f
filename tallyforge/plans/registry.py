"""Registration of queries together with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers fn(spark, sf_dir) under ``name``; ``oracle`` may use the views of ``plans.views``."""

    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            from .views import expanded

            ORACLE_SQL[name] = expanded(oracle)
        return fn

    return add
