"""Registered queries: a Spark callable per key and, where SQL can say it, DuckDB text.

``register(key, sql)`` decorates a callable ``(spark, base) -> DataFrame``.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
GROUPS = ("reports", "texts", "names", "templates", "sentences", "learning", "charts", "jobs", "files")


def register(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"query key used twice: {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return keep


def cores(spark: SparkSession) -> int:
    """Partitions for the small logs of the workload, whose files give one task each."""
    return spark.sparkContext.defaultParallelism


def load() -> None:
    """Import every group once, which fills QUERIES and ORACLES."""
    for group in GROUPS:
        importlib.import_module(f"hourlens.workload.{group}")
