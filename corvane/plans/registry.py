"""Every registered query of the engine and its SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

MODULES = ("scalar", "retrieval", "maintenance", "evaluation", "sessions", "memory", "links", "chunking", "projection", "more", "ann")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _load() -> None:
    for m in MODULES:
        import_module(f"corvane.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval: both legs, fusion, gate and order."""
    _load()
    return QUERIES["j1_hybrid_fused"](spark, sf_dir)
