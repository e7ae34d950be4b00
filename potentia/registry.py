"""The queries of the library's own operators, by the identifier of the operator that each applies."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

PLANS = ("sequence", "distribution", "outcomes", "relational", "scalar", "io")
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under an operator's identifier, with SQL that gives the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        if name in _queries:
            raise ValueError(f"{name} is registered twice")
        _queries[name] = f
        if sql is not None:
            _sql[name] = sql
        return f

    return add


def _load() -> None:
    for plan in PLANS:
        import_module(f"potentia.plans.{plan}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often paths have a significant drop, by model and correctness."""
    return queries()["AGG3"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
