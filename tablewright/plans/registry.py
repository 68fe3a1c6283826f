"""Names of all queries of the library and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
MODULES = ("cohort", "features", "events", "quality", "delta", "score", "gates", "repair", "sources")
FLAGSHIP = "features_wide"


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame, with its SQL if there is any."""

    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLE[name] = sql
        return function

    return add


def load() -> None:
    """Imports every module that registers queries."""
    from importlib import import_module

    for name in MODULES:
        import_module(f"tablewright.plans.{name}_queries")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    load()
    return ORACLE


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()[FLAGSHIP](spark, sf_dir)
