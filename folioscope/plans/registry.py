"""Named queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscope.plans import package_queries, relational

_MODULES = (relational, package_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoke query: why candidates are excluded, by format."""
    return relational.exclusion_counts(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for module in _MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
