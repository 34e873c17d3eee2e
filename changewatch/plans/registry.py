"""All queries of the monitoring engine, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from changewatch.plans import log_queries  # noqa: F401  registers its queries
from changewatch.plans.queries import ORACLE, QUERIES

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
