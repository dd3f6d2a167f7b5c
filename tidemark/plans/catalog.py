"""Every query of the library with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import driver_queries, operator_queries, source_queries, state_queries

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return driver_queries.QUERIES | operator_queries.QUERIES | source_queries.QUERIES | state_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return driver_queries.ORACLE | operator_queries.ORACLE | source_queries.ORACLE | state_queries.ORACLE
