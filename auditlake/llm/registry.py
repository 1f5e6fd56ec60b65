"""Registry of the subpackage's queries, each with SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQLS: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable:
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``key``."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[key] = fn
        if sql:
            ORACLE_SQLS[key] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
