"""Registry of queries, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from auditlake.plans.views import Views, with_views


@dataclass(frozen=True)
class Query:
    key: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(key: str, sql: str | None = None) -> Callable:
    """Register ``fn(views) -> DataFrame`` under ``key``; ``sql`` may name any derived view."""

    def register(fn: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = Query(
            key=key,
            run=lambda spark, sf_dir: fn(Views(spark, sf_dir)),
            sql=with_views(sql) if sql else None,
        )
        return fn

    return register
