"""Registered queries: name, Spark job and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query by its function's name, with SQL for the same rows where there is any."""

    def add(job: Query) -> Query:
        QUERIES[job.__name__] = job
        if sql is not None:
            ORACLES[job.__name__] = sql
        return job

    return add
