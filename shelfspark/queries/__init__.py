"""Registered queries: name -> (spark, folder) -> DataFrame, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def load() -> None:
    from shelfspark.queries import (  # noqa: F401
        aggregates,
        catalog,
        features,
        interactions,
        metrics,
        recommend,
        retrieval,
        sources,
        streams,
        writes,
    )
