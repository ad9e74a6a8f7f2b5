"""Registered queries with the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (
    "search", "scalars", "triage", "history", "anomalies", "duplicates", "rollups", "usage",
    "evaluation", "actions", "documents", "processing", "streams", "roundtrips",
)


def all_queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for name in MODULES:
        found |= import_module(f"registry.{name}").QUERIES
    return {key: _in_utc(query) for key, query in found.items()}


def all_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found |= import_module(f"registry.{name}").SQL
    return found


def _in_utc(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(spark, sf_dir)

    return run
