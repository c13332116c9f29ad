"""Named queries over the given tables, each with the SQL that states its result."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_MODULES = ("text", "urls", "rules", "scoring", "history", "applications", "queues", "feeds", "sources", "streams")


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is left out where no plain SQL states the result."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_all() -> None:
    for module in _MODULES:
        importlib.import_module(f"{__package__}.{module}")
