"""Registered queries: each is a Spark function over the test tables with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Runner
    sql: str | None
    #: the order of the rows is part of the result
    ordered: bool = False


REGISTRY: dict[str, Query] = {}


class Tables:
    """The test tables of one folder: ``t.orders`` reads ``orders.parquet``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))


def query(name: str, sql: str | None = None, ordered: bool = False) -> Callable[[Callable[[Tables], DataFrame]], Callable]:
    """Register ``fn(tables)`` under ``name``."""

    def add(fn: Callable[[Tables], DataFrame]) -> Callable:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(lambda spark, folder: fn(Tables(spark, folder)), sql, ordered)
        return fn

    return add


def load_all() -> dict[str, Query]:
    from importlib import import_module

    for part in ("sources", "extract", "filters", "joins", "aggregates", "ordering", "scalars", "search",
                 "markdown", "incremental", "forms", "standing"):
        import_module(f"{__name__}.{part}")
    return REGISTRY
