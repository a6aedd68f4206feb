"""Registration of queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy access to the given tables: ``tables.lineitem`` reads ``lineitem.parquet``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def views(self):
        from wavelake.catalog.views import Views

        return Views(self)


def query(name: str, sql: str | None = None):
    """Registers a function from `Tables` to a DataFrame under ``name``, with its SQL twin where there is one."""

    def register(function: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: function(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def rounded(column: Column, digits: int = 6) -> Column:
    """Rounded for comparison; adding zero turns a negative zero into zero."""
    return F.round(column, digits) + F.lit(0.0)
