"""Queries over the test tables and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The test tables of one directory, read on first use."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self._directory = directory

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._directory}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a function of :class:`Tables` under ``name``, with its SQL where there is one."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, directory: fn(Tables(spark, directory))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
