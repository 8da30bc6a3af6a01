"""Registry and table access for the query catalog."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


# Schemas of tables read before, as a metastore would keep them.
_SCHEMAS: dict[str, StructType] = {}


class Tables:
    """The test tables of one scale as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}.parquet"
        if path not in _SCHEMAS:
            _SCHEMAS[path] = self.spark.read.parquet(path).schema
        table = self.spark.read.schema(_SCHEMAS[path]).parquet(path)
        setattr(self, name, table)
        return table


def query(name: str, sql: str | None = None):
    """Register a function of :class:`Tables` under a name, with its SQL where there is one."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Round columns on which the order of additions shows."""
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


def joined(column: str):
    """A path as text, for comparison."""
    return F.array_join(column, "/")
