"""Named queries over a folder of tables, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Parquet tables of one folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    items: str
    run: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(items: str, sql: str | None = None):
    """Register a function of Tables under its name; items lists the SURVEY rows it covers."""
    def add(fn):
        if fn.__name__ in QUERIES:
            raise ValueError(f"query {fn.__name__} exists")
        QUERIES[fn.__name__] = Query(items, fn, sql)
        return fn

    return add


def r6(col: Column | str) -> Column:
    """Six decimals, no negative zero, so both engines print the same number."""
    x = F.round(F.col(col).cast("double") if isinstance(col, str) else col.cast("double"), 6)
    return F.when(x == 0, F.lit(0.0)).otherwise(x)


def R(expr: str, alias: str | None = None) -> str:
    """The same in SQL."""
    x = f"round(CAST({expr} AS DOUBLE), 6)"
    return f"CASE WHEN {x} = 0 THEN CAST(0 AS DOUBLE) ELSE {x} END" + (f" AS {alias}" if alias else "")


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in cols})
