"""Named queries over the star-schema tables, each with an independent SQL statement.

A query's SQL states the same result in plain SQL for a second engine; where an
algorithm has no SQL form there is none.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; braces around table names in its SQL are dropped."""
    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = plain(sql)
        return function
    return add


def plain(sql: str) -> str:
    """SQL with ``{table}`` written as ``table``."""
    return re.sub(r"\{(" + "|".join(TABLES) + r")\}", r"\1", sql).strip()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def prepared(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """Run input-preparing SQL whose tables are written as ``{table}``."""
    names = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{n: table(spark, folder, n) for n in names})
