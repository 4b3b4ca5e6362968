"""Readers of the driver's tables, and a registry of queries with their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_path

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """`t.orders` is the table orders of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def shared_place(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    return new_path(spark, name)


class Area:
    """Queries of one area. `@area.query(sql)` registers a function of Tables under its name."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None, digits: int = 6, with_: str = ""):
        """`with_` holds common table expressions that the SQL uses. Doubles are rounded on both
        sides: the orders of summation differ."""

        def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            def run(spark: SparkSession, folder: str) -> DataFrame:
                df = f(Tables(spark, folder))
                doubles = [c for c, kind in df.dtypes if kind == "double"]
                return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in doubles}) if doubles else df

            self.queries[f.__name__] = run
            if sql:
                self.sql[f.__name__] = f"{with_} {_rounded(sql, digits)}"
            return f

        return add


def _rounded(sql: str, digits: int) -> str:
    """Columns that the SQL marks as `AS "name~"` are doubles to round."""
    marked = re.findall(r'"(\w+)~"', sql)
    if not marked:
        return sql
    for name in marked:
        sql = sql.replace(f'"{name}~"', name)
    return f"SELECT * REPLACE ({', '.join(f'round({n}, {digits}) + 0.0::DOUBLE AS {n}' for n in dict.fromkeys(marked))}) FROM ({sql})"
