"""Unions, membership and distinctness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def concat(*frames: DataFrame) -> DataFrame:
    """All rows, columns by name; columns that some lack are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def meta_conflicts(meta: DataFrame, *, key: str, value: str) -> DataFrame:
    """Keys to which batches give more than one value."""
    return meta.groupBy(key).agg(F.count_distinct(value).alias("n_values")).filter("n_values > 1")


def append_filtered(base: DataFrame, generated: DataFrame, *, length: Column, limit: int) -> DataFrame:
    """Generated rows that pass the length filter, behind the base rows."""
    return base.unionByName(generated.filter(F.coalesce(length, F.lit(limit + 1)) <= limit))


def membership(answers: DataFrame, *, answer: Column, ids: Column) -> DataFrame:
    """missing, unknown and whether members repeat."""
    return answers.withColumns({"missing": F.array_except(ids, answer), "unknown": F.array_except(answer, ids), "repeated": F.size(answer) != F.size(F.array_distinct(answer))})


def first_seen(df: DataFrame, *, keys: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def all_distinct(items: Column) -> Column:
    """Whether no item of an array occurs twice; nulls count as items."""
    return F.size(F.array_distinct(items)) == F.size(items)
