"""Connected components of a link table, by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def components(links: DataFrame) -> DataFrame:
    """links(a, b) of comparable ids -> (id, component_id) for every id in a link, where
    component_id is the smallest id that links lead to.

    Each round every id points to its smallest neighbour or itself, pointers are followed four steps,
    and links are redrawn between what they point to; loops and repeats go. A local minimum takes
    in all its neighbours, so the ids still in links shrink by a factor each round. Counts and
    minima are partial aggregates; both sides of each join are written and the right one's keys are
    unique, so a centre with very many links is split like any skewed join.
    """
    edges = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct(), "links")
    pointers: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.select(F.col("b").alias("id"), F.col("a").alias("to")).unionByName(edges.select(F.col("a").alias("id"), F.col("a").alias("to")))
        # written before each join with itself: what many ids point to is then a plain scan on both sides,
        # which Spark can split; an aggregate straight under the join it could not
        point = written(both.groupBy("id").agg(F.min("to").alias("to")), "pointers")
        for _ in range(2):
            point = written(point.join(point.select(F.col("id").alias("to"), F.col("to").alias("next")), "to").select("id", F.col("next").alias("to")), "pointers")
        pointers.append(point)
        ends = edges.join(point.withColumnsRenamed({"id": "a", "to": "x"}), "a").join(point.withColumnsRenamed({"id": "b", "to": "y"}), "b")
        edges = written(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a != b").distinct(), "links")
    if not pointers:
        return edges.select(F.col("a").alias("id"), F.col("a").alias("component_id"))
    labels = pointers[-1]
    for earlier in reversed(pointers[:-1]):
        later = labels.select(F.col("id").alias("to"), F.col("to").alias("last"))
        labels = earlier.join(later, "to", "left").select("id", F.coalesce("last", "to").alias("to"))
    return labels.select("id", F.col("to").alias("component_id"))
