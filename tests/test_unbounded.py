"""Operators that once held a whole group or table in one task: percentiles, parameter matrices, short items, table functions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from quillon.functions import tables as tf
from quillon.operators import evaluation as ev
from quillon.operators import joins as jo
from quillon.operators import quality as qu


def test_exact_percentiles(spark):
    draw = random.Random(8)
    groups = {"many": [round(draw.gauss(0, 1), 3) for _ in range(20_000)], "same": [2.5] * 500, "two": [1.0, 2.0], "one": [7.0], "ties": [float(k % 3) for k in range(1000)]}
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("many", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(7)
    got = {r.g: r for r in ev.exact_percentiles(df, value="x", by=["g"], quantiles=[0.0, 0.5, 0.95, 0.99, 1.0], accuracy=200).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        assert list(got[g])[1:] == pytest.approx(np.percentile(xs, [0, 50, 95, 99, 100]).tolist(), rel=1e-12)
    whole = ev.time_statistics(df, value="x").first()
    every = [x for xs in groups.values() for x in xs]
    assert [whole.tp50, whole.tp95, whole.tp99] == pytest.approx(np.percentile(every, [50, 95, 99]).tolist())
    assert ev.time_statistics(df.filter("g = 'none'"), value="x", by=["g"]).first().tp50 is None
    assert ev.time_statistics(df.filter("g = 'none'"), value="x").first().tp50 is None


def test_percentiles_hold_no_group(spark):
    df = spark.range(20_000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7 % 10_007).cast("double").alias("x"))
    plan = ev.exact_percentiles(df, value="x", by=["g"], quantiles=[0.5])._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and "collect_" not in plan


def test_parameter_matrix(spark):
    a, b, c = (spark.createDataFrame(rows, kind).repartition(3) for rows, kind in (([(x,) for x in "yxz"], "a string"), ([(2, "k"), (1, "m"), (1, "l")], "b int, name string"), ([(0.5,), (0.25,)], "c double")))
    want = [(x, *y, z) for x, y, z in itertools.product("xyz", [(1, "l"), (1, "m"), (2, "k")], [0.25, 0.5])]
    whole = jo.parameter_matrix(a, b, c, order=["a", "b", "name", "c"])
    assert [tuple(r)[:4] for r in sorted(whole.collect(), key=lambda r: r.task_id)] == want
    assert sorted(r.task_id for r in whole.collect()) == list(range(1, 19))
    assert "CartesianProduct" not in (plan := whole._jdf.queryExecution().executedPlan().toString()) and "Window" not in plan and "NestedLoop" not in plan
    turns = sorted(jo.parameter_matrix(a, b, c, order=["a", "b", "name", "c"], quota=41).collect(), key=lambda r: r.task_id)
    assert [tuple(r)[:4] for r in turns] == [want[k % 18] for k in range(41)]
    assert jo.parameter_matrix(a, b.limit(0), order=["a", "b"]).count() == jo.parameter_matrix(a, b.limit(0), order=["a", "b"], quota=5).count() == 0


def test_short_items_in_every_text(spark, monkeypatch):
    draw = random.Random(5)
    texts = [(k, "".join(draw.choice("ab c") for _ in range(draw.randint(0, 30)))) for k in range(80)] + [(90, None), (91, "aé b"), (91, "b b")]
    items = [(k, "".join(draw.choice("ab c") for _ in range(draw.randint(0, 4)))) for k in range(60)] + [(70, "é"), (71, "é"), (72, None), (73, "")]
    d, i = spark.createDataFrame(texts, "doc int, _text string"), spark.createDataFrame(items, "item int, word string")
    want = sorted((a, b) for a, t in texts for b, w in items if t and w and w in t)
    for size in (8 << 20, 300):
        monkeypatch.setattr(qu, "AUTOMATON_BYTES", size)
        got = qu.containing(d, i, doc_id="doc", text="_text", item_id="item", item="word")
        assert sorted(map(tuple, got.collect())) == want
    assert qu.containing(d, i.filter("item > 71"), doc_id="doc", text="_text", item_id="item", item="word").count() == 0
    plan = qu.leaked_answers(d, i, doc_id="doc", doc_text="_text", item_id="item", item_text="word")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("NestedLoopJoin") <= 1  # the sizes of the items, at most n rows


def test_generators_from_sql(spark):
    class Pairs(tf.Generator):
        def __init__(self):
            self.last, self.n = None, 0

        def columns(self, table, gap=1):
            from pyspark.sql import types as T

            if "k" not in table.names:
                raise ValueError("no column k")
            return T.StructType([T.StructField("k", table["k"].dataType), T.StructField("what", T.StringType())])

        def rows(self, row, gap=1):
            self.n += 1
            if self.last is not None and row["k"] - self.last > gap:
                yield row["k"], "gap"
            self.last = row["k"]

        def end(self):
            yield self.n, "rows"

    tf.register_generator(spark, "find_gaps", Pairs)
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 9), ("a", 8)], "g string, k long").createOrReplaceTempView("steps")
    got = spark.sql("SELECT * FROM find_gaps(TABLE(steps) PARTITION BY g ORDER BY k, gap => 2)")
    assert got.dtypes == [("k", "bigint"), ("what", "string")]
    assert sorted(map(tuple, got.collect())) == [(2, "rows"), (3, "rows"), (8, "gap"), (9, "gap")]
    with pytest.raises(Exception, match="no column k"):
        spark.sql("SELECT * FROM find_gaps(TABLE(SELECT 1 AS x))").collect()


def test_scorers_from_sql(spark):
    tf.register_scorer(spark, "ratio", lambda a, b, times: times * a / b, ["a", "b"])
    got = spark.sql("SELECT * FROM ratio(TABLE(SELECT * FROM VALUES (1, 2, 'x'), (1, 0, 'y'), (NULL, 1, 'z') AS t(a, b, name)), times => 4)")
    assert sorted((r.name, r.score) for r in got.collect()) == [("x", 2.0), ("y", None), ("z", None)]
