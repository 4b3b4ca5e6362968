"""What must not grow faster than the input, or with it: frames, rows of a task, batches of Python."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from quillon.functions import scoring as sc
from quillon.operators import advantages as adv
from quillon.operators import evaluation as ev
from quillon.operators import joins as jo
from quillon.operators import retrieval as re_
from quillon.operators import sampling as sa
from quillon.sources import shared
from quillon.streaming import operators as st


@pytest.mark.parametrize("width", [None, 7.0])
def test_nearest_runs_no_window_to_the_end(spark, capsys, width):
    """A frame that ends with the partition is gone through anew for each row."""
    draw = np.random.default_rng(5)
    left = [(int(k), int(t), n) for n, (k, t) in enumerate(zip(draw.integers(0, 3, 400), draw.integers(0, 60, 400)))]
    right = [(int(k), int(t), int(v)) for k, t, v in zip(draw.integers(0, 3, 40), draw.integers(0, 60, 40), draw.integers(0, 9, 40))]
    df = jo.nearest(spark.createDataFrame(left, "k long, t long, n long"), spark.createDataFrame(right, "k long, u long, v long"), by=["k"], left_at="t", right_at="u", value="v", width=width)
    want = [(k, t, n, *(lambda b: (b[1], b[2]))(min((abs(u - t), u, v) for r, u, v in right if r == k))) for k, t, n in left]
    assert sorted(map(tuple, df.collect())) == sorted(want)
    df.explain()
    assert "unboundedfollowing" not in capsys.readouterr().out


def test_rows_beyond_the_budget_are_dealt_whole(spark):
    rows = spark.createDataFrame([(1, 25), (2, 5), (3, 4), (4, 3)], "k long, n long")
    got = sa.token_budget_shards(rows, key="k", length="n", budget=10, strict=False).collect()
    assert sorted((r.k, r.tokens) for r in got) == [(1, 25), (2, 5), (3, 4), (4, 3)] and {r.shard for r in got} == {0, 1, 2, 3}


def test_windows_are_dealt_by_rows(spark, monkeypatch):
    """As many partitions as rows need, whatever Spark's own number is."""
    monkeypatch.setattr(shared.parts_for, "__defaults__", (50,))
    rows = spark.range(1000).select((F.col("id") % 300).alias("g"), (F.col("id") % 7).cast("double").alias("x"))
    assert ev.best_and_worst(rows, keys=["g"], value="x", n=F.array(F.lit(2), F.lit(3))).rdd.getNumPartitions() == 20
    tokens = spark.range(1000).select(F.floor(F.col("id") / 40).alias("g"), F.floor(F.col("id") / 10).alias("s"), (F.col("id") % 10).alias("p"), F.lit(1.0).alias("r"), F.lit(True).alias("m"), F.lit(0.5).alias("w"))
    made = adv.optimal_token_baseline(tokens, group="g", seq="s", pos="p", reward="r", mask="m", weight="w")
    assert made.rdd.getNumPartitions() == 20 and made.count() == 1000


def test_assembly_in_pieces():
    """A key's rows of a micro-batch in any order and many frames; what waited comes first."""
    made = st._Assembly("k", 3, {f: f for f in st._Assembly.FIELDS}, "item")
    made.BATCHES = 2
    made.state = type("State", (), {"at": ([(0, 9.0, 1.0, 1.0, 3.0)], 4), "exists": lambda s: True, "get": lambda s: s.at, "update": lambda s, v: setattr(s, "at", v)})()
    order = np.random.default_rng(1).permutation(np.arange(1, 21))
    frames = [pd.DataFrame({"item": o, "seconds": o * 1.0, "tool_seconds": 0.5, "version_start": o % 2, "version_end": o % 3}) for o in np.array_split(order, 4)]
    got = list(made.handleInputRows(("a",), iter(frames), None))
    assert [len(g) for g in got] == [2, 2, 2, 1]
    every = pd.concat(got)
    assert [list(x) for x in every["items"]] == [[3 * k, 3 * k + 1, 3 * k + 2] for k in range(7)] and every["batch"].tolist() == list(range(4, 11))
    assert every.iloc[0][["processing_time_max", "max_partial_span", "version_diversity", "partial_num"]].tolist() == [9.0, 2, 3, 2]
    assert made.state.at == ([], 11)


def test_query_group_pairs_come_in_pieces():
    pivots = np.eye(64)
    run = re_._wanted(type("B", (), {"value": (pivots, np.ones(64), np.arange(64))}), None)
    batch = pa.RecordBatch.from_pydict({"query_id": list(range(500)), "v": [[1.0] * 64] * 500, "least": [None] * 500}, schema=pa.schema([("query_id", pa.int64()), ("v", pa.list_(pa.float64())), ("least", pa.float64())]))
    got = list(run([batch]))
    assert sum(b.num_rows for b in got) == 500 * 62 and max(b.num_rows for b in got) <= re_.ROWS


def test_list_scorers_get_bounded_batches(spark):
    f = sc.batch_score(lambda source, text, truth, extra: [float(len(text))] * len(text))
    rows = spark.range(3000, numPartitions=1).select(F.when(F.col("id") % 7 > 0, F.repeat(F.lit("x"), 9000)).alias("t"))
    got = [r.s for r in rows.select(f(F.lit(""), F.col("t"), F.lit(""), F.col("t")).alias("s")).collect()]
    assert len(got) == 3000 and max(got) * 9000 * 12 / 7 <= sc.SCORED_BYTES * 1.1
