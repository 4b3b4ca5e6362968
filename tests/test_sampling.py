"""Prefix sums over tables beyond what Spark samples to cut ranges, with more columns than the sums need."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from quillon.operators import sampling as sa

ROWS = 150_000


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("wide") / "t")
    mixed = F.col("id") * 7_919 % ROWS
    spark.range(ROWS).select(mixed.alias("k"), (F.xxhash64("id") % 1000).alias("v"), F.abs(F.hash("id") % 5000).cast("long").alias("n"), F.md5(F.col("id").cast("string")).alias("more")).repartition(13).write.parquet(path)
    return spark.read.parquet(path)


def test_running_totals(wide):
    got = sa.running_totals(wide, key="k", value="v").toPandas().sort_values("k")
    assert set(got.columns) == {"k", "v", "n", "more", "before", "total"}
    v = got["v"].to_numpy()
    assert (got["before"].to_numpy() == np.cumsum(v) - v).all() and (got["total"] == v.sum()).all()


def test_indexed(wide):
    got = sa.indexed(wide, key="k").toPandas()
    assert (got["i"] == got["k"]).all() and len(got) == ROWS


def test_balanced_shards(wide):
    got = sa.balanced_shards(wide, group="k", length="n", shards=16).toPandas()
    got = got.sort_values(["workload", "k"], ascending=[False, True])
    i = np.arange(ROWS)
    assert (got["shard"].to_numpy() == np.where(i // 16 % 2 == 0, i % 16, 15 - i % 16)).all()


def test_resample(wide):
    n = 20_000
    got = sa.resample(wide, key="k", score="v", n=n).collect()
    assert len(got) == n and sorted(r.draw for r in got) == list(range(n))
    rows = sorted(wide.select("k", "v").collect())
    weight = np.cumsum([float(abs(r.v)) ** 2 + 1e-8 for r in rows])
    from quillon.operators.sequences import draw

    u = {r.draw: r.u for r in wide.sparkSession.range(n).select(F.col("id").alias("draw"), draw(42, F.col("id")).alias("u")).collect()}
    want = [rows[int(np.searchsorted(weight / weight[-1], u[r.draw], side="right"))].k for r in got]
    assert np.mean([a == r.k for a, r in zip(want, got)]) > 0.9999
    assert Counter(r.k for r in got).most_common(1)[0][1] < 20


def test_empty(wide):
    assert sa.running_totals(wide.limit(0), key="k", value="v").count() == 0
