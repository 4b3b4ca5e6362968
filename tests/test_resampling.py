"""Majority votes against all draws counted one by one, and resamples against a plain loop."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from quillon.operators import evaluation as ev
from quillon.operators import resampling as rs


def first_most_frequent(draw):
    return max(dict.fromkeys(draw), key=lambda v: (draw.count(v), -draw.index(v)))


@pytest.mark.parametrize("counts", [(1,), (1, 1), (2, 1), (3, 1, 2), (1, 1, 1, 1), (1, 2, 2), (5, 1)])
def test_chances_are_those_of_all_draws(counts):
    items = [k for k, c in enumerate(counts) for _ in range(c)]
    for n in range(1, 6):
        wins = np.zeros(len(counts))
        for draw in itertools.product(items, repeat=n):
            wins[first_most_frequent(draw)] += 1
        assert np.allclose(rs.win_probabilities(counts, n), wins / wins.sum(), atol=1e-12)


def test_chances_of_many_votes():
    assert sum(rs.win_probabilities((1,) * 48, 48)) == pytest.approx(1) and sum(rs.win_probabilities((7, 90, 3), 300)) == pytest.approx(1)
    assert rs.win_probabilities((1,) * 48, 48)[5] == pytest.approx(1 / 48)


def test_majority_of_a_group(spark):
    votes = [("q", "a", 1.0), ("q", "a", 0.0), ("q", "b", 1.0), ("q", None, 4.0), ("r", "x", 2.0), ("s", "x", 1.0), ("s", "x", 3.0)]
    df = spark.createDataFrame(votes, "q string, vote string, x double")
    got = {(r.q, r.n): (r.maj_mean, r.maj_std) for r in rs.majority_at(df, keys=["q"], vote="vote", value="x", n=ev.ladder(F.col("size"))).collect()}
    assert set(got) == {("q", 2), ("q", 4), ("s", 2)}  # one sample has no ladder
    items = [(v, x) for q, v, x in votes if q == "q"]
    for n in (2, 4):
        won = []
        for draw in itertools.product(items, repeat=n):
            vote = first_most_frequent([v for v, _ in draw])
            won.append(next(x for v, x in draw if v == vote))
        assert got["q", n] == pytest.approx((np.mean(won), np.std(won)))
    assert got["s", 2] == pytest.approx((2.0, 1.0))


def test_majority_near_a_thousand_rounds(spark):
    draw = random.Random(4)
    items = [(draw.choice("abc"), draw.random()) for _ in range(9)]
    df = spark.createDataFrame([("q", v, x) for v, x in items], "q string, vote string, x double")
    got = rs.majority_at(df, keys=["q"], vote="vote", value="x", n=F.array(F.lit(5))).first()
    rounds = [[draw.choice(items) for _ in range(5)] for _ in range(20_000)]
    won = [next(x for v, x in r if v == first_most_frequent([v for v, _ in r])) for r in rounds]
    assert abs(got.maj_mean - np.mean(won)) < 0.01 and abs(got.maj_std - np.std(won)) < 0.01


def test_resampled_groups(spark):
    draw = random.Random(9)
    rows = [(k % 23, k, None if k % 11 == 0 else draw.random()) for k in range(200)] + [(99, 1, None)]
    df = spark.createDataFrame(rows, "q int, k int, x double")
    reducers = {"top": lambda x: x.max(axis=-1), "mid": lambda x: np.median(x, axis=-1)}
    for size, n_of in ((None, len), (F.lit(3), lambda v: 3)):
        got = {r.q: r for r in rs.resampled(df, keys=["q"], value="x", order=["k"], reducers=reducers, size=size, rounds=50, seed=7).collect()}
        assert 99 not in got and len(got) == 23
        for q, r in got.items():
            values = [x for g, _, x in rows if g == q and x is not None]
            n = n_of(values)
            seen = [[values[int.from_bytes(hashlib.md5(f"7:{k}:{j}".encode()).digest()[:4], "big") % len(values)] for j in range(1, n + 1)] for k in range(1, 51)]
            for name, f in (("top", max), ("mid", np.median)):
                each = [f(x) for x in seen]
                assert (r[f"{name}_mean"], r[f"{name}_std"]) == pytest.approx((np.mean(each), np.std(each)))
