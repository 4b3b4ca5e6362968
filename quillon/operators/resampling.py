"""Majority votes and user reducers over resamples of each group, without a row for any draw."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers that one step over groups of equal size holds at most, unless a single group needs more.
STEP = 4_000_000


# ---- majority votes -------------------------------------------------------------


@lru_cache(maxsize=256)
def _log_factorials(n: int) -> np.ndarray:
    return np.append(0.0, np.cumsum(np.log(np.arange(1, n + 1))))


def _choose(n: int) -> np.ndarray:
    """C(s + j, j) as a logarithm at [s, s + j], minus infinity below the diagonal."""
    log = _log_factorials(n)
    s, e = np.arange(n + 1)[:, None], np.arange(n + 1)[None, :]
    return np.where(e >= s, log[e] - log[s] - log[np.maximum(e - s, 0)], -np.inf)


@lru_cache(maxsize=100_000)
def win_probabilities(counts: tuple[int, ...], n: int) -> tuple[float, ...]:
    """Chance of each vote to win n draws with replacement, when counts[k] of all items have vote k: to be drawn
    most often, and, of votes drawn equally often, first.

    Votes are added one after the other. A state is how many draws they took and how many of them took m, the
    most; the vote in question meets what those before it and those after it leave. Equal numbers of
    draws make each of the tied votes the first with equal chance.
    """
    p = np.array(counts, dtype=np.float64) / sum(counts)
    choose, log = _choose(n), _log_factorials(n)
    drawn = np.arange(n + 1)[None, :] - np.arange(n + 1)[:, None]
    steps = [np.where(drawn >= 0, np.exp(choose + np.maximum(drawn, 0) * np.log(x)), 0.0) for x in p]
    wins = np.zeros(len(p))
    for m in range(1, n + 1):
        most = min(n // m, len(p))  # votes that can have m draws each
        if m * len(p) < n:
            continue  # then some vote has more

        def add(state: np.ndarray, step: np.ndarray, m: int = m) -> np.ndarray:
            out = state @ np.where(drawn < m, step, 0.0)
            out[1:] += (state @ np.where(drawn == m, step, 0.0))[:-1]
            return out

        start = np.zeros((most + 1, n + 1))
        start[0, 0] = 1.0
        after = [start]
        for step in reversed(steps[1:]):
            after.append(add(after[-1], step))
        before, rest = start, n - m
        ways = np.exp(log[rest] - log[: rest + 1] - log[rest::-1])
        share = 1 / (1 + np.arange(most + 1)[:, None] + np.arange(most + 1)[None, :])
        for k, later in enumerate(reversed(after)):
            meet = (before[:, : rest + 1] * ways) @ later[:, rest::-1].T
            wins[k] += np.exp(log[n] - log[m] - log[rest] + m * np.log(p[k])) * (meet * share).sum()
            before = add(before, steps[k])
    return tuple(wins.tolist())


def _chances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, sizes = batch.column("counts").to_pylist(), batch.column("ns").to_pylist()
        rows = [(c, s, n, win_probabilities(tuple(c), n)) for c, s in zip(counts, sizes) for n in s]
        kinds = [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["counts", "ns", "n", "chances"])


def majority_at(samples: DataFrame, *, keys: list[str], vote: str, value: str, n: Column) -> DataFrame:
    """(keys, n, maj_mean, maj_std): mean and population deviation of the value that majority voting takes from n
    draws with replacement out of a group, where that is the first drawn under the most frequent vote and, of equally
    frequent votes, the one drawn first counts. `n` is an array, in terms of a group's `size`.

    Exact, what more and more rounds of resampling tend to: a vote wins with a chance that depends only on how many
    items have which vote, and the first drawn of its items is any of them alike. Chances are worked out once for
    all groups with equal counts. A null vote is a vote, null values count in no mean, and groups of any size come in
    as one row per vote; a group has as many numbers in one row as it has different votes.
    """
    x = F.col(value)
    per_vote = samples.groupBy(*keys, vote).agg(F.count("*").alias("_count"), F.avg(x).alias("_mean"), F.avg(x * x).alias("_square"))
    # equal counts make one profile, whatever the votes are called
    rows = per_vote.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_count", "_mean", "_square"))).alias("_votes"), F.sum("_count").alias("size"))
    rows = rows.select(*keys, "_votes", n.alias("ns"), F.col("_votes._count").alias("counts")).filter(F.size("ns") > 0)
    chances = rows.select("counts", "ns").distinct().mapInArrow(_chances, "counts array<bigint>, ns array<int>, n long, chances array<double>")
    both = rows.join(chances, ["counts", "ns"])
    mean = lambda f: F.aggregate(F.zip_with("_votes", "chances", lambda v, p: p * v[f]), F.lit(0.0), lambda a, b: a + F.coalesce(b, F.lit(0.0)))
    both = both.select(*keys, "n", mean("_mean").alias("maj_mean"), mean("_square").alias("_q"))
    return both.select(*keys, "n", "maj_mean", F.sqrt(F.greatest(F.col("_q") - F.col("maj_mean") * F.col("maj_mean"), F.lit(0.0))).alias("maj_std"))


# ---- any reducer ----------------------------------------------------------------


@lru_cache(maxsize=64)
def drawn_places(size: int, n: int, rounds: int, seed: int) -> np.ndarray:
    """rounds x n places below `size`: md5 numbers of seed, round and draw. Groups of one size share them."""
    first = [int.from_bytes(hashlib.md5(f"{seed}:{r}:{j}".encode()).digest()[:4], "big") for r in range(1, rounds + 1) for j in range(1, n + 1)]
    return (np.array(first, dtype=np.int64) % size).reshape(rounds, n)


def _resampled(reducers: dict[str, Callable[[np.ndarray], np.ndarray]], keys: list[str], rounds: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, ns = batch.column("_values"), np.asarray(batch.column("_n"))
            sizes = np.asarray(values.value_lengths())
            start = np.cumsum(sizes) - sizes
            flat = np.asarray(values.flatten(), dtype=np.float64)
            out = {f"{name}_{what}": np.full(batch.num_rows, np.nan) for name in reducers for what in ("mean", "std")}
            for size, n in sorted(set(zip(sizes.tolist(), ns.tolist()))):
                rows = np.flatnonzero((sizes == size) & (ns == n))
                places = drawn_places(size, n, rounds, seed)
                step = max(1, STEP // places.size)
                for at in range(0, len(rows), step):
                    some = rows[at : at + step]
                    drawn = flat[start[some][:, None] + np.arange(size)][:, places]  # groups x rounds x n
                    for name, f in reducers.items():
                        got = np.asarray(f(drawn), dtype=np.float64)
                        out[f"{name}_mean"][some], out[f"{name}_std"][some] = got.mean(axis=1), got.std(axis=1)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], *[pa.array(x) for x in out.values()]], names=[*keys, *out])

    return run


def resampled(values: DataFrame, *, keys: list[str], value: str, order: list[str], reducers: dict[str, Callable[[np.ndarray], np.ndarray]], size: Column | None = None, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """For each group and reducer its mean and population deviation over `rounds` resamples of `size` draws with
    replacement (an aggregate; the group's own size if none is given). A reducer takes an array whose last axis is
    the draws and gives one number for each of the others, like `lambda x: x.max(axis=-1)`.

    Groups are the samples of one prompt: a group's values are one row, and all draws are made inside it. Null
    values are left out; a group without values, or of no draw, gives no row. Rows of equal order are ordered by value.
    """
    own = F.sort_array(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(*order, F.col(value).cast("double").alias("_v"))))).getField("_v")
    rows = values.groupBy(*keys).agg(own.alias("_values"), (F.count(value) if size is None else size).cast("int").alias("_n"))
    rows = rows.filter("size(_values) > 0 and _n > 0")
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keys], *[f"{name}_{what} double" for name in reducers for what in ("mean", "std")]])
    return rows.mapInArrow(_resampled(reducers, keys, rounds, seed), schema)
