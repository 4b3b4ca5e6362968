"""Group advantages and returns over sequence and token tables.

A sequence table has one row per rollout with its prompt group; a token table one row per rollout
and position. All take and return a DataFrame. Groups are windows or aggregates by their key;
recurrences are folds over one sequence's ordered array, parallel over sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import parts_for

EPS = 1e-6


def group_stats(df: DataFrame, *, group: str, score: str) -> DataFrame:
    """Mean, sample standard deviation and size of each group; a group of one has mean 0 and deviation 1."""
    n = F.count("*")
    return df.groupBy(group).agg(
        F.when(n > 1, F.avg(score)).otherwise(F.lit(0.0)).alias("mean"), F.when(n > 1, F.stddev_samp(score)).otherwise(F.lit(1.0)).alias("std"), n.alias("n"))


def _group(group: str):
    return Window.partitionBy(group)


def grpo(df: DataFrame, *, group: str, score: str, scaled: bool = True, out: str = "advantage") -> DataFrame:
    """(score - group mean) / (group deviation + eps), or the difference alone; a group of one keeps
    its score, divided by 1 + eps when scaled."""
    w, n = _group(group), F.count("*").over(_group(group))
    mean = F.when(n > 1, F.avg(score).over(w)).otherwise(0.0)
    std = F.when(n > 1, F.stddev_samp(score).over(w)).otherwise(1.0)
    gap = F.col(score) - mean
    return df.withColumn(out, gap / (std + EPS) if scaled else gap)


def grpo_floored(df: DataFrame, *, group: str, score: str, out: str = "advantage") -> DataFrame:
    """As `grpo`, with the variance floored at eps and groups of one at mean 0 and deviation 1."""
    w, n = _group(group), F.count("*").over(_group(group))
    mean = F.when(n > 1, F.avg(score).over(w)).otherwise(0.0)
    std = F.when(n > 1, F.sqrt(F.greatest(F.var_samp(score).over(w), F.lit(EPS)))).otherwise(1.0)
    return df.withColumn(out, (F.col(score) - mean) / (std + EPS))


def pass_at_k(df: DataFrame, *, group: str, score: str, tie: list[str], scaled: bool = True, out: str = "advantage") -> DataFrame:
    """The best row of a group gets its lead over the second, the others 0. A group of one raises."""
    order = Window.partitionBy(group).orderBy(F.desc(score), *tie)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = F.count("*").over(_group(group))
    lead = F.col(score) - F.nth_value(score, 2).over(whole)
    lead = lead / (F.stddev_samp(score).over(_group(group)) + EPS) if scaled else lead
    lead = F.when(n < 2, F.raise_error(F.lit("a group has a single row"))).otherwise(lead)
    return df.withColumn(out, F.when((F.row_number().over(order) == 1) | (n < 2), lead).otherwise(0.0))


def rloo(df: DataFrame, *, group: str, score: str, single_keeps: bool = True, out: str = "advantage") -> DataFrame:
    """Score minus the mean of the others: n / (n - 1) * (score - mean). A group of one keeps its score or gets 0."""
    w, n = _group(group), F.count("*").over(_group(group))
    alone = F.col(score) if single_keeps else F.lit(0.0)
    return df.withColumn(out, F.when(n > 1, n / (n - 1) * (F.col(score) - F.avg(score).over(w))).otherwise(alone))


def opo(df: DataFrame, *, group: str, score: str, length: str, out: str = "advantage") -> DataFrame:
    """Score minus the length-weighted group mean; a group of one has baseline 0."""
    w = _group(group)
    base = F.sum(F.col(length) * F.col(score)).over(w) / F.sum(length).over(w)
    return df.withColumn(out, F.col(score) - F.when(F.count("*").over(w) > 1, base).otherwise(0.0))


def gpg(df: DataFrame, *, group: str, score: str, norm: float = 1.0, out: str = "advantage") -> DataFrame:
    """alpha * (score - mean) / norm, alpha = rows / rows whose score is not zero; a group of one has mean 0."""
    w = _group(group)
    alpha = df.agg((F.count("*") / F.greatest(F.count_if(F.col(score) != 0), F.lit(1))).alias("alpha"))
    mean = F.when(F.count("*").over(w) > 1, F.avg(score).over(w)).otherwise(0.0)
    return df.crossJoin(F.broadcast(alpha)).withColumn(out, F.col("alpha") * (F.col(score) - mean) / norm).drop("alpha")


# ---- token tables --------------------------------------------------------------


def masked_stats(df: DataFrame, *, value: str, mask: str, by: list[str] | None = None) -> DataFrame:
    """Masked sum, mean (denominator + 1e-8) and unbiased variance; what is outside the mask counts
    for nothing, be it NaN. A group with a mask sum below 2 has no variance and raises."""
    inside = F.when(F.col(mask), F.col(value))
    n = F.count_if(mask)
    out = df.groupBy(*(by or [])).agg(F.sum(inside).alias("total"), n.alias("n"), F.avg(inside).alias("m"), F.var_pop(inside).alias("v"))
    mean = F.col("total") / (F.col("n") + 1e-8)
    spread = (F.col("v") + F.pow(F.col("m") - mean, 2)) * F.col("n") / (F.col("n") + 1e-8) * F.col("n") / (F.col("n") - 1)
    spread = F.when(F.col("n") < 2, F.raise_error(F.lit("the mask holds fewer than two values"))).otherwise(spread)
    return out.select(*(by or []), F.col("total").alias("masked_sum"), mean.alias("masked_mean"), spread.alias("masked_var"), "n")


def whiten(df: DataFrame, *, value: str, mask: str, shift_mean: bool = True, out: str = "whitened") -> DataFrame:
    """(value - masked mean) / sqrt(masked variance + 1e-8) over the whole table; the mean is added back if not shifted."""
    stats = masked_stats(df, value=value, mask=mask).select(F.col("masked_mean").alias("_m"), F.col("masked_var").alias("_v"))
    scaled = (F.col(value) - F.col("_m")) / F.sqrt(F.col("_v") + 1e-8)
    return df.crossJoin(F.broadcast(stats)).withColumn(out, scaled if shift_mean else scaled + F.col("_m")).drop("_m", "_v")


def reinforce_plus_plus_baseline(tokens: DataFrame, *, group: str, seq: str, score: str, mask: str, out: str = "advantage") -> DataFrame:
    """A sequence's score minus its group's mean, on its masked tokens, whitened over all of those.
    `score` is the same on all tokens of a sequence; a group of one has mean 0."""
    rows = tokens.groupBy(group, seq).agg(F.first(score).alias("_s"))
    mean = F.when(F.count("*").over(_group(group)) > 1, F.avg("_s").over(_group(group))).otherwise(0.0)
    centred = rows.withColumn("_c", F.col("_s") - mean).select(seq, "_c")
    spread = whiten(tokens.join(centred, seq), value="_c", mask=mask, out=out)
    return spread.withColumn(out, F.when(F.col(mask), F.col(out)).otherwise(0.0)).drop("_c")


def reward_to_go(tokens: DataFrame, *, seq: str, pos: str, reward: str, mask: str, baseline: str | None = None) -> DataFrame:
    """returns: sum of masked rewards from each token on; advantage: returns minus baseline inside the mask."""
    later = Window.partitionBy(seq).orderBy(F.desc(pos)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = tokens.withColumn("returns", F.sum(F.when(F.col(mask), F.col(reward)).otherwise(0.0)).over(later))
    base = F.when(F.col(mask), F.col(baseline)).otherwise(0.0) if baseline else F.lit(0.0)
    return out.withColumn("advantage", F.col("returns") - base)


def _folded(tokens: DataFrame, seq: str, pos: str, fields: dict[str, Column], start: Column, step: Callable, value: Callable) -> DataFrame:
    """Runs a recurrence backwards over each sequence. step(state, token) is the next state, which
    holds `pos`; value(state) names what is kept of it per token."""
    items = F.array_sort(F.collect_list(F.struct((-F.col(pos)).alias("_order"), F.col(pos).alias("pos"), *[c.alias(n) for n, c in fields.items()])))
    folded = tokens.groupBy(seq).agg(items.alias("_items"))
    empty = F.array().cast("array<struct<pos:bigint," + ",".join(f"{n}:double" for n in value.names) + ">>")
    run = F.aggregate("_items", F.struct(start.alias("state"), empty.alias("kept")), lambda acc, x: _advance(acc, x, step, value))
    return folded.select(seq, F.explode(run["kept"]).alias("k")).select(seq, F.col("k.pos").alias(pos), *[F.col(f"k.{n}").alias(n) for n in value.names])


def _advance(acc: Column, x: Column, step: Callable, value: Callable) -> Column:
    state = step(acc["state"], x)
    kept = F.struct(x["pos"].cast("long").alias("pos"), *[c.cast("double").alias(n) for n, c in value(state, x).items()])
    return F.struct(state.alias("state"), F.concat(acc["kept"], F.array(kept)).alias("kept"))


def _keeps(*names: str):
    def mark(f):
        f.names = names
        return f

    return mark


def discounted_returns(tokens: DataFrame, *, seq: str, pos: str, reward: Column, mask: Column, gamma: float) -> DataFrame:
    """R_t = r_t + gamma * m_(t+1) * R_(t+1): the running return restarts where the mask is 0."""
    @_keeps("returns")
    def value(state, x):
        return {"returns": state["r"]}

    def step(state, x):
        r = x["r"] + F.lit(gamma) * state["carry"]
        return F.struct(r.alias("r"), (r * x["m"]).alias("carry"))

    start = F.struct(F.lit(0.0).alias("r"), F.lit(0.0).alias("carry"))
    return _folded(tokens, seq, pos, {"r": reward.cast("double"), "m": mask.cast("double")}, start, step, value)


def gae(tokens: DataFrame, *, seq: str, pos: str, reward: Column, value: Column, mask: Column, gamma: float, lam: float) -> DataFrame:
    """Generalised advantage estimate: delta = r + gamma V' - V, L = delta + gamma lam L'. Tokens
    outside the mask pass V' and L' on unchanged. returns = L + V; whiten the advantages after."""
    @_keeps("raw_advantage", "returns")
    def kept(state, x):
        return {"raw_advantage": state["l"], "returns": state["l"] + x["v"]}

    def step(state, x):
        new = x["r"] + F.lit(gamma) * state["v"] - x["v"] + F.lit(gamma * lam) * state["l"]
        m = x["m"]
        return F.struct((m * x["v"] + (1 - m) * state["v"]).alias("v"), (m * new + (1 - m) * state["l"]).alias("l"))

    start = F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("l"))
    return _folded(tokens, seq, pos, {"r": reward.cast("double"), "v": value.cast("double"), "m": mask.cast("double")}, start, step, kept)


def optimal_token_baseline(tokens: DataFrame, *, group: str, seq: str, pos: str, reward: str, mask: str, weight: str, compact: bool = False, zero_tail: bool = True) -> DataFrame:
    """advantage = (return-to-go - B) on the mask, B = sum(G W) / (sum(W) + 1e-8) over the group at
    each position, W the running weight of the sequence. A group of one has B = 0. With `zero_tail`
    the one longest sequence of a group has B = 0 beyond the second longest. `compact` counts
    positions over masked tokens only, and sequences without any are left out."""
    inside = F.col(mask).cast("double")
    on = tokens.filter(mask) if compact else tokens
    parts = parts_for(tokens)
    on = on.repartition(parts, seq).withColumn("_at", F.row_number().over(Window.partitionBy(seq).orderBy(pos)))
    on = on.withColumn("returns", F.sum(F.col(reward) * inside).over(Window.partitionBy(seq).orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, 0)))
    on = on.withColumn("_w", F.sum(F.col(weight) * inside).over(Window.partitionBy(seq).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)) * inside)
    order = Window.partitionBy(group).orderBy(F.desc("_len"), seq)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    second = F.nth_value("_len", 2).over(whole)
    lengths = on.groupBy(group, seq).agg(F.count_if(mask).alias("_len")).repartition(parts, group)
    lengths = lengths.select(seq, F.count("*").over(_group(group)).alias("_n"), F.when((F.row_number().over(order) == 1) & (F.col("_len") > second), second).alias("_tail"))
    cell = Window.partitionBy(group, "_at")
    base = F.sum(F.col("returns") * F.col("_w")).over(cell) / (F.sum("_w").over(cell) + 1e-8)
    none = (F.col("_n") < 2) | ((F.col("_at") > F.col("_tail")) & F.lit(zero_tail))
    out = on.join(lengths.repartition(parts, seq), seq).repartition(parts, group, "_at").withColumn("baseline", F.when(none, 0.0).otherwise(base))
    return out.withColumn("advantage", (F.col("returns") - F.col("baseline")) * inside).drop("_w", "_n", "_at", "_tail")


# ---- registry -------------------------------------------------------------------

ADVANTAGES: dict[str, Callable[..., DataFrame]] = {}


def register_advantage(name: str):
    """Adds a DataFrame -> DataFrame advantage under a name; a name that is in use for another raises."""
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if ADVANTAGES.get(name, f) is not f:
            raise ValueError(f"{name} is registered already")
        ADVANTAGES[name] = f
        return f

    return add


for _name, _f in {"grpo": grpo, "grpo_vectorized": grpo_floored, "grpo_passk": pass_at_k, "rloo": rloo, "opo": opo, "gpg": gpg, "reinforce_plus_plus_baseline": reinforce_plus_plus_baseline,
                  "remax": reward_to_go, "reinforce_plus_plus": discounted_returns, "gae": gae, "optimal_token_baseline": optimal_token_baseline}.items():
    register_advantage(_name)(_f)


def advantage(name: str) -> Callable[..., DataFrame]:
    if name not in ADVANTAGES:
        raise ValueError(f"unknown advantage {name}; there are {', '.join(sorted(ADVANTAGES))}")
    return ADVANTAGES[name]
