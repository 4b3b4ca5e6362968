"""Off-policy diagnostics, importance weights, rejection masks and objective values over token tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.answers import let, spare

CLAMP = 20.0


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def kl_estimate(lp: Column, ref: Column, kind: str) -> Column:
    """Per-token estimates of the divergence: k1 the difference, abs, k2 half its square, k3 e^d - d - 1 clamped to 10."""
    d = clamp(ref - lp, -CLAMP, CLAMP)
    kinds = {"k1": lp - ref, "abs": F.abs(lp - ref), "k2": F.pow(lp - ref, 2) / 2, "k3": clamp(F.exp(d) - d - 1, -10.0, 10.0)}
    if kind not in kinds:
        raise ValueError(f"unknown estimate {kind}; there are {', '.join(kinds)}")
    return kinds[kind]


def kl_penalised(tokens: DataFrame, *, seq: str, reward: str, lp: str, ref: str, mask: str, beta: float, kind: str = "k1") -> tuple[DataFrame, DataFrame]:
    """(tokens with `kl` and `penalised` = reward - beta kl on the mask, one row with the mean over sequences of the masked mean KL)."""
    kl = F.when(F.col(mask), kl_estimate(F.col(lp), F.col(ref), kind)).otherwise(0.0)
    out = tokens.withColumn("kl", kl).withColumn("penalised", F.col(reward) - F.lit(beta) * F.col("kl"))
    per = out.groupBy(seq).agg((F.sum("kl") / (F.count_if(mask) + 1e-8)).alias("m"))
    return out, per.agg(F.avg("m").alias("current_kl"))


def offpolicy_metrics(tokens: DataFrame, *, seq: str, lp: str, rollout_lp: str, mask: str) -> DataFrame:
    """One row: perplexities of training and rollout policy, their logs' difference, KL and k3
    estimates, and chi-squared on tokens and on sequences. Sequences without masked tokens count in none."""
    on = tokens.filter(mask)
    r = F.col(lp) - F.col(rollout_lp)
    seqs = on.groupBy(seq).agg(F.avg(lp).alias("a"), F.avg(rollout_lp).alias("b"), F.sum(r).alias("s"), F.count("*").alias("n"), F.sum(-r).alias("kl"),
                               F.sum(F.exp(r) - r - 1).alias("k3"), F.sum(F.exp(2 * clamp(r, -CLAMP, CLAMP))).alias("chi"))
    gap = F.col("b") - F.col("a")
    return seqs.agg(
        F.avg(F.exp(-F.col("a"))).alias("training_ppl"), F.avg(-F.col("a")).alias("training_log_ppl"), F.avg(F.exp(-F.col("b"))).alias("rollout_ppl"), F.avg(-F.col("b")).alias("rollout_log_ppl"),
        (F.sum("kl") / F.sum("n")).alias("kl"), (F.sum("k3") / F.sum("n")).alias("k3_kl"), F.avg(gap).alias("log_ppl_diff"), F.avg(F.abs(gap)).alias("log_ppl_abs_diff"),
        F.max(gap).alias("log_ppl_diff_max"), F.min(gap).alias("log_ppl_diff_min"), F.avg(F.exp(gap)).alias("ppl_ratio"),
        (F.sum("chi") / F.sum("n") - 1).alias("chi2_token"), (F.avg(F.exp(2 * clamp(F.col("s"), -CLAMP, CLAMP))) - 1).alias("chi2_seq"))


def log_ratio(tokens: DataFrame, *, seq: str, lp: str, rollout_lp: str, mask: str, level: str) -> Column:
    """Clamped log ratio of the policies per token, summed over the sequence, or its masked mean."""
    r = F.when(F.col(mask), F.col(lp) - F.col(rollout_lp))
    w = Window.partitionBy(seq)
    forms = {"token": F.col(lp) - F.col(rollout_lp), "sequence": F.sum(r).over(w), "geometric": F.avg(r).over(w)}
    if level not in forms:
        raise ValueError(f"unknown level {level}; there are {', '.join(forms)}")
    return clamp(F.coalesce(forms[level], F.lit(0.0)), -CLAMP, CLAMP)


def importance_weights(tokens: DataFrame, *, seq: str, lp: str, rollout_lp: str, mask: str, level: str = "token", threshold: float = 2.0, normalise: bool = False) -> DataFrame:
    """`weight` = min(e^ratio, threshold) on the mask, 0 outside; `raw_weight` is before truncation.
    Normalised weights have mean 1 over tokens, or over sequences for the sequence level."""
    raw = F.when(F.col(mask), F.exp(log_ratio(tokens, seq=seq, lp=lp, rollout_lp=rollout_lp, mask=mask, level=level))).otherwise(0.0)
    out = tokens.withColumn("raw_weight", raw).withColumn("weight", F.least("raw_weight", F.lit(threshold)))
    if normalise:
        grain = out.filter(mask) if level == "token" else out.filter(mask).groupBy(seq).agg(F.avg("weight").alias("weight"))
        mean = grain.agg(F.avg("weight").alias("_mean"))
        out = out.crossJoin(F.broadcast(mean)).withColumn("weight", F.when(F.col("_mean") > 1e-8, F.col("weight") / F.col("_mean")).otherwise(F.col("weight"))).drop("_mean")
    return out


def weight_metrics(tokens: DataFrame, *, seq: str, weight: str, mask: str, threshold: float = 2.0) -> DataFrame:
    """One row: mean, max, min, share above the threshold and below its inverse, deviation and
    effective sample size of weights clamped to that range, and the same extremes of sequence means."""
    on = tokens.filter(mask)
    c = clamp(F.col(weight), 1 / threshold, threshold)
    token = on.agg(F.avg(weight).alias("mean"), F.max(weight).alias("max"), F.min(weight).alias("min"), F.avg((F.col(weight) > threshold).cast("double")).alias("fraction_high"),
                   F.avg((F.col(weight) < 1 / threshold).cast("double")).alias("fraction_low"), F.avg(c).alias("_c"), F.avg(c * c).alias("_c2"))
    token = token.withColumns({"std": F.sqrt(F.greatest(F.col("_c2") - F.col("_c") * F.col("_c"), F.lit(0.0))), "ess": F.pow(F.col("_c") + 1e-8, 2) / F.col("_c2")}).drop("_c", "_c2")
    rows = on.groupBy(seq).agg(F.avg(weight).alias("m")).agg(F.avg("m").alias("seq_mean"), F.stddev_samp("m").alias("seq_std"), F.max("m").alias("seq_max"), F.min("m").alias("seq_min"))
    return token.crossJoin(rows)


def rejection_mask(tokens: DataFrame, *, seq: str, lp: str, rollout_lp: str, mask: str, level: str = "token", upper: float = 2.0, lower: float | None = None, veto: float | None = None) -> DataFrame:
    """`keep`: the mask where e^ratio lies in [lower, upper], lower being 1/upper if not given. A
    sequence with a masked token whose ratio is below `veto` is dropped whole."""
    w = F.exp(log_ratio(tokens, seq=seq, lp=lp, rollout_lp=rollout_lp, mask=mask, level=level))
    keep = F.col(mask) & w.between(1 / upper if lower is None else lower, upper)
    if veto is not None:
        bad = F.bool_or(F.col(mask) & ((F.col(lp) - F.col(rollout_lp)) < F.log(F.lit(veto)))).over(Window.partitionBy(seq))
        keep = keep & ~bad
    return tokens.withColumn("keep", keep)


def aggregate_loss(tokens: DataFrame, *, seq: str, loss: Column, mask: str, mode: str, horizon: int | None = None) -> DataFrame:
    """One row, `loss`: token-mean, seq-mean-token-sum, seq-mean-token-mean or seq-mean-token-sum-norm
    (divided by `horizon`). Sequences without masked tokens count in no mean."""
    per = tokens.groupBy(seq).agg(F.sum(F.when(F.col(mask), loss)).alias("s"), F.count_if(mask).alias("n"))
    on = F.col("n") > 0
    forms = {
        "token-mean": F.sum("s") / (F.sum("n") + 1e-8),
        "seq-mean-token-sum": F.sum(F.when(on, F.col("s"))) / (F.count_if(on) + 1e-8),
        "seq-mean-token-mean": F.sum(F.when(on, F.col("s") / (F.col("n") + 1e-8))) / (F.count_if(on) + 1e-8),
        "seq-mean-token-sum-norm": F.sum(F.when(on, F.col("s"))) / F.lit(float(horizon or 1))}
    if mode not in forms:
        raise ValueError(f"unknown mode {mode}; there are {', '.join(forms)}")
    return per.agg(forms[mode].alias("loss"))


# ---- objective values ------------------------------------------------------------

Objective = Callable[[DataFrame, dict[str, str], float], Column]
OBJECTIVES: dict[str, Objective] = {}


def register_objective(name: str):
    """A later function under a name replaces the earlier."""
    def add(f: Objective) -> Objective:
        OBJECTIVES[name] = f
        return f

    return add


def _ratio(c: dict[str, str]) -> Column:
    return F.exp(clamp(F.col(c["lp"]) - F.col(c["old"]), -CLAMP, CLAMP))


def _sequence_mean(c: dict[str, str], x: Column) -> Column:
    return F.avg(F.when(F.col(c["mask"]), x)).over(Window.partitionBy(c["seq"]))


@register_objective("vanilla")
def _vanilla(df: DataFrame, c: dict[str, str], clip: float, dual: float = 3.0) -> Column:
    """Clipped ratio loss; for negative advantages no more than `dual` times the advantage."""
    a, r = F.col(c["adv"]), _ratio(c)
    loss = F.greatest(-a * r, -a * clamp(r, 1 - clip, 1 + clip))
    return F.when(a < 0, F.least(loss, -a * dual)).otherwise(loss)


@register_objective("gspo")
def _gspo(df: DataFrame, c: dict[str, str], clip: float) -> Column:
    """The same with one ratio per sequence, e to the mean log ratio."""
    a, r = F.col(c["adv"]), F.exp(clamp(_sequence_mean(c, F.col(c["lp"]) - F.col(c["old"])), -CLAMP, 10.0))
    return F.greatest(-a * r, -a * clamp(r, 1 - clip, 1 + clip))


@register_objective("sapo")
def _sapo(df: DataFrame, c: dict[str, str], clip: float, tau_pos: float = 1.0, tau_neg: float = 1.05) -> Column:
    """A soft gate instead of the clip: sigmoid(tau (ratio - 1)) * 4 / tau."""
    a, r = F.col(c["adv"]), _ratio(c)
    tau = F.when(a > 0, tau_pos).otherwise(tau_neg)
    return -a * (1 / (1 + F.exp(-tau * (r - 1)))) * 4 / tau


@register_objective("gpg")
def _gpg(df: DataFrame, c: dict[str, str], clip: float) -> Column:
    return -F.col(c["lp"]) * F.col(c["adv"])


@register_objective("cispo")
def _cispo(df: DataFrame, c: dict[str, str], clip: float) -> Column:
    return -clamp(_ratio(c), 1 - clip, 1 + clip) * F.col(c["adv"]) * F.col(c["lp"])


@register_objective("geo_mean")
def _geo_mean(df: DataFrame, c: dict[str, str], clip: float) -> Column:
    """One ratio per sequence from log ratios clipped on the side that the advantage rewards."""
    sign = F.signum(F.col(c["adv"]))
    r = (F.col(c["lp"]) - F.col(c["old"])) * sign
    kept = sign * F.least(r, clamp(r, -clip, clip))
    return -F.col(c["adv"]) * F.exp(_sequence_mean(c, kept))


@register_objective("reinforce")
def _reinforce(df: DataFrame, c: dict[str, str], clip: float) -> Column:
    return -F.col(c["adv"]) * F.col(c["lp"])


def objective(name: str) -> Objective:
    if name not in OBJECTIVES:
        raise ValueError(f"unknown objective {name}; there are {', '.join(sorted(OBJECTIVES))}")
    return OBJECTIVES[name]


def objective_value(tokens: DataFrame, *, name: str, seq: str, lp: str, old: str, adv: str, mask: str, clip: float = 0.2, mode: str = "token-mean") -> DataFrame:
    """One row: the objective's value, the share of masked tokens whose ratio the clip moves, and the mean -log ratio."""
    c = {"seq": seq, "lp": lp, "old": old, "adv": adv, "mask": mask}
    valued = tokens.withColumn("_loss", objective(name)(tokens, c, clip))
    r, a = _ratio(c), F.col(adv)
    bound = (-a * clamp(r, 1 - clip, 1 + clip)) > (-a * r)
    extra = tokens.filter(mask).agg(F.avg(bound.cast("double")).alias("clip_fraction"), F.avg(F.col(old) - F.col(lp)).alias("approx_kl"))
    return aggregate_loss(valued, seq=seq, loss=F.col("_loss"), mask=mask, mode=mode).crossJoin(extra)


def value_loss(tokens: DataFrame, *, seq: str, value: str, old_value: str, returns: str, mask: str, clip: float = 0.5, mode: str = "token-mean") -> DataFrame:
    """Half the larger squared error of the value and of the value clipped about the old one."""
    v, o, g = F.col(value), F.col(old_value), F.col(returns)
    clipped = F.greatest(F.least(v, o + clip), o - clip)
    loss = F.greatest(F.pow(v - g, 2), F.pow(clipped - g, 2)) / 2
    return aggregate_loss(tokens, seq=seq, loss=loss, mask=mask, mode=mode)


def variance_proxies(tokens: DataFrame, *, seq: str, lp: str, sum_pi_squared: str, advantage: str, mask: str, weight: str | None = None, grad_norm: float | None = None) -> DataFrame:
    """One row about gradient variance, from each sequence's mean advantage A and W, the sum of
    1 - 2 pi + sum(pi^2) (times weight^2 if given): total power mean(A^2 max(W, 0)), signal strength
    grad_norm^2, noise max(0, (total - signal) / (n - 1)), mean A^2 and mean W."""
    w = 1 - 2 * F.exp(F.col(lp)) + F.col(sum_pi_squared)
    w = w * F.pow(F.col(weight), 2) if weight else w
    on = F.col(mask)
    per = tokens.groupBy(seq).agg((F.sum(F.when(on, F.col(advantage))) / (F.count_if(on) + 1e-8)).alias("a"), F.sum(F.when(on, w).otherwise(0.0)).alias("w"))
    signal = F.lit(float(grad_norm) ** 2 if grad_norm is not None else 0.0)
    out = per.agg(F.avg(F.coalesce(F.pow("a", 2), F.lit(0.0)) * F.greatest(F.col("w"), F.lit(0.0))).alias("total_power"), F.avg(F.coalesce(F.pow("a", 2), F.lit(0.0))).alias("expected_a_squared"), F.avg("w").alias("expected_w"), F.count("*").alias("n"))
    noise = F.when(F.col("n") > 1, F.greatest(F.lit(0.0), (F.col("total_power") - signal) / (F.col("n") - 1))).otherwise(0.0) if grad_norm is not None else F.lit(0.0)
    return out.withColumns({"signal_strength": signal, "pure_noise": noise})


def probability_gap(tokens: DataFrame, *, lp: str, rollout_lp: str, mask: str) -> DataFrame:
    """One row: max, mean and deviation of |p - q| and the correlation of p and q over masked tokens."""
    p, q = F.exp(lp), F.exp(rollout_lp)
    return tokens.filter(mask).agg(F.max(F.abs(p - q)).alias("diff_max"), F.avg(F.abs(p - q)).alias("diff_mean"), F.stddev_samp(F.abs(p - q)).alias("diff_std"), F.corr(p, q).alias("pearson"))


def adaptive_kl(steps: DataFrame, *, step: str, kl: str, n: str, start: float, target: float, horizon: float, key: str | None = None) -> DataFrame:
    """`coefficient` after each step: times 1 + clip(kl / target - 1, 0.2) n / horizon. A run's steps are its window."""
    mult = 1 + clamp(F.col(kl) / target - 1, -0.2, 0.2) * F.col(n) / horizon
    # one run is a list of steps that follow from each other; without a key all rows are one run
    order = Window.partitionBy(key if key else F.lit(0)).orderBy(step).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return steps.withColumn("coefficient", F.lit(start) * F.exp(F.sum(F.log(mult)).over(order)))


def from_logits(df: DataFrame, *, logits: str, pick: str | None = None) -> DataFrame:
    """Entropy and sum of squared probabilities of softmax(logits), and the log-probability at 0-based index `pick`."""
    sums = lambda x, f: F.aggregate(x, F.lit(0.0), lambda a, v: a + f(v))
    picked = (lambda x, lse: [(F.element_at(x, F.col(pick).cast("int") + 1) - lse).alias("log_prob")]) if pick else lambda x, lse: []
    # each step is bound once: inside a lambda it would be worked out again for every element
    parts = lambda x, lse: F.struct((lse - sums(x, lambda v: F.exp(v - lse) * v)).alias("entropy"), sums(x, lambda v: F.exp(2 * (v - lse))).alias("sum_pi_squared"), *picked(x, lse))
    from_top = lambda x: lambda top: let(top + F.log(sums(x, lambda v: F.exp(v - top))), lambda lse: parts(x, lse))
    found = let(F.transform(logits, lambda v: v.cast("double")), lambda x: let(F.array_max(x), from_top(x)))
    [name] = spare(df.columns, "_found")
    out = df.withColumn(name, found)
    return out.withColumns({c: F.col(f"{name}.{c}") for c in ("entropy", "sum_pi_squared", *(["log_prob"] if pick else []))}).drop(name)


def token_differences(tokens: DataFrame, *, seq: str, a: str, b: str, mask: str) -> DataFrame:
    """(seq, differing, tokens): at how many masked positions of a sequence two token columns differ, of how many.
    A null differs from every token."""
    return tokens.groupBy(seq).agg(F.count_if(F.col(mask) & ~F.col(a).eqNullSafe(F.col(b))).alias("differing"), F.count_if(F.col(mask)).alias("tokens"))
