"""Advantages, returns and off-policy diagnostics on `lineitem`: a line is a sample of its order, or
a token whose position is the rank of the line in its order; eight orders share a prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import advantages as adv
from ..operators import evaluation as ev
from ..operators import offpolicy as off
from ..sources.shared import parts_for
from .tables import Area, Tables

area = Area()
KEY = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]
TOK = f"""WITH tok AS (SELECT l_orderkey AS seq, l_orderkey // 8 AS uid, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(KEY)}) AS pos,
  l_linestatus = 'F' AS mask, l_extendedprice / 1000 AS reward, -l_discount - 0.01 AS lp, -l_tax - 0.01 AS rlp, l_quantity AS val, 0.5 + l_discount AS wt,
  CASE WHEN l_linestatus = 'F' THEN 1.0::DOUBLE ELSE 0.0 END AS m FROM lineitem)"""
ROWS = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey"


def tokens(t: Tables) -> DataFrame:
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*KEY))
    return t.lineitem.repartition(parts_for(t.lineitem), "l_orderkey").select(
        F.col("l_orderkey").alias("seq"), F.floor(F.col("l_orderkey") / 8).alias("uid"), pos.cast("long").alias("pos"), (F.col("l_linestatus") == "F").alias("mask"),
        (F.col("l_extendedprice") / 1000).alias("reward"), (-F.col("l_discount") - 0.01).alias("lp"), (-F.col("l_tax") - 0.01).alias("rlp"), F.col("l_quantity").alias("val"), (0.5 + F.col("l_discount")).alias("wt"))


def samples(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")


def lines(df: DataFrame, name: str = "advantage") -> DataFrame:
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", name)


G = "OVER (PARTITION BY l_orderkey)"


@area.query("""SELECT l_orderkey, CASE WHEN count(*) > 1 THEN avg(l_extendedprice) ELSE 0.0 END AS "mean~",
  CASE WHEN count(*) > 1 THEN stddev_samp(l_extendedprice) ELSE 1.0 END AS "std~", count(*) AS n FROM lineitem GROUP BY 1""")
def a6_group_stats(t):
    return adv.group_stats(samples(t), group="l_orderkey", score="l_extendedprice")


@area.query(f"""{ROWS}, CASE WHEN count(*) {G} > 1 THEN (l_extendedprice - avg(l_extendedprice) {G}) / (stddev_samp(l_extendedprice) {G} + 1e-6)
  ELSE l_extendedprice / (1 + 1e-6) END AS "advantage~" FROM lineitem""", digits=5)
def w1_grpo(t):
    return lines(adv.advantage("grpo")(samples(t), group="l_orderkey", score="l_extendedprice"))


@area.query(f"""{ROWS}, CASE WHEN count(*) {G} > 1 THEN l_extendedprice - avg(l_extendedprice) {G} ELSE l_extendedprice END AS "advantage~" FROM lineitem""")
def w1_grpo_unscaled(t):
    return lines(adv.grpo(samples(t), group="l_orderkey", score="l_extendedprice", scaled=False))


@area.query(f"""{ROWS}, CASE WHEN count(*) {G} > 1 THEN (l_quantity - avg(l_quantity) {G}) / (sqrt(greatest(var_samp(l_quantity) {G}, 1e-6)) + 1e-6)
  ELSE l_quantity / (1 + 1e-6) END AS "advantage~" FROM lineitem""", digits=5)
def w1_grpo_floored(t):
    return lines(adv.grpo_floored(samples(t), group="l_orderkey", score="l_quantity"))


@area.query(f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS s, stddev_samp(l_extendedprice) {G} AS sd, count(*) {G} AS n,
    row_number() OVER w AS rn, lead(l_extendedprice) OVER w AS nx FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey, l_quantity))
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN rn = 1 THEN (s - nx) / (sd + 1e-6) ELSE 0.0 END AS "advantage~" FROM r WHERE n > 1""", digits=5)
def w2_pass_at_k(t):
    whole = samples(t).withColumn("n", F.count("*").over(Window.partitionBy("l_orderkey"))).filter("n > 1")
    return lines(adv.pass_at_k(whole, group="l_orderkey", score="l_extendedprice", tie=["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]))


@area.query("""SELECT seq, pos, CASE WHEN mask THEN (c - mean) / sqrt(v + 1e-8) ELSE 0.0 END AS "advantage~" FROM cs, st""", digits=5, with_=TOK + """,
  s1 AS (SELECT uid, seq, avg(val) AS s FROM tok GROUP BY 1, 2),
  s2 AS (SELECT seq, s - CASE WHEN count(*) OVER (PARTITION BY uid) > 1 THEN avg(s) OVER (PARTITION BY uid) ELSE 0 END AS c FROM s1),
  cs AS (SELECT seq, pos, mask, c FROM tok JOIN s2 USING (seq)),
  m1 AS (SELECT sum(c) / (count(*) + 1e-8) AS mean, count(*) AS n FROM cs WHERE mask),
  st AS (SELECT mean, sum((c - mean) ** 2) / (n + 1e-8) * n / (n - 1) AS v FROM cs, m1 WHERE mask GROUP BY mean, n)""")
def w3_reinforce_plus_plus_baseline(t):
    scored = tokens(t).withColumn("score", F.avg("val").over(Window.partitionBy("seq")))
    return adv.reinforce_plus_plus_baseline(scored, group="uid", seq="seq", score="score", mask="mask").select("seq", "pos", "advantage")


@area.query(f"""{ROWS}, CASE WHEN count(*) {G} > 1 THEN count(*) {G} * 1.0::DOUBLE / (count(*) {G} - 1) * (l_extendedprice - avg(l_extendedprice) {G}) ELSE l_extendedprice END AS "advantage~" FROM lineitem""")
def w4_rloo(t):
    return lines(adv.rloo(samples(t), group="l_orderkey", score="l_extendedprice"))


@area.query(f"""{ROWS}, CASE WHEN count(*) {G} > 1 THEN count(*) {G} * 1.0::DOUBLE / (count(*) {G} - 1) * (l_extendedprice - avg(l_extendedprice) {G}) ELSE 0 END AS "advantage~" FROM lineitem""")
def w4_rloo_vectorized(t):
    return lines(adv.rloo(samples(t), group="l_orderkey", score="l_extendedprice", single_keeps=False))


@area.query(f"""{ROWS}, l_extendedprice / 7.77 - CASE WHEN count(*) {G} > 1 THEN sum(l_quantity * (l_extendedprice / 7.77)) {G} / sum(l_quantity) {G} ELSE 0 END AS "advantage~" FROM lineitem""")
def w5_opo(t):
    return lines(adv.opo(samples(t).withColumn("s", F.col("l_extendedprice") / 7.77), group="l_orderkey", score="s", length="l_quantity"))


@area.query(f"""{ROWS}, a * (s - CASE WHEN n > 1 THEN m ELSE 0 END) / 2.0 AS "advantage~" FROM (SELECT *, CASE WHEN l_quantity > 25 THEN l_quantity ELSE 0 END AS s,
    avg(CASE WHEN l_quantity > 25 THEN l_quantity ELSE 0 END) {G} AS m, count(*) {G} AS n FROM lineitem),
  (SELECT count(*) * 1.0::DOUBLE / greatest(count(*) FILTER (l_quantity > 25), 1) AS a FROM lineitem)""", digits=5)
def w6_gpg(t):
    scored = samples(t).withColumn("s", F.when(F.col("l_quantity") > 25, F.col("l_quantity")).otherwise(0.0))
    return lines(adv.gpg(scored, group="l_orderkey", score="s", norm=2.0))


@area.query("""SELECT seq, pos, sum(CASE WHEN mask THEN reward ELSE 0 END) OVER w AS "returns~", sum(CASE WHEN mask THEN reward ELSE 0 END) OVER w - CASE WHEN mask THEN val ELSE 0 END AS "advantage~"
  FROM tok WINDOW w AS (PARTITION BY seq ORDER BY pos DESC ROWS UNBOUNDED PRECEDING)""", digits=5, with_=TOK)
def w7_reward_to_go(t):
    return adv.reward_to_go(tokens(t), seq="seq", pos="pos", reward="reward", mask="mask", baseline="val").select("seq", "pos", "returns", "advantage")


BACK = TOK.replace("WITH", "WITH RECURSIVE", 1) + ", ends AS (SELECT seq, max(pos) AS last FROM tok GROUP BY seq)"


@area.query("""SELECT seq, pos, ret AS "returns~" FROM rec""", digits=5, with_=BACK + """, rec AS (
  SELECT seq, pos, m, reward AS ret FROM tok JOIN ends USING (seq) WHERE pos = last
  UNION ALL SELECT x.seq, x.pos, x.m, x.reward + 0.6666666666666666 * r.m * r.ret FROM rec r JOIN tok x ON x.seq = r.seq AND x.pos = r.pos - 1)""")
def w8_discounted_returns(t):
    return adv.discounted_returns(tokens(t), seq="seq", pos="pos", reward=F.col("reward"), mask=F.col("mask"), gamma=0.6666666666666666)


@area.query("""SELECT seq, pos, l AS "raw_advantage~", l + val AS "returns~" FROM rec""", digits=5, with_=BACK + """, rec AS (
  SELECT seq, pos, val, m * val AS v, m * (reward - val) AS l FROM tok JOIN ends USING (seq) WHERE pos = last
  UNION ALL SELECT x.seq, x.pos, x.val, x.m * x.val + (1 - x.m) * r.v, x.m * (x.reward + 0.8333333333333334 * r.v - x.val + 0.8333333333333334 * 0.6666666666666666 * r.l) + (1 - x.m) * r.l
  FROM rec r JOIN tok x ON x.seq = r.seq AND x.pos = r.pos - 1)""")
def w9_gae(t):
    return adv.gae(tokens(t), seq="seq", pos="pos", reward=F.col("reward"), value=F.col("val"), mask=F.col("mask"), gamma=0.8333333333333334, lam=0.6666666666666666)


def _baseline_sql(source: str) -> str:
    return f""",
  a AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY pos) AS at_ FROM {source}),
  g AS (SELECT *, sum(reward * m) OVER (PARTITION BY seq ORDER BY at_ DESC ROWS UNBOUNDED PRECEDING) AS ret, m * sum(wt * m) OVER (PARTITION BY seq ORDER BY at_ ROWS UNBOUNDED PRECEDING) AS w FROM a),
  ln AS (SELECT uid, seq, sum(m) AS len FROM g GROUP BY 1, 2),
  tl AS (SELECT seq, count(*) OVER (PARTITION BY uid) AS n, CASE WHEN row_number() OVER o = 1 AND len > nth_value(len, 2) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) THEN nth_value(len, 2) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS tail
    FROM ln WINDOW o AS (PARTITION BY uid ORDER BY len DESC, seq)),
  b AS (SELECT g.*, CASE WHEN n < 2 OR at_ > tail THEN 0 ELSE sum(ret * w) OVER c / (sum(w) OVER c + 1e-8) END AS base FROM g JOIN tl USING (seq) WINDOW c AS (PARTITION BY uid, at_))"""


@area.query("""SELECT seq, pos, ret AS "returns~", base AS "baseline~", (ret - base) * m AS "advantage~" FROM b""", digits=5, with_=TOK + _baseline_sql("tok"))
def w10_optimal_token_baseline(t):
    return adv.optimal_token_baseline(tokens(t), group="uid", seq="seq", pos="pos", reward="reward", mask="mask", weight="wt").select("seq", "pos", "returns", "baseline", "advantage")


@area.query("""SELECT seq, pos, ret AS "returns~", base AS "baseline~", (ret - base) * m AS "advantage~" FROM b""", digits=5, with_=TOK + _baseline_sql("tok WHERE mask"))
def w11_multi_turn_token_baseline(t):
    return adv.optimal_token_baseline(tokens(t), group="uid", seq="seq", pos="pos", reward="reward", mask="mask", weight="wt", compact=True).select("seq", "pos", "returns", "baseline", "advantage")


STATS = """SELECT l_returnflag, total AS "masked_sum~", total / (n + 1e-8) AS "masked_mean~", sum((x - total / (n + 1e-8)) ** 2) / (n + 1e-8) * n / (n - 1) AS "masked_var~", n
  FROM (SELECT l_returnflag, l_extendedprice / 1000 AS x, sum(l_extendedprice / 1000) OVER p AS total, count(*) OVER p AS n FROM lineitem WHERE l_linestatus = 'F' WINDOW p AS (PARTITION BY l_returnflag)) GROUP BY l_returnflag, total, n"""


@area.query(STATS, digits=4)
def a7_masked_stats(t):
    rows = t.lineitem.select("l_returnflag", (F.col("l_extendedprice") / 1000).alias("x"), (F.col("l_linestatus") == "F").alias("m"))
    return adv.masked_stats(rows, value="x", mask="m", by=["l_returnflag"])


@area.query("""SELECT seq, pos, (reward - mean) / sqrt(v + 1e-8) AS "whitened~" FROM tok, st""", digits=5, with_=TOK + """, m1 AS (SELECT sum(reward) / (count(*) + 1e-8) AS mean, count(*) AS n FROM tok WHERE mask),
  st AS (SELECT mean, sum((reward - mean) ** 2) / (n + 1e-8) * n / (n - 1) AS v FROM tok, m1 WHERE mask GROUP BY mean, n)""")
def a7_whiten(t):
    return adv.whiten(tokens(t), value="reward", mask="mask").select("seq", "pos", "whitened")


@area.query("""SELECT avg(l_extendedprice) AS "mean~", max(l_extendedprice) AS "max~", min(l_extendedprice) AS "min~", stddev_samp(l_extendedprice) AS "std~", avg(l_extendedprice) FILTER (l_returnflag = 'R') AS "masked_mean~" FROM lineitem""", digits=3)
def a8_distributed_stats(t):
    return ev.distributed_stats(t.lineitem, value="l_extendedprice", mask=F.col("l_returnflag") == "R")


@area.query("""SELECT max(abs(exp(lp) - exp(rlp))) AS "diff_max~", avg(abs(exp(lp) - exp(rlp))) AS "diff_mean~", stddev_samp(abs(exp(lp) - exp(rlp))) AS "diff_std~", corr(exp(lp), exp(rlp)) AS "pearson~" FROM tok WHERE mask""", with_=TOK)
def a21_probability_gap(t):
    return off.probability_gap(tokens(t), lp="lp", rollout_lp="rlp", mask="mask")


@area.query("""SELECT seq, count(*) FILTER (mask AND round(reward) <> round(val)) AS differing, count(*) FILTER (mask) AS tokens FROM tok GROUP BY seq""", with_=TOK)
def a22_token_differences(t):
    ids = tokens(t).withColumns({"a": F.round("reward"), "b": F.round("val")})
    return off.token_differences(ids, seq="seq", a="a", b="b", mask="mask")


SEQ = """, sq AS (SELECT seq, avg(lp) AS a, avg(rlp) AS b, sum(lp - rlp) AS s, count(*) AS n, sum(rlp - lp) AS kl, sum(exp(lp - rlp) - (lp - rlp) - 1) AS k3, sum(exp(2 * (lp - rlp))) AS chi FROM tok WHERE mask GROUP BY seq)"""


@area.query("""SELECT avg(exp(-a)) AS "training_ppl~", avg(-a) AS "training_log_ppl~", avg(exp(-b)) AS "rollout_ppl~", avg(-b) AS "rollout_log_ppl~", sum(kl) / sum(n) AS "kl~", sum(k3) / sum(n) AS "k3_kl~",
  avg(b - a) AS "log_ppl_diff~", avg(abs(b - a)) AS "log_ppl_abs_diff~", max(b - a) AS "log_ppl_diff_max~", min(b - a) AS "log_ppl_diff_min~", avg(exp(b - a)) AS "ppl_ratio~",
  sum(chi) / sum(n) - 1 AS "chi2_token~", avg(exp(2 * s)) - 1 AS "chi2_seq~" FROM sq""", with_=TOK + SEQ)
def a23_offpolicy_metrics(t):
    return off.offpolicy_metrics(tokens(t), seq="seq", lp="lp", rollout_lp="rlp", mask="mask")


@area.query("""SELECT mean AS "mean~", max AS "max~", min AS "min~", fraction_high AS "fraction_high~", fraction_low AS "fraction_low~", sqrt(greatest(c2 - c * c, 0)) AS "std~", (c + 1e-8) ** 2 / c2 AS "ess~",
    seq_mean AS "seq_mean~", seq_std AS "seq_std~", seq_max AS "seq_max~", seq_min AS "seq_min~"
  FROM (SELECT avg(w) AS mean, max(w) AS max, min(w) AS min, avg((w > 1.02)::INT) AS fraction_high, avg((w < 1 / 1.02)::INT) AS fraction_low, avg(least(greatest(w, 1 / 1.02), 1.02)) AS c, avg(least(greatest(w, 1 / 1.02), 1.02) ** 2) AS c2 FROM ws),
    (SELECT avg(m) AS seq_mean, stddev_samp(m) AS seq_std, max(m) AS seq_max, min(m) AS seq_min FROM (SELECT avg(w) AS m FROM ws GROUP BY seq))""", with_=TOK + ", ws AS (SELECT seq, exp(lp - rlp) AS w FROM tok WHERE mask)")
def a24_weight_metrics(t):
    weighted = off.importance_weights(tokens(t), seq="seq", lp="lp", rollout_lp="rlp", mask="mask")
    return off.weight_metrics(weighted, seq="seq", weight="raw_weight", mask="mask", threshold=1.02)


LOSS = TOK + ", ls AS (SELECT seq, sum(reward) FILTER (mask) AS s, count(*) FILTER (mask) AS n FROM tok GROUP BY seq)"


@area.query("""SELECT * FROM (SELECT 'token-mean' AS mode, sum(s) / (sum(n) + 1e-8) AS "loss~" FROM ls UNION ALL SELECT 'seq-mean-token-sum', sum(s) FILTER (n > 0) / (count(*) FILTER (n > 0) + 1e-8) FROM ls
  UNION ALL SELECT 'seq-mean-token-mean', sum(s / (n + 1e-8)) FILTER (n > 0) / (count(*) FILTER (n > 0) + 1e-8) FROM ls UNION ALL SELECT 'seq-mean-token-sum-norm', sum(s) FILTER (n > 0) / 16.0 FROM ls)""", digits=3, with_=LOSS)
def a25_loss_modes(t):
    parts = [off.aggregate_loss(tokens(t), seq="seq", loss=F.col("reward"), mask="mask", mode=m, horizon=16).select(F.lit(m).alias("mode"), "loss") for m in ("token-mean", "seq-mean-token-sum", "seq-mean-token-mean", "seq-mean-token-sum-norm")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@area.query("""SELECT avg(coalesce(a * a, 0) * greatest(w, 0)) AS "total_power~", avg(coalesce(a * a, 0)) AS "expected_a_squared~", avg(w) AS "expected_w~", count(*) AS n, 0.25::DOUBLE AS "signal_strength~",
  greatest(0, (avg(coalesce(a * a, 0) * greatest(w, 0)) - 0.25) / (count(*) - 1)) AS "pure_noise~"
  FROM (SELECT seq, sum(reward) FILTER (mask) / (count(*) FILTER (mask) + 1e-8) AS a, sum(CASE WHEN mask THEN 1 - 2 * exp(lp) + exp(2 * lp) ELSE 0 END) AS w FROM tok GROUP BY seq)""", with_=TOK, digits=4)
def a12_variance_proxies(t):
    rows = tokens(t).withColumn("pi2", F.exp(2 * F.col("lp")))
    return off.variance_proxies(rows, seq="seq", lp="lp", sum_pi_squared="pi2", advantage="reward", mask="mask", grad_norm=0.5)


@area.query("""SELECT seq, pos, lp - rlp AS "k1~", abs(lp - rlp) AS "abs~", (lp - rlp) ** 2 / 2 AS "k2~", exp(rlp - lp) - (rlp - lp) - 1 AS "k3~" FROM tok""", with_=TOK)
def c28_kl_estimates(t):
    return tokens(t).select("seq", "pos", *[off.kl_estimate(F.col("lp"), F.col("rlp"), k).alias(k) for k in ("k1", "abs", "k2", "k3")])


@area.query("""SELECT seq, pos, CASE WHEN mask THEN lp - rlp ELSE 0 END AS "kl~", reward - 0.1 * CASE WHEN mask THEN lp - rlp ELSE 0 END AS "penalised~" FROM tok""", with_=TOK)
def c29_kl_penalised_reward(t):
    return off.kl_penalised(tokens(t), seq="seq", reward="reward", lp="lp", ref="rlp", mask="mask", beta=0.1)[0].select("seq", "pos", "kl", "penalised")


@area.query("""SELECT avg(m) AS "current_kl~" FROM (SELECT sum(CASE WHEN mask THEN lp - rlp ELSE 0 END) / (count(*) FILTER (mask) + 1e-8) AS m FROM tok GROUP BY seq)""", with_=TOK)
def c29_current_kl(t):
    return off.kl_penalised(tokens(t), seq="seq", reward="reward", lp="lp", ref="rlp", mask="mask", beta=0.1)[1]


@area.query("""SELECT seq, pos, w AS "raw_weight~", least(w, 1.05) / (SELECT avg(m) FROM (SELECT avg(least(w, 1.05)) AS m FROM ws WHERE mask GROUP BY seq)) AS "weight~" FROM ws""", with_=TOK + """,
  ws AS (SELECT seq, pos, mask, CASE WHEN mask THEN exp(sum(CASE WHEN mask THEN lp - rlp END) OVER (PARTITION BY seq)) ELSE 0 END AS w FROM tok)""")
def c30_importance_weights(t):
    return off.importance_weights(tokens(t), seq="seq", lp="lp", rollout_lp="rlp", mask="mask", level="sequence", threshold=1.05, normalise=True).select("seq", "pos", "raw_weight", "weight")


@area.query("""SELECT seq, pos, mask AND exp(avg(CASE WHEN mask THEN lp - rlp END) OVER p) BETWEEN 1 / 1.03 AND 1.03 AND NOT bool_or(mask AND lp - rlp < ln(0.93)) OVER p AS keep FROM tok WINDOW p AS (PARTITION BY seq)""", with_=TOK)
def c31_rejection_mask(t):
    return off.rejection_mask(tokens(t), seq="seq", lp="lp", rollout_lp="rlp", mask="mask", level="geometric", upper=1.03, veto=0.93).select("seq", "pos", F.coalesce("keep", F.lit(False)).alias("keep"))


OBJ = TOK + """, o AS (SELECT *, exp(lp - rlp) AS r, val - 25 AS a, exp(avg(CASE WHEN mask THEN lp - rlp END) OVER (PARTITION BY seq)) AS rs,
  avg(CASE WHEN mask THEN sign(val - 25) * least((lp - rlp) * sign(val - 25), least(greatest((lp - rlp) * sign(val - 25), -0.02), 0.02)) END) OVER (PARTITION BY seq) AS gm FROM tok)"""
_CLIP = "least(greatest({}, 0.98), 1.02)"
_FORMS = {
    "vanilla": f"CASE WHEN a < 0 THEN least(greatest(-a * r, -a * {_CLIP.format('r')}), -a * 3) ELSE greatest(-a * r, -a * {_CLIP.format('r')}) END",
    "gspo": f"greatest(-a * rs, -a * {_CLIP.format('rs')})",
    "sapo": "-a * (1 / (1 + exp(-CASE WHEN a > 0 THEN 1.0 ELSE 1.05 END * (r - 1)))) * 4 / CASE WHEN a > 0 THEN 1.0 ELSE 1.05 END",
    "gpg": "-lp * a", "cispo": f"-{_CLIP.format('r')} * a * lp", "geo_mean": "-a * exp(gm)", "reinforce": "-a * lp"}


@area.query(" UNION ALL ".join(f"""SELECT '{n}' AS objective, sum(CASE WHEN mask THEN {f} END) / (count(*) FILTER (mask) + 1e-8) AS "loss~",
  avg((-a * {_CLIP.format('r')} > -a * r)::INT) FILTER (mask) AS "clip_fraction~", avg(rlp - lp) FILTER (mask) AS "approx_kl~" FROM o""" for n, f in _FORMS.items()), with_=OBJ)
def c32_objective_values(t):
    rows = tokens(t).withColumn("a", F.col("val") - 25)
    parts = [off.objective_value(rows, name=n, seq="seq", lp="lp", old="rlp", adv="a", mask="mask", clip=0.02).select(F.lit(n).alias("objective"), "loss", "clip_fraction", "approx_kl") for n in _FORMS]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@area.query("""SELECT sum(greatest((val - reward) ** 2, (greatest(least(val, val * 0.9 + 1.5), val * 0.9 - 1.5) - reward) ** 2) / 2) FILTER (mask) / (count(*) FILTER (mask) + 1e-8) AS "loss~" FROM tok""", with_=TOK, digits=4)
def c32_value_loss(t):
    return off.value_loss(tokens(t).withColumn("old", F.col("val") * 0.9), seq="seq", value="val", old_value="old", returns="reward", mask="mask", clip=1.5)


@area.query("""SELECT day, 0.2 * exp(sum(ln(1 + least(greatest(kl / 100.0 - 1, -0.2), 0.2) * n / 1000.0)) OVER (ORDER BY day)) AS "coefficient~"
  FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, avg(value) AS kl, count(*) AS n FROM events GROUP BY 1)""")
def c33_adaptive_kl(t):
    days = t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.avg("value").alias("kl"), F.count("*").alias("n"))
    return off.adaptive_kl(days, step="day", kl="kl", n="n", start=0.2, target=100.0, horizon=1000.0).select("day", "coefficient")


LOGITS = """WITH x AS (SELECT vec_id, vec_id % 64 AS pick, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS k FROM embeddings),
  z AS (SELECT vec_id, max(v) + ln(sum(exp(v - mx))) AS lse FROM (SELECT *, max(v) OVER (PARTITION BY vec_id) AS mx FROM x) GROUP BY vec_id)"""


@area.query("""SELECT vec_id, lse - sum(exp(v - lse) * v) AS "entropy~", sum(exp(2 * (v - lse))) AS "sum_pi_squared~", max(v) FILTER (k = pick + 1) - lse AS "log_prob~" FROM x JOIN z USING (vec_id) GROUP BY vec_id, lse""", with_=LOGITS)
def c27_from_logits(t):
    rows = t.embeddings.withColumn("pick", F.col("vec_id") % 64)
    return off.from_logits(rows, logits="embedding", pick="pick").select("vec_id", "entropy", "sum_pi_squared", "log_prob")


QUERIES, ORACLE_SQL = area.queries, area.sql
