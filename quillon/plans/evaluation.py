"""Evaluation reports: orders as rows with their lines as responses, labels as scored documents, events as metrics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import resampling as rs
from .tables import Area

area = Area()


@area.query("""
SELECT data_source, avg(s) AS "test_score~", count(*) AS n_rows FROM (
  SELECT o_orderkey, o_orderpriority AS data_source, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS s
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2) GROUP BY 1""")
def a1_offline_evaluation(t):
    rows = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    return ev.offline_evaluation(rows, row="o_orderkey", source="o_orderpriority", score=(F.col("l_returnflag") == "R").cast("double"))


RECORDS = """WITH r AS (SELECT d.doc_id, source, CASE WHEN quality IS NOT NULL THEN quality / 2.0 END AS score, quality = 1 AS ok, CASE WHEN toxic = 1 THEN 'flagged' END AS error,
  n_chars // 100 AS frames, CASE WHEN n_chars % 3 > 0 THEN n_chars % 7 END AS calls FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def records(t):
    d = t.documents.select("doc_id", "source", "n_chars").join(t.labels, "doc_id", "left")
    return d.select("doc_id", "source", (F.col("quality") / 2.0).alias("score"), (F.col("quality") == 1).alias("ok"), F.when(F.col("toxic") == 1, "flagged").alias("error"),
                    F.expr("n_chars div 100").alias("frames"), F.when(F.col("n_chars") % 3 > 0, F.col("n_chars") % 7).alias("calls"))


SUMMARY = """count(*) AS attempted, count(*) FILTER (error IS NULL) AS completed, count(*) FILTER (error IS NULL AND score IS NOT NULL AND ok) AS correct,
  coalesce(count(*) FILTER (error IS NULL AND score IS NOT NULL AND ok) / nullif(count(*) FILTER (error IS NULL AND score IS NOT NULL), 0), 0)::DOUBLE AS "accuracy~",
  coalesce(avg(score) FILTER (error IS NULL), 0)::DOUBLE AS "average_score~", count(*) FILTER (error IS NOT NULL) AS failed,
  coalesce(avg(coalesce(frames, 0)) FILTER (error IS NULL), 0)::DOUBLE AS "mean_frames~", coalesce(avg(coalesce(calls, 0)) FILTER (error IS NULL), 0)::DOUBLE AS "mean_calls~" FROM r"""
USAGE = {"mean_frames": "frames", "mean_calls": "calls"}


@area.query(f"SELECT {SUMMARY}", with_=RECORDS)
def a2_evaluation_summary(t):
    return ev.evaluation_summary(records(t), score="score", correct="ok", error="error", usage=USAGE)


@area.query(f"SELECT source, {SUMMARY} GROUP BY ROLLUP (source)", with_=RECORDS)
def a2_summary_by_source(t):
    return ev.evaluation_summary(records(t), score="score", correct="ok", error="error", usage=USAGE, by="source")


@area.query("""SELECT conv_id, count(*) FILTER (role = 'assistant') AS visual_calls, count(*) FILTER (role = 'user') AS llm_calls, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS total_frames FROM conversations GROUP BY 1""")
def a3_call_usage(t):
    kind = F.when(F.col("role") == "assistant", "visual").when(F.col("role") == "user", "llm").otherwise("none")
    calls = t.conversations.groupBy("conv_id").agg(F.collect_list(F.struct(kind.alias("kind"), F.length("text").alias("frames"))).alias("calls"))
    return ev.call_usage(calls, calls="calls").drop("calls")


OUT = """WITH o AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'first_try' WHEN 'O' THEN 'corrected' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'failed' ELSE 'skipped' END END AS outcome FROM orders),
  seg AS (SELECT o.*, coalesce(n, 0) AS segments FROM o LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"""
RATES = """count(*) AS total, count(*) FILTER (outcome = 'first_try') AS first_try, count(*) FILTER (outcome = 'corrected') AS corrected, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'skipped') AS skipped,
  count(*) FILTER (outcome = 'first_try') / greatest(count(*) FILTER (outcome <> 'skipped'), 1) AS "first_try_rate~", count(*) FILTER (outcome IN ('first_try', 'corrected')) / greatest(count(*) FILTER (outcome <> 'skipped'), 1) AS "success_rate~\""""


def outcomes(t):
    return t.orders.withColumn("outcome", F.when(F.col("o_orderstatus") == "F", "first_try").when(F.col("o_orderstatus") == "O", "corrected").when(F.col("o_orderkey") % 2 == 0, "failed").otherwise("skipped"))


@area.query(f"SELECT o_orderpriority, {RATES} FROM o GROUP BY ROLLUP (o_orderpriority)", with_=OUT)
def a4_outcome_report(t):
    return ev.outcome_report(outcomes(t), outcome="outcome", by="o_orderpriority")


@area.query(f"SELECT segments, o_orderpriority, CAST(grouping(segments, o_orderpriority) AS BIGINT) AS grouping, {RATES} FROM seg GROUP BY GROUPING SETS ((segments), (o_orderpriority), ())", with_=OUT)
def a5_outcome_grouping_sets(t):
    n = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    seg = outcomes(t).join(n, "o_orderkey", "left").withColumn("segments", F.coalesce("n", F.lit(0).cast("long")))
    return ev.outcome_report(seg, outcome="outcome", sets=["segments", "o_orderpriority"])


N = "unnest(CASE WHEN size > 1 THEN list_append(list_filter([2, 4, 8, 16, 32], lambda x: x < size), size) ELSE [] END)"
RANKED = f"""WITH v AS (SELECT l_orderkey, l_quantity AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS i, count(*) OVER (PARTITION BY l_orderkey) AS size FROM lineitem),
  e AS (SELECT *, {N}::BIGINT AS n FROM v),
  w AS (SELECT *, (i / size) ** n - ((i - 1) / size) ** n AS up, ((size - i + 1) / size) ** n - ((size - i) / size) ** n AS down FROM e)"""


@area.query("""SELECT l_orderkey, n, b AS "best_mean~", sqrt(greatest(b2 - b * b, 0)) AS "best_std~", l AS "worst_mean~", sqrt(greatest(l2 - l * l, 0)) AS "worst_std~"
  FROM (SELECT l_orderkey, n, sum(x * up) AS b, sum(x * x * up) AS b2, sum(x * down) AS l, sum(x * x * down) AS l2 FROM w GROUP BY 1, 2)""", with_=RANKED, digits=4)
def a13_best_and_worst(t):
    size = F.count("*").over(Window.partitionBy("l_orderkey"))
    return ev.best_and_worst(t.lineitem.select("l_orderkey", "l_quantity"), keys=["l_orderkey"], value="l_quantity", n=ev.ladder(size))


DRAWN = "('0x' || substr(md5('42:' || {} || ':' || j), 1, 8))::BIGINT % size AS i"


@area.query("""SELECT o_orderpriority, avg(r) AS "mean~", stddev_pop(r) AS "std~" FROM (SELECT o_orderpriority, k, max(x) AS r FROM d JOIN v USING (o_orderpriority, i) GROUP BY 1, 2) GROUP BY 1""", with_=f"""
  WITH v AS (SELECT o_orderpriority, o_totalprice AS x, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey, o_totalprice) - 1 AS i FROM orders),
  s AS (SELECT o_orderpriority, count(*) AS size FROM orders GROUP BY 1),
  d AS (SELECT o_orderpriority, k, {DRAWN.format("o_orderpriority || ':' || k")} FROM s, range(1, 1001) a(k), range(1, 33) b(j))""", digits=7)
def x7_bootstrap(t):
    return ev.bootstrap(t.orders, keys=["o_orderpriority"], value="o_totalprice", order=["o_orderkey"], size=32, rounds=1000, reducer=F.max("drawn"))


@area.query("""SELECT l_orderkey, avg(hi) AS "best_mean~", stddev_pop(hi) AS "best_std~", avg(lo) AS "worst_mean~", stddev_pop(lo) AS "worst_std~", avg(mid) AS "spread_mean~", stddev_pop(mid) AS "spread_std~"
  FROM (SELECT l_orderkey, k, max(x) AS hi, min(x) AS lo, max(x) - min(x) AS mid FROM v JOIN d USING (size, i) GROUP BY 1, 2) GROUP BY 1""", with_=f"""
  WITH v AS (SELECT l_orderkey, l_quantity AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS size FROM lineitem),
  d AS (SELECT size, k, {DRAWN.format("k")} FROM (SELECT DISTINCT size FROM v), range(1, 1001) a(k), range(1, 100) b(j) WHERE j <= size)""", digits=4)
def x7_resampled_prompts(t):
    reducers = {"best": lambda x: x.max(axis=-1), "worst": lambda x: x.min(axis=-1), "spread": lambda x: np.ptp(x, axis=-1)}
    return rs.resampled(t.lineitem, keys=["l_orderkey"], value="l_quantity", order=["l_linenumber"], reducers=reducers, rounds=1000)


@area.query("""SELECT l_orderkey, v AS majority_vote, (list(val ORDER BY l_linenumber, l_partkey, l_suppkey, val) FILTER (vote = v))[1] AS "majority_value~", n AS n_votes FROM
  (SELECT l_orderkey, l_returnflag AS vote, l_quantity AS val, l_linenumber, l_partkey, l_suppkey FROM lineitem) x JOIN best USING (l_orderkey) GROUP BY l_orderkey, v, n""", with_="""
  WITH c AS (SELECT l_orderkey, l_returnflag AS v, count(*) AS n, min((l_linenumber, l_partkey, l_suppkey, l_quantity)) AS p FROM lineitem GROUP BY 1, 2),
  best AS (SELECT l_orderkey, v, n FROM c QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, p, v) = 1)""")
def a14_majority(t):
    return ev.majority(t.lineitem, keys=["l_orderkey"], vote="l_returnflag", value="l_quantity", pos=["l_linenumber", "l_partkey", "l_suppkey"])


VALID = f"""WITH x AS (SELECT o_orderpriority, o_orderkey, variable, x, vote FROM (SELECT o_orderpriority, o_orderkey, (l_returnflag = 'R')::INT::DOUBLE AS acc, l_quantity AS reward, l_linestatus AS vote FROM orders JOIN lineitem ON o_orderkey = l_orderkey) UNPIVOT (x FOR variable IN (acc, reward))),
  v AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey, variable ORDER BY x) AS i, count(*) OVER (PARTITION BY o_orderkey, variable) AS size FROM x),
  e AS (SELECT *, {N}::BIGINT AS n FROM v),
  w AS (SELECT *, (i / size) ** n - ((i - 1) / size) ** n AS up, ((size - i + 1) / size) ** n - ((size - i) / size) ** n AS down FROM e),
  g AS (SELECT o_orderpriority, o_orderkey, variable, n, sum(x * up) AS b, sqrt(greatest(sum(x * x * up) - sum(x * up) ** 2, 0)) AS bs, sum(x * down) AS l, sqrt(greatest(sum(x * x * down) - sum(x * down) ** 2, 0)) AS ls FROM w GROUP BY 1, 2, 3, 4),
  vo AS (SELECT o_orderpriority, o_orderkey, variable, count(*) AS size, count(*) FILTER (vote = 'O') / count(*) AS p, avg(x) FILTER (vote = 'O') AS a, avg(x * x) FILTER (vote = 'O') AS a2,
    avg(x) FILTER (vote = 'F') AS b, avg(x * x) FILTER (vote = 'F') AS b2 FROM x GROUP BY 1, 2, 3),
  pr AS (SELECT *, list_sum(list_transform(range(0, n + 1), lambda k: factorial(n::INT) / (factorial(k::INT) * factorial((n - k)::INT)) * p ** k * (1 - p) ** (n - k) * CASE WHEN 2 * k > n THEN 1 WHEN 2 * k = n THEN 0.5 ELSE 0 END)) AS o
    FROM (SELECT *, {N}::BIGINT AS n FROM vo)),
  mj AS (SELECT o_orderpriority, o_orderkey, variable, n, coalesce(o * a, 0) + coalesce((1 - o) * b, 0) AS m, sqrt(greatest(coalesce(o * a2, 0) + coalesce((1 - o) * b2, 0) - (coalesce(o * a, 0) + coalesce((1 - o) * b, 0)) ** 2, 0)) AS s FROM pr),
  m AS (SELECT o_orderpriority, o_orderkey, variable, count(*) AS n, avg(x) AS m, CASE WHEN count(*) > 1 THEN stddev_pop(x) END AS s FROM x GROUP BY 1, 2, 3),
  a AS (SELECT o_orderpriority, variable, 'mean@' || n AS metric, m AS value FROM m UNION ALL SELECT o_orderpriority, variable, 'std@' || n, s FROM m WHERE s IS NOT NULL
    UNION ALL SELECT o_orderpriority, variable, 'best@' || n || '/mean', b FROM g UNION ALL SELECT o_orderpriority, variable, 'best@' || n || '/std', bs FROM g
    UNION ALL SELECT o_orderpriority, variable, 'worst@' || n || '/mean', l FROM g UNION ALL SELECT o_orderpriority, variable, 'worst@' || n || '/std', ls FROM g
    UNION ALL SELECT o_orderpriority, variable, 'maj@' || n || '/mean', m FROM mj UNION ALL SELECT o_orderpriority, variable, 'maj@' || n || '/std', s FROM mj),
  f AS (SELECT o_orderpriority, variable, metric, avg(value) AS value FROM a GROUP BY 1, 2, 3)"""


def validated(t):
    rows = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(
        "o_orderpriority", "o_orderkey", (F.col("l_returnflag") == "R").cast("double").alias("acc"), F.col("l_quantity").alias("reward"), "l_linestatus")
    return ev.validation_metrics(rows, source="o_orderpriority", uid="o_orderkey", variables=["acc", "reward"], vote="l_linestatus")


@area.query("""SELECT o_orderpriority, variable, metric, value AS "value~" FROM f""", with_=VALID, digits=6)
def a15_validation_metrics(t):
    return validated(t)


@area.query("""SELECT o_orderpriority, variable, metric, value AS "value~", concat_ws('/', CASE WHEN variable = 'acc' AND n = max(n) OVER (PARTITION BY o_orderpriority, variable) AND regexp_matches(metric, '^(mean@|maj@.*mean|best@.*mean)') THEN 'val-core' ELSE 'val-aux' END, o_orderpriority, variable, metric) AS name
  FROM (SELECT *, regexp_extract(metric, '@([0-9]+)', 1)::INT AS n FROM f)""", with_=VALID, digits=6)
def a16_metric_sections(t):
    return ev.metric_sections(validated(t), source="o_orderpriority")


NAMED = """WITH e AS (SELECT event_type || CASE event_id % 4 WHEN 0 THEN '/max' WHEN 1 THEN '/min_len' WHEN 2 THEN '/mean' ELSE '/total' END AS name, value, event_id AS step, user_id AS cnt, strftime(ts, '%Y-%m-%d') AS day, ts FROM events)"""


def named(t):
    suffix = F.when(F.col("event_id") % 4 == 0, "/max").when(F.col("event_id") % 4 == 1, "/min_len").when(F.col("event_id") % 4 == 2, "/mean").otherwise("/total")
    return t.events.select(F.concat("event_type", suffix).alias("name"), "value", F.col("event_id").alias("step"), F.col("user_id").alias("cnt"), F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts")


@area.query("""SELECT name, CASE WHEN contains(name, 'max') THEN max(value) WHEN contains(name, 'min') THEN min(value) ELSE avg(value) END AS "value~" FROM e GROUP BY name""", with_=NAMED)
def a17_reduce_metrics(t):
    return ev.reduce_metrics(named(t), name="name", value="value")


ROLL = """CASE kind WHEN 'last' THEN max_by(value, step) WHEN 'weighted_avg' THEN sum(value * cnt) / sum(cnt) WHEN 'sum' THEN sum(value) WHEN 'max' THEN max(value) WHEN 'min' THEN min(value) ELSE avg(value) END"""
KIND = """, k AS (SELECT *, CASE WHEN name = 'click/total' THEN 'last' WHEN name = 'view/mean' THEN 'weighted_avg' WHEN contains(name, 'mean') THEN 'avg' WHEN contains(name, 'max') THEN 'max' WHEN contains(name, 'min') THEN 'min' WHEN contains(name, 'total') THEN 'sum' ELSE 'avg' END AS kind FROM e)"""
RULES = {"click/total": "last", "view/mean": "weighted_avg"}


@area.query(f"""SELECT name, kind, {ROLL} AS "value~" FROM k GROUP BY name, kind""", with_=NAMED + KIND, digits=4)
def a18_rollup_steps(t):
    return ev.rollup_steps(named(t), name="name", step="step", value="value", count="cnt", rules=RULES)


@area.query("""SELECT event_type, avg(value) AS "avg~", max(value) AS "max~", min(value) AS "min~", quantile_cont(value, 0.5) AS "tp50~", quantile_cont(value, 0.95) AS "tp95~", quantile_cont(value, 0.99) AS "tp99~" FROM events GROUP BY 1""", digits=5)
def a19_time_percentiles(t):
    return ev.time_statistics(t.events, value="value", by=["event_type"])


@area.query("""SELECT count(*) FILTER (b > a) AS partial, count(*) FILTER (b > a) / count(*) AS "partial_ratio~", max(b - a) AS max_span, count(DISTINCT b) AS versions
  FROM (SELECT l_orderkey, min(l_linenumber) AS a, max(l_linenumber) AS b FROM lineitem GROUP BY 1)""")
def a19_version_statistics(t):
    spans = t.lineitem.groupBy("l_orderkey").agg(F.min("l_linenumber").alias("a"), F.max("l_linenumber").alias("b"))
    return ev.version_statistics(spans, start="a", end="b")


@area.query("""SELECT min(value) AS "value_min~", max(value) AS "value_max~", avg(value) AS "value_mean~", min(u) AS "u_min~", max(u) AS "u_max~", avg(u) AS "u_mean~",
    arg_min(event_id, (-(value + u), event_id)) AS slowest_event_id, arg_min(value, (-(value + u), event_id)) AS "slowest_value~", arg_min(u, (-(value + u), event_id)) AS "slowest_u~" FROM (SELECT *, user_id / 10 AS u FROM events)""", digits=5)
def a20_slowest(t):
    return ev.slowest(t.events.withColumn("u", F.col("user_id") / 10), parts=["value", "u"], keep=["event_id"], order=["event_id"])


STEP = """WITH k AS (SELECT l_orderkey AS seq, l_linestatus = 'F' AS m, l_quantity AS s, l_discount AS r, l_tax AS a, l_extendedprice / 1000 AS g, l_quantity / 3 AS v FROM lineitem),
  q AS (SELECT seq, sum(s) FILTER (m) AS s, sum(r) FILTER (m) AS r, count(*) FILTER (m) AS n FROM k GROUP BY 1)"""


@area.query("""SELECT * FROM (SELECT avg(s) FILTER (n > 0) AS "score_mean~", max(s) FILTER (n > 0) AS "score_max~", min(s) FILTER (n > 0) AS "score_min~", avg(r) FILTER (n > 0) AS "reward_mean~", max(r) FILTER (n > 0) AS "reward_max~", min(r) FILTER (n > 0) AS "reward_min~",
    avg(n) AS "response_length_mean~", max(n) AS response_length_max, min(n) AS response_length_min, avg(n) FILTER (n > 0) AS "response_length_non_aborted_mean~", max(n) FILTER (n > 0) AS response_length_non_aborted_max, min(n) FILTER (n > 0) AS response_length_non_aborted_min,
    avg((n = 7)::INT) AS "response_length_clip_ratio~", avg((n = 0)::INT) AS "aborted_ratio~" FROM q),
  (SELECT avg(a) AS "advantage_mean~", max(a) AS "advantage_max~", min(a) AS "advantage_min~", avg(g) AS "returns_mean~", max(g) AS "returns_max~", min(g) AS "returns_min~", avg(v) AS "values_mean~", max(v) AS "values_max~", min(v) AS "values_min~",
    1 - var_samp(g - v) / (var_samp(g) + 1e-5) AS "explained_var~" FROM k WHERE m)""", with_=STEP, digits=5)
def a9_step_metrics(t):
    k = t.lineitem.select(F.col("l_orderkey").alias("seq"), (F.col("l_linestatus") == "F").alias("m"), F.col("l_quantity").alias("s"), F.col("l_discount").alias("r"), F.col("l_tax").alias("a"), (F.col("l_extendedprice") / 1000).alias("g"), (F.col("l_quantity") / 3).alias("v"))
    return ev.step_metrics(k, seq="seq", mask="m", score="s", reward="r", advantage="a", returns="g", value="v", limit=7)


@area.query("""SELECT event_id, event_type, value * 1000 / CASE WHEN event_type = 'gen' THEN 10.0 WHEN event_type IN ('ref', 'values', 'adv', 'update_critic', 'update_actor') THEN 30.0 END AS "ms_per_token~"
  FROM (SELECT event_id, value, CASE event_id % 3 WHEN 0 THEN 'gen' WHEN 1 THEN 'adv' ELSE event_type END AS event_type FROM events)""", digits=5)
def a10_timing_per_token(t):
    e = t.events.withColumn("event_type", F.when(F.col("event_id") % 3 == 0, "gen").when(F.col("event_id") % 3 == 1, "adv").otherwise(F.col("event_type")))
    return ev.timing_per_token(e, F.lit(30.0), name="event_type", seconds="value", response_tokens=F.lit(10.0)).select("event_id", "event_type", "ms_per_token")


@area.query("""SELECT mx - mn AS "minmax_diff~", tokens / (secs * 8) AS "throughput~", gen / step AS "idle_ratio~" FROM (SELECT max(n) AS mx, min(n) AS mn FROM (SELECT sum(l_quantity) AS n FROM lineitem GROUP BY l_orderkey)),
  (SELECT sum(l_quantity) AS tokens FROM lineitem), (SELECT avg(value) AS secs, sum(value) FILTER (event_type = 'click') AS gen, sum(value) AS step FROM events)""")
def a11_throughput(t):
    lengths = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("n")).agg(F.max("n").alias("global_seqlen/max"), F.min("n").alias("global_seqlen/min"), F.sum("n").alias("perf/total_num_tokens"))
    times = t.events.agg(F.avg("value").alias("perf/time_per_step"), F.sum(F.when(F.col("event_type") == "click", F.col("value"))).alias("timing_s/gen"), F.sum("value").alias("timing_s/step"))
    one = lengths.crossJoin(times)  # one row each
    names = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("double").alias("value")) for c in one.columns])
    return ev.derived_metrics(one.select(F.explode(names).alias("m")).select("m.*"), name="name", gpus=8)


@area.query("""SELECT CAST(sum(c) AS BIGINT) AS points, CAST(sum(2 * n) AS BIGINT) AS max_points, sum(c) / sum(2 * n) AS "ratio~" FROM (SELECT len(w) AS n, len(list_filter(w, lambda x: length(x) > 3)) + len(list_filter(w, lambda x: length(x) > 5)) AS c
  FROM (SELECT string_split(regexp_replace(text, '[^a-z ]', '', 'g'), ' ') AS w FROM benchmark))""")
def a28_rubric_total(t):
    words = F.split(F.regexp_replace("text", "[^a-z ]", ""), " ")
    judged = t.benchmark.select(F.concat(F.lit("Scores:\n```json\n"), F.to_json(F.struct(F.transform(words, lambda w: F.length(w) > 3).alias("coverage"), F.transform(words, lambda w: F.length(w) > 5).alias("correctness"))), F.lit("\n```")).alias("answer"))
    return ev.rubric_total(judged.union(t.conversations.select("text")), text="answer")


@area.query("""SELECT source, count(*) AS attempted, coalesce(sum((quality = 1)::INT), 0)::BIGINT AS correct, coalesce(sum((quality = 1)::INT), 0) / count(*) * 100 AS "accuracy~" FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def a30_task_accuracy(t):
    rows = t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left")
    return ev.task_accuracy(rows, by=["source"], correct=F.col("quality") == 1)


@area.query("""SELECT * FROM (SELECT 'doc_id' AS "column", 'bigint' AS type, count(*) AS n_rows, count(*) FILTER (doc_id IS NULL) AS n_null, avg(strlen(doc_id::VARCHAR)) AS "avg_size~" FROM documents
  UNION ALL SELECT 'text', 'string', count(*), count(*) FILTER (text IS NULL), avg(strlen(text)) FROM documents UNION ALL SELECT 'lang', 'string', count(*), count(*) FILTER (lang IS NULL), avg(strlen(lang)) FROM documents
  UNION ALL SELECT 'source', 'string', count(*), count(*) FILTER (source IS NULL), avg(strlen(source)) FROM documents UNION ALL SELECT 'n_chars', 'bigint', count(*), count(*) FILTER (n_chars IS NULL), avg(strlen(n_chars::VARCHAR)) FROM documents)""")
def a31_table_profile(t):
    return ev.table_profile(t.documents)


QUERIES, ORACLE_SQL = area.queries, area.sql
