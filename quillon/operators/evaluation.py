"""Scores of rollouts summed up per row, data source and report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import parts_for, written
from .resampling import majority_at


def offline_evaluation(responses: DataFrame, *, row: str | Column, source: str | Column, score: Column) -> DataFrame:
    """One row per response -> test_score per data source: the mean of each row's responses
    counts once, however many there are. Null scores count in no mean."""
    per_row = responses.groupBy(F.col(row) if isinstance(row, str) else row, (F.col(source) if isinstance(source, str) else source).alias("data_source")).agg(F.avg(score).alias("row_score"))
    return per_row.groupBy("data_source").agg(F.avg("row_score").alias("test_score"), F.count("*").alias("n_rows"))


def evaluation_summary(records: DataFrame, *, score: str, correct: str, error: str, usage: dict[str, str], by: str | None = None) -> DataFrame:
    """attempted, completed (no error), correct and accuracy among completed rows with a score, average
    score, failed, and the mean of each usage column over completed rows, null counting as 0. With
    `by`, a row per value and one over all, where that column is null. Nothing gives 0.0."""
    done = F.col(error).isNull()
    scored = done & F.col(score).isNotNull()
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0)).cast("double")
    hits = F.count_if(scored & F.col(correct))
    measures = [
        F.count("*").alias("attempted"), F.count_if(done).alias("completed"), hits.alias("correct"), ratio(hits, F.count_if(scored)).alias("accuracy"),
        F.coalesce(F.avg(F.when(scored, F.col(score))), F.lit(0.0)).alias("average_score"), F.count_if(~done).alias("failed"),
        *[F.coalesce(F.avg(F.when(done, F.coalesce(F.col(c), F.lit(0)))), F.lit(0.0)).alias(n) for n, c in usage.items()]]
    return records.rollup(by).agg(*measures) if by else records.agg(*measures)


def call_usage(df: DataFrame, *, calls: str, kind: str = "kind", frames: str = "frames") -> DataFrame:
    """visual_calls, llm_calls and total_frames of an array of call structs."""
    of = lambda k: F.size(F.filter(calls, lambda x: x[kind] == k)).cast("long")
    total = F.aggregate(calls, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x[frames].cast("long"), F.lit(0)))
    return df.withColumns({"visual_calls": of("visual"), "llm_calls": of("llm"), "total_frames": total})


def outcome_report(samples: DataFrame, *, outcome: str, by: str | None = None, sets: list[str] | None = None) -> DataFrame:
    """Counts of first_try, corrected, failed and skipped, and rates among those attempted (at least
    1 is divided by). `by` adds a total row; `sets` groups by each of several columns in one pass,
    with a total, told apart by `grouping`."""
    of = lambda x: F.count_if(F.col(outcome) == x)
    n = F.count("*")
    attempted = F.greatest(n - of("skipped"), F.lit(1))
    measures = [n.alias("total"), *[of(x).alias(x) for x in ("first_try", "corrected", "failed", "skipped")], (of("first_try") / attempted).alias("first_try_rate"), ((of("first_try") + of("corrected")) / attempted).alias("success_rate")]
    if sets:
        cols = [F.col(c) for c in sets]
        return samples.groupingSets([[c] for c in cols] + [[]], *cols).agg(F.grouping_id().alias("grouping"), *measures)
    return (samples.rollup(by) if by else samples.groupBy()).agg(*measures)


def best_and_worst(values: DataFrame, *, keys: list[str], value: str, n: Column) -> DataFrame:
    """Mean and deviation of the largest and smallest of n draws with replacement from each group:
    over sorted values, the i-th of N is the largest with probability (i/N)^n - ((i-1)/N)^n. `n` may
    be an array column: one row for each of its numbers."""
    values = values.repartition(parts_for(values), *keys)
    w = Window.partitionBy(*keys)
    up = values.withColumn("_n", n).withColumn("_i", F.row_number().over(w.orderBy(value))).withColumn("_size", F.count("*").over(w))
    up = up.withColumn("n", F.explode("_n"))
    top = F.pow(F.col("_i") / F.col("_size"), F.col("n")) - F.pow((F.col("_i") - 1) / F.col("_size"), F.col("n"))
    low = F.pow((F.col("_size") - F.col("_i") + 1) / F.col("_size"), F.col("n")) - F.pow((F.col("_size") - F.col("_i")) / F.col("_size"), F.col("n"))
    v = F.col(value)
    out = up.groupBy(*keys, "n").agg(F.sum(v * top).alias("best_mean"), F.sum(v * v * top).alias("_b2"), F.sum(v * low).alias("worst_mean"), F.sum(v * v * low).alias("_w2"))
    std = lambda m, s: F.sqrt(F.greatest(F.col(s) - F.col(m) * F.col(m), F.lit(0.0)))
    return out.select(*keys, F.col("n").cast("long").alias("n"), "best_mean", std("best_mean", "_b2").alias("best_std"), "worst_mean", std("worst_mean", "_w2").alias("worst_std"))


def bootstrap(values: DataFrame, *, keys: list[str], value: str, order: list[str], size: int, reducer: Column, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """Mean and population deviation of any aggregate over `rounds` resamples of `size` draws with
    replacement from each group. `reducer` is an aggregate over the column `drawn`. Draws are
    md5 numbers of seed, keys, round and draw. Groups may be of any size, a draw is a row: for many small
    groups see `resampling.resampled`."""
    indexed = values.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, value)) - 1)
    sizes = indexed.groupBy(*keys).agg(F.count("*").alias("_size"))
    draws = sizes.select("*", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("_round")).select("*", F.explode(F.sequence(F.lit(1), F.lit(size))).alias("_draw"))
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], F.col("_round").cast("string"), F.col("_draw").cast("string"))
    draws = draws.withColumn("_k", F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % F.col("_size"))
    taken = draws.join(indexed.select(*keys, "_k", F.col(value).alias("drawn")), [*keys, "_k"])
    return taken.groupBy(*keys, "_round").agg(reducer.alias("_r")).groupBy(*keys).agg(F.avg("_r").alias("mean"), F.stddev_pop("_r").alias("std"))


def majority(votes: DataFrame, *, keys: list[str], vote: str, value: str, pos: list[str]) -> DataFrame:
    """The value that comes first under the most frequent vote; of equally frequent, the vote that came first."""
    per = votes.groupBy(*keys, vote).agg(F.count("*").alias("n"), F.min(F.struct(*pos, value)).alias("first"))
    best = per.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), "first", vote)).alias("b"))
    return best.select(*keys, F.col(f"b.{vote}").alias("majority_vote"), F.col(f"b.first.{value}").alias("majority_value"), (-F.col("b.n")).alias("n_votes"))


def ladder(n: Column) -> Column:
    """2, 4, 8, ... below n, then n."""
    steps = F.filter(F.array(*[F.lit(2**k) for k in range(1, 31)]), lambda x: x < n)
    return F.when(n > 1, F.concat(steps, F.array(n.cast("int")))).otherwise(F.array().cast("array<int>"))


def validation_metrics(samples: DataFrame, *, source: str, uid: str, variables: list[str], vote: str | None = None) -> DataFrame:
    """(source, variable, metric, value): mean@N, std@N (population, N > 1), best@n and worst@n and, with a
    column of votes, maj@n, each with its deviation, for n on the ladder, per prompt and then over the prompts
    of a source. best, worst and maj are exact: what resampling tends to."""
    more = [vote] if vote and vote not in (source, uid) else []
    keys = [source, uid, "variable"]
    long = written(samples.select(source, uid, *more, *variables), "samples").unpivot([source, uid, *more], variables, "variable", "x")
    long = long.repartition(parts_for(long), *keys)
    size = F.count("*").over(Window.partitionBy(*keys))
    stats = long.groupBy(*keys).agg(F.avg("x").alias("mean"), F.when(F.count("*") > 1, F.stddev_pop("x")).alias("std"), F.count("*").alias("n"))
    plain = stats.select(source, "variable", F.explode(F.array(*[F.struct(F.concat(F.lit(f"{m}@"), "n").alias("metric"), F.col(m).alias("value")) for m in ("mean", "std")])).alias("s"))
    every = [plain]

    def ranked(of_n: DataFrame, names: dict[str, str]) -> None:
        metric = lambda c: F.concat(F.lit(names[c] + "@"), F.col("n").cast("string"), F.lit("/" + c.split("_")[1]))
        every.append(of_n.select(source, "variable", F.explode(F.array(*[F.struct(metric(c).alias("metric"), F.col(c).alias("value")) for c in names])).alias("s")))

    ranked(best_and_worst(long, keys=keys, value="x", n=ladder(size)), {f"{k}_{m}": k for k in ("best", "worst") for m in ("mean", "std")})
    if vote:
        ranked(majority_at(long, keys=keys, vote=vote, value="x", n=ladder(F.col("size"))), {"maj_mean": "maj", "maj_std": "maj"})
    found = reduce(DataFrame.unionByName, every).select(source, "variable", "s.metric", "s.value").filter("value is not null")
    return found.groupBy(source, "variable", "metric").agg(F.avg("value").alias("value"))


def metric_sections(metrics: DataFrame, *, source: str) -> DataFrame:
    """`name`: val-core for the source's core variable (acc if it has one, else reward) at its largest
    n and a mean@, maj@ or best@ metric's mean, else val-aux."""
    w = Window.partitionBy(source)
    n = F.regexp_extract("metric", r"@(\d+)", 1).cast("int")
    core = F.when(F.max((F.col("variable") == "acc").cast("int")).over(w) == 1, "acc").otherwise("reward")
    largest = F.max(n).over(Window.partitionBy(source, "variable"))
    is_core = (F.col("variable") == core) & (n == largest) & F.col("metric").rlike("^(mean@|maj@.*mean|best@.*mean)")
    section = F.when(is_core, "val-core").otherwise("val-aux")
    return metrics.withColumn("name", F.concat_ws("/", section, source, "variable", "metric"))


def reduce_metrics(values: DataFrame, *, name: str, value: str) -> DataFrame:
    """One value per metric: names with max take the maximum, else with min the minimum, else the mean."""
    how = F.when(F.col(name).contains("max"), F.max(value)).when(F.col(name).contains("min"), F.min(value)).otherwise(F.avg(value))
    return values.groupBy(name).agg(how.alias("value"))


def aggregation_kind(name: Column, rules: dict[str, str] | None = None) -> Column:
    """How a metric is rolled up: by rule, else by the first keyword that its name holds."""
    low = F.lower(name)
    kinds = [("time_sum", "timing_s/"), ("avg", "mean|avg|average"), ("max", "max|maximum"), ("min", "min|minimum"), ("sum", "sum|total")]
    out = F.when(F.lit(False), "")
    for metric, kind in (rules or {}).items():
        out = out.when(name == metric, kind)
    for kind, words in kinds:
        out = out.when(low.rlike(words), kind)
    return out.otherwise("avg")


def rollup_steps(values: DataFrame, *, name: str, step: str, value: str, count: str, rules: dict[str, str] | None = None, by: list[str] | None = None) -> DataFrame:
    """One value per metric over many steps: last, weighted_avg by sample count, sum, time_sum, avg, max or min."""
    kind = aggregation_kind(F.col(name), rules)
    weighted = F.coalesce(F.try_divide(F.sum(F.col(value) * F.col(count)), F.sum(count)), F.avg(value))
    forms = {"last": F.max_by(value, step), "weighted_avg": weighted, "sum": F.sum(value), "time_sum": F.sum(value), "max": F.max(value), "min": F.min(value)}
    out = F.avg(value)
    for k, form in forms.items():
        out = F.when(F.first("_kind") == k, form).otherwise(out)
    return values.withColumn("_kind", kind).groupBy(*(by or []), name).agg(F.first("_kind").alias("kind"), out.alias("value"))


def derived_metrics(rolled: DataFrame, *, name: str, gpus: int) -> DataFrame:
    """One row: spread of sequence lengths, throughput per GPU and idle ratio, from rolled-up metrics."""
    of = lambda n: F.max(F.when(F.col(name) == n, F.col("value")))
    return rolled.agg((of("global_seqlen/max") - of("global_seqlen/min")).alias("minmax_diff"), F.try_divide(of("perf/total_num_tokens"), of("perf/time_per_step") * gpus).alias("throughput"), F.try_divide(of("timing_s/gen"), of("timing_s/step")).alias("idle_ratio"))


def exact_percentiles(df: DataFrame, *, value: str, by: list[str], quantiles: list[float], accuracy: int = 10_000) -> DataFrame:
    """(by, p0, p1, ...): percentiles interpolated between neighbours, exact, of groups of any size.

    A sketch, merged from all tasks, names for each quantile two values between which it must lie: its rank error is
    bounded. One more pass counts what is below and, value by value, what lies between, so of a group only a
    share of about 20 / accuracy of its values meets in one task, or at most `accuracy` of them. Nulls are left out."""
    cut = [min(1.0, max(0.0, q + d / accuracy)) for q in quantiles for d in (-8, 8)]
    sketch = F.percentile_approx(value, F.array(*map(F.lit, cut)), F.lit(accuracy))
    ends = F.array_repeat(F.array(F.min(value), F.max(value)), len(quantiles))  # of few values all are counted
    marks = df.groupBy(*by).agg(F.count(value).alias("_n"), F.when(F.count(value) > accuracy, sketch).otherwise(F.flatten(ends)).alias("_cut"))
    v, low, high = F.col(value), (lambda i: F.col("_cut")[2 * i]), (lambda i: F.col("_cut")[2 * i + 1])
    at = range(len(quantiles))
    inside = F.lit(False)
    for i in at:
        inside = inside | v.between(low(i), high(i))
    rows = df.filter(v.isNotNull()).join(marks, by) if by else df.filter(v.isNotNull()).crossJoin(F.broadcast(marks))
    seen = rows.groupBy(*by, F.when(inside, v).alias("_v")).agg(F.first("_n").alias("_n"), F.first("_cut").alias("_cut"), F.count("*").alias("_c"), *[F.count_if(v < low(i)).alias(f"_b{i}") for i in at])
    order = Window.partitionBy(*by)
    seen = seen.withColumns({f"_b{i}": F.sum(f"_b{i}").over(order) for i in at})
    picked = []
    for i, q in enumerate(quantiles):
        here = F.coalesce(F.col("_v").between(low(i), high(i)), F.lit(False))
        upto = F.col(f"_b{i}") + F.sum(F.when(here, F.col("_c")).otherwise(0)).over(order.orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        rank = F.lit(q) * (F.col("_n") - 1)
        on = lambda r, here=here, upto=upto: F.when(here & (r < upto) & (r >= upto - F.col("_c")), F.col("_v"))
        picked += [on(F.floor(rank)).alias(f"_f{i}"), on(F.ceil(rank)).alias(f"_t{i}"), (rank - F.floor(rank)).alias(f"_s{i}")]
    found = seen.select(*by, *picked).groupBy(*by).agg(*[f(f"_{c}{i}").alias(f"_{c}{i}") for i in at for c, f in (("f", F.max), ("t", F.max), ("s", F.first))])
    exact = lambda i: F.coalesce(F.col(f"_f{i}") + (F.col(f"_t{i}") - F.col(f"_f{i}")) * F.col(f"_s{i}"), F.raise_error(F.lit("a percentile is outside of its bounds")).cast("double"))
    return found.select(*by, *[exact(i).cast("double").alias(f"p{i}") for i in at])


def time_statistics(df: DataFrame, *, value: str, by: list[str] | None = None, exact: bool = True) -> DataFrame:
    """avg, max, min and the 50th, 95th and 99th percentile, interpolated; `exact=False` takes a sketch's."""
    by, names, quantiles = by or [], ["tp50", "tp95", "tp99"], [0.5, 0.95, 0.99]
    plain = [F.avg(value).alias("avg"), F.max(value).alias("max"), F.min(value).alias("min")]
    if not exact:
        return df.groupBy(*by).agg(*plain, *[F.percentile_approx(value, q).cast("double").alias(n) for n, q in zip(names, quantiles)])
    marked = exact_percentiles(df, value=value, by=by, quantiles=quantiles).withColumnsRenamed({f"p{i}": n for i, n in enumerate(names)})
    rest = df.groupBy(*by).agg(*plain)
    if not by:
        return rest.crossJoin(F.broadcast(marked)) if not df.filter(F.col(value).isNotNull()).isEmpty() else rest.select("*", *[F.lit(None).cast("double").alias(n) for n in names])
    return rest.join(marked, by, "left")


def version_statistics(df: DataFrame, *, start: str, end: str) -> DataFrame:
    """One row: rollouts over more than one version, their share, the widest span and how many versions there are."""
    part = F.col(end) > F.col(start)
    return df.agg(F.count_if(part).alias("partial"), (F.count_if(part) / F.greatest(F.count("*"), F.lit(1))).alias("partial_ratio"), F.max(F.col(end) - F.col(start)).alias("max_span"), F.count_distinct(end).alias("versions"))


def slowest(df: DataFrame, *, parts: list[str], keep: list[str], order: list[str]) -> DataFrame:
    """One row: min, max and mean of each part, and what is kept of the row whose parts sum to most (the first of equals)."""
    total = F.col(parts[0])
    for p in parts[1:]:
        total = total + F.col(p)
    stats = [f(p).alias(f"{p}_{n}") for p in parts for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    top = F.min_by(F.struct(*keep, *parts), F.struct((-total).alias("t"), *order)).alias("slow")
    return df.agg(*stats, top).select("*", *[F.col(f"slow.{k}").alias(f"slowest_{k}") for k in [*keep, *parts]]).drop("slow")


def step_metrics(tokens: DataFrame, *, seq: str, mask: str, score: str, reward: str, advantage: str, returns: str, value: str, limit: int) -> DataFrame:
    """One row about a step: score and reward per sequence (those without masked tokens are aborted and
    left out), advantage, return and value over masked tokens, explained variance
    1 - var(returns - value) / (var(returns) + 1e-5), lengths and the share at `limit`. If every
    sequence is aborted, it raises."""
    three = lambda n, c: [F.avg(c).alias(f"{n}_mean"), F.max(c).alias(f"{n}_max"), F.min(c).alias(f"{n}_min")]
    seqs = tokens.groupBy(seq).agg(F.sum(F.when(F.col(mask), F.col(score))).alias("s"), F.sum(F.when(F.col(mask), F.col(reward))).alias("r"), F.count_if(mask).alias("n"))
    live = F.col("n") > 0
    whole = seqs.agg(
        *three("score", F.when(live, F.col("s"))), *three("reward", F.when(live, F.col("r"))), *three("response_length", F.col("n")), *three("response_length_non_aborted", F.when(live, F.col("n"))),
        F.avg((F.col("n") == limit).cast("double")).alias("response_length_clip_ratio"), F.avg((~live).cast("double")).alias("aborted_ratio"))
    whole = whole.withColumn("aborted_ratio", F.when(F.col("aborted_ratio") == 1, F.raise_error(F.lit("all samples are aborted"))).otherwise(F.col("aborted_ratio")))
    on = tokens.filter(mask)
    gap = F.col(returns) - F.col(value)
    return whole.crossJoin(on.agg(*three("advantage", F.col(advantage)), *three("returns", F.col(returns)), *three("values", F.col(value)), (1 - F.var_samp(gap) / (F.var_samp(returns) + 1e-5)).alias("explained_var")))


def timing_per_token(timings: DataFrame, tokens: Column, *, name: str, seconds: str, response_tokens: Column) -> DataFrame:
    """ms_per_token of each stage: generation by response tokens, other known stages by all tokens."""
    known = ["gen", "ref", "values", "adv", "update_critic", "update_actor"]
    by = F.when(F.col(name) == "gen", response_tokens).when(F.col(name).isin(known), tokens)
    return timings.withColumn("ms_per_token", F.col(seconds) * 1000 / by)


def rubric_total(rows: DataFrame, *, text: str) -> DataFrame:
    """One row: true coverage and correctness over twice the rubric points of all rows whose text holds a JSON object with those arrays."""
    schema = "coverage array<boolean>, correctness array<boolean>"
    parsed = rows.select(F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), schema).alias("j")).filter("j.coverage is not null and j.correctness is not null")
    true = lambda c: F.size(F.filter(f"j.{c}", lambda x: x))
    got, most = F.sum(true("coverage") + true("correctness")), F.sum(F.size("j.coverage") + F.size("j.correctness"))
    return parsed.agg(got.cast("long").alias("points"), most.cast("long").alias("max_points"), F.coalesce(F.try_divide(got, most), F.lit(0.0)).alias("ratio"))


def table_profile(df: DataFrame) -> DataFrame:
    """(column, type, n_rows, n_null, avg_size) per column, in one aggregate."""
    aggs = [F.count("*").alias("_n")]
    for k, f in enumerate(df.schema):
        size = F.octet_length(F.col(f"`{f.name}`").cast("string"))
        aggs += [F.count_if(F.col(f"`{f.name}`").isNull()).alias(f"_null{k}"), F.avg(size).alias(f"_size{k}")]
    one = df.agg(*aggs)
    cols = F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col("_n").alias("n_rows"), F.col(f"_null{k}").alias("n_null"), F.col(f"_size{k}").alias("avg_size")) for k, f in enumerate(df.schema)])
    return one.select(F.explode(cols).alias("c")).select("c.*")


def distributed_stats(df: DataFrame, *, value: str, mask: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """mean, max, min, sample deviation over all workers' rows and masked_mean, the mean over rows whose mask is
    true; in all or per `by`. Partial aggregates take the place of an all-reduce."""
    on = F.lit(True) if mask is None else F.coalesce(mask, F.lit(False))
    aggregates = [F.avg(value).alias("mean"), F.max(value).alias("max"), F.min(value).alias("min"), F.stddev_samp(value).alias("std"), F.avg(F.when(on, F.col(value))).alias("masked_mean")]
    return (df.groupBy(*by) if by else df).agg(*aggregates)


def stage_coverage(rows: DataFrame, *, key: str, entity: str, stage: str, covered_by: str | int, flags: dict[str, str | int]) -> DataFrame:
    """Per key the distinct entities that a stage has seen, how many they are, and for each name in `flags`
    whether its stage occurs at all."""
    seen = F.collect_set(F.when(F.col(stage) == F.lit(covered_by), F.col(entity)))
    there = [F.coalesce(F.bool_or(F.col(stage) == F.lit(v)), F.lit(False)).alias(name) for name, v in flags.items()]
    return rows.groupBy(key).agg(F.array_sort(seen).alias("entities"), *there).withColumn("covered", F.size("entities").cast("long"))


def task_accuracy(rows: DataFrame, *, by: list[str], correct: Column) -> DataFrame:
    """Per task attempted, correct and accuracy in percent: rows whose verdict is null were skipped and stay in
    the denominator."""
    right = F.count_if(F.coalesce(correct, F.lit(False)))
    return rows.groupBy(*by).agg(F.count("*").alias("attempted"), right.alias("correct"), (right / F.count("*") * 100).alias("accuracy"))


def prefixed(name: Column, prefix: str) -> Column:
    """The name with the prefix, unless it has it already."""
    return F.when(F.startswith(name, F.lit(prefix)), name).otherwise(F.concat(F.lit(prefix), name))


def merged_metrics(*tables: DataFrame, name: str, value: str) -> DataFrame:
    """One row per name over all tables; a name to which they give unlike values is an error."""
    rows = reduce(lambda a, b: a.unionByName(b), tables).groupBy(name).agg(F.count_distinct(F.struct(value)).alias("_n"), F.first(value).alias(value))
    same = F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unlike values for "), F.col(name).cast("string"))))
    return rows.filter(same).select(name, value)


def appended(rows: DataFrame, *, name: str, value: str, order: list[str], prefix: str = "") -> DataFrame:
    """(name, values): all values of each prefixed name in order; values that are lists are put one behind the other."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))), lambda x: x["_v"])
    if rows.schema[value].dataType.typeName() == "array":
        items = F.flatten(items)
    return rows.groupBy(prefixed(F.col(name), prefix).alias(name)).agg(items.alias("values"))
