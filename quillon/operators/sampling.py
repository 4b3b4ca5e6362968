"""Sorting, sampling, repetition and shards. Draws are md5 numbers of a seed and a row's key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .sequences import draw


def seeded_order(seed: int, key: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def browse(df: DataFrame, *, score: list[str], key: str, find: str | None = None, text: str | None = None, mask: str | None = None, limit: int = 100, descending: bool = True) -> DataFrame:
    """Rows by the first score that is not null (else 0), those that hold a keyword, with a pattern masked."""
    s = F.coalesce(*[F.col(c).cast("double") for c in score], F.lit(0.0))
    out = df.withColumn("sort_score", s)
    if find is not None:
        out = out.filter(F.col(text).contains(find))
    if mask is not None:
        out = out.withColumn(text, F.regexp_replace(text, mask, "*"))
    return out.orderBy(F.desc("sort_score") if descending else F.asc("sort_score"), key).limit(limit)


def first_n(df: DataFrame, *, key: str, n: int) -> DataFrame:
    return df.orderBy(key).limit(n)


def sample_n(df: DataFrame, *, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows without replacement, or all: the first in the seeded order of their keys."""
    return df.orderBy(seeded_order(seed, key), key).limit(n)


def split_by_task(df: DataFrame, *, task: str, key: str, share: float = 2 / 3, seed: int = 42) -> DataFrame:
    """`split`: train for round(n share), half to even, rows of each task in seeded order, else test."""
    w = Window.partitionBy(task)
    rank = F.row_number().over(w.orderBy(seeded_order(seed, key), key))
    return df.withColumn("split", F.when(rank <= F.bround(F.count("*").over(w) * F.lit(share)), "train").otherwise("test"))


def running_totals(df: DataFrame, *, key: str, value: str, rows: int = 50_000) -> DataFrame:
    """`before` and `total`: sums of the values of all smaller keys and of all rows. Keys are unique.

    They are cut to ranges of about `rows` rows, as many as the table needs; a sum per range and one
    within it keep the work parallel. The rows are written with their range before either sum, so
    both go by the same borders: planned twice, Spark would sample them twice and cut elsewhere."""
    parts = max(1, -(-df.count() // rows))
    ranged = df.repartitionByRange(parts, key).withColumn("_p", F.spark_partition_id())
    ranged = written(ranged, "ranges")
    inner = Window.partitionBy("_p").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    sums = written(ranged.groupBy("_p").agg(F.sum(value).alias("_s")), "range-sums")
    order = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = sums.select("_p", F.coalesce(F.sum("_s").over(order), F.lit(0)).alias("_o"), F.sum("_s").over(Window.partitionBy()).alias("total"))
    placed = ranged.withColumn("_i", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return placed.join(offsets, "_p").withColumn("before", F.col("_o") + F.col("_i")).drop("_p", "_i", "_o")


def indexed(df: DataFrame, *, key: str, index: str = "i") -> DataFrame:
    """`index`: how many rows have a smaller key. Keys are unique."""
    return running_totals(df.withColumn("_one", F.lit(1).cast("long")), key=key, value="_one").withColumn(index, F.col("before").cast("long")).drop("_one", "before", "total")


def resample(df: DataFrame, *, key: str, score: str, n: int, method: str = "pow", power: float = 2.0, seed: int = 42) -> DataFrame:
    """n draws with replacement by weight: |score|^power, or those of max_min (1 at the largest and
    smallest score, else 0) or max_random (0.4 at the largest, else 0.1), plus 1e-8: (draw, row)."""
    ends = df.agg(F.max(score).alias("_max"), F.min(score).alias("_min"))
    s = F.col(score)
    weights = {"pow": F.pow(F.abs(s), power), "max_min": ((s == F.col("_max")) | (s == F.col("_min"))).cast("double"), "max_random": F.when(s == F.col("_max"), 0.4).otherwise(0.1)}
    if method not in weights:
        raise ValueError(f"unknown method {method}")
    weighted = df.crossJoin(F.broadcast(ends)).withColumn("_w", weights[method] + 1e-8).drop("_max", "_min")
    laid = running_totals(weighted, key=key, value="_w").withColumn("_from", F.col("before") / F.col("total")).withColumn("_to", (F.col("before") + F.col("_w")) / F.col("total"))
    cells = max(1, n)
    laid = laid.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_from") * cells), F.least(F.floor(F.col("_to") * cells) + 1, F.lit(cells - 1)))))
    draws = df.sparkSession.range(n).withColumnRenamed("id", "draw").withColumn("_u", draw(seed, F.col("draw"))).withColumn("_cell", F.floor(F.col("_u") * cells))
    # the last row that begins at or before the draw: one for each draw, however sums are rounded
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    found = draws.join(laid, "_cell").filter((F.col("_u") >= F.col("_from")) | (F.col("before") == 0)).groupBy("draw").agg(F.max_by(row, F.struct("_from", "before")).alias("_row"))
    return found.select("draw", "_row.*")


def repeat_rows(df: DataFrame, times: int | Column, *, index: str, interleave: bool = True) -> DataFrame:
    """Every row `times` times, with copy and position: copies side by side, or the whole table again and again."""
    each = F.when((F.lit(times) if isinstance(times, int) else times) > 0, F.sequence(F.lit(0), (F.lit(times) if isinstance(times, int) else times.cast("int")) - 1))
    out = df.withColumn("copy", F.explode(each))
    if not isinstance(times, int):
        return out
    if interleave:
        return out.withColumn("position", F.col(index) * times + F.col("copy"))
    n = df.agg(F.count("*").alias("_n"))
    return out.crossJoin(F.broadcast(n)).withColumn("position", F.col("copy") * F.col("_n") + F.col(index)).drop("_n")


def pad_to_divisor(df: DataFrame, *, index: str, divisor: int) -> DataFrame:
    """Rows from the front again until their number divides; `is_pad` marks them, and filtering it out unpads."""
    n = df.agg(F.count("*").alias("_n"))
    missing = F.pmod(-F.col("_n"), F.lit(divisor))
    sized = df.crossJoin(F.broadcast(n))
    turns = F.when(F.col(index) < missing, F.floor((missing - 1 - F.col(index)) / F.col("_n")) + 1).otherwise(0)
    pads = sized.filter(turns > 0).withColumn("_k", F.explode(F.sequence(F.lit(1), turns.cast("int")))).withColumn(index, F.col(index) + F.col("_n") * F.col("_k")).withColumn("is_pad", F.lit(True))
    return sized.withColumn("is_pad", F.lit(False)).unionByName(pads.drop("_k")).drop("_n")


def batches(df: DataFrame, *, index: str, size: int | None = None, parts: int | None = None) -> DataFrame:
    """`batch`: index over size, or one of `parts` equal chunks; a number of rows that does not divide into parts raises."""
    if size:
        return df.withColumn("batch", F.floor(F.col(index) / size))
    n = df.agg(F.count("*").alias("_n"))
    sized = df.crossJoin(F.broadcast(n))
    ok = F.when(F.col("_n") % parts == 0, F.floor(F.col(index) * parts / F.col("_n"))).otherwise(F.raise_error(F.lit("the rows do not divide into that many parts")))
    return sized.withColumn("batch", ok).drop("_n")


def fold(df: DataFrame, *, group: Column, order: list[str], values: list[str]) -> DataFrame:
    """Rows of a group as one row with an array of structs, in order."""
    return df.groupBy(group.alias("group")).agg(F.array_sort(F.collect_list(F.struct(*order, *[v for v in values if v not in order]))).alias("items"))


def unfold(df: DataFrame) -> DataFrame:
    return df.select("group", F.explode("items").alias("i")).select("group", "i.*")


def workload(length: Column) -> Column:
    """Cost of a sequence: 24576 per token and its square."""
    return length * 24576 + length * length


def balanced_shards(df: DataFrame, *, group: str, length: str, shards: int, rows_per_range: int = 50_000) -> DataFrame:
    """(group, n_rows, tokens, workload, shard): whole groups dealt back and forth by falling workload, so
    shards differ by little. The rank is one within ranges of workload plus the rows of heavier ranges."""
    rows = df.groupBy(group).agg(F.count("*").alias("n_rows"), F.sum(length).alias("tokens"), F.sum(workload(F.col(length))).alias("workload"))
    rows = rows.withColumn("_one", F.lit(1)).withColumn("_key", F.struct((-F.col("workload")).alias("w"), F.col(group).alias("g")))
    ranked = running_totals(rows, key="_key", value="_one", rows=rows_per_range)
    turn, place = F.floor(F.col("before") / shards), F.col("before") % shards
    return ranked.withColumn("shard", F.when(turn % 2 == 0, place).otherwise(shards - 1 - place).cast("int")).drop("_one", "_key", "before", "total")


def imbalance(sharded: DataFrame, *, load: str) -> DataFrame:
    """One row: smallest, largest, spread and mean of the shards' loads."""
    return sharded.groupBy("shard").agg(F.sum(load).alias("s")).agg(F.min("s").alias("min"), F.max("s").alias("max"), (F.max("s") - F.min("s")).alias("diff"), F.avg("s").alias("mean"))


def token_budget_shards(df: DataFrame, *, key: str, length: str, budget: int, least: int = 1, multiple: int = 1, strict: bool = True) -> DataFrame:
    """Balanced shards, as many as the tokens need at `budget` each, no fewer than `least`, rounded up to a
    multiple and not more than there are rows. A row beyond the budget raises; without `strict` it is dealt
    like any other, whole, and its shard is that much larger."""
    row = df.agg(F.count("*").alias("n"), F.sum(length).alias("t"), F.max(length).alias("m")).first()
    if strict and (row.m or 0) > budget:
        raise ValueError(f"a row has {row.m} tokens, more than the budget of {budget}")
    k = max(least, min(row.n, -(-(row.t or 0) // budget)))
    return balanced_shards(df, group=key, length=length, shards=max(1, -(-k // multiple) * multiple))


def restore_order(df: DataFrame, *, index: str) -> DataFrame:
    return df.orderBy(index)


def worker_shard(index: Column, workers: int) -> Column:
    return F.pmod(index, F.lit(workers))


def top_covariance(tokens: DataFrame, *, a: str, b: str, mask: str, ratio: float, order: list[str]) -> DataFrame:
    """The max(1, int(n ratio)) masked tokens of largest (a - mean a)(b - mean b), marked by `covariance`."""
    on = tokens.filter(mask)
    row = on.agg(F.avg(a).alias("a"), F.avg(b).alias("b"), F.count("*").alias("n")).first()
    k = max(1, int(row.n * ratio))
    cov = (F.col(a) - F.lit(row.a)) * (F.col(b) - F.lit(row.b))
    return on.withColumn("covariance", cov).orderBy(F.desc("covariance"), *order).limit(k)


def clip_covariance(tokens: DataFrame, *, a: str, b: str, mask: str, ratio: float, low: float, high: float, order: list[str], seed: int = 42, clipped: str | None = None) -> DataFrame:
    """max(1, int(n ratio)) masked tokens, drawn in seeded order from those whose (a - mean a)(b - mean b) lies
    inside (low, high) and that are not clipped already, marked by `covariance`; all of these if they are fewer."""
    on = tokens.filter(mask)
    row = on.agg(F.avg(a).alias("a"), F.avg(b).alias("b"), F.count("*").alias("n")).first()
    cov = (F.col(a) - F.lit(row.a)) * (F.col(b) - F.lit(row.b))
    inside = on.withColumn("covariance", cov).filter((F.col("covariance") > low) & (F.col("covariance") < high))
    if clipped:
        inside = inside.filter(~F.coalesce(F.col(clipped), F.lit(False)))
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in order]))
    return inside.orderBy(drawn, *order).limit(max(1, int(row.n * ratio)))
