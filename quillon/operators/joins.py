"""Lookups, range and nearest joins, order comparison and top-k retrieval as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .retrieval import bm25_top_k, dense_top_k, tokens  # noqa: F401
from .sampling import indexed

def lookup(rows: DataFrame, reference: DataFrame, on: str) -> DataFrame:
    """Every row with what the reference says under its key; null where it says nothing."""
    return rows.join(reference, on, "left")


def not_done(samples: DataFrame, done: DataFrame, *, key: str) -> DataFrame:
    """Rows whose key, trimmed and as text, is not among those done."""
    keys = done.select(F.trim(F.col(key).cast("string")).alias("_k")).distinct()
    return samples.join(keys, F.trim(F.col(key).cast("string")) == F.col("_k"), "left_anti")


def only_listed(rows: DataFrame, ids: DataFrame, *, key: str) -> DataFrame:
    return rows.join(ids.select(key), key, "left_semi")


def override(base: DataFrame, audit: DataFrame, *, key: str) -> DataFrame:
    """Attributes of both; where both name a column, the audit's value if it has one."""
    shared = [c for c in audit.columns if c != key and c in base.columns]
    renamed = audit.withColumnsRenamed({c: f"_audit_{c}" for c in shared})
    out = base.join(renamed, key, "left")
    return out.withColumns({c: F.coalesce(f"_audit_{c}", c) for c in shared}).drop(*[f"_audit_{c}" for c in shared])


def union_columns(left: DataFrame, right: DataFrame, *, key: str) -> DataFrame:
    """Columns of both tables, row by row of a unique key. A row that one side lacks, or a shared
    column that differs, raises when it is read."""
    shared = [c for c in right.columns if c != key and c in left.columns]
    a = left.withColumn("_a", F.lit(True))
    b = right.withColumnsRenamed({c: f"_r_{c}" for c in shared}).withColumn("_b", F.lit(True))
    same = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    for c in shared:
        same = same & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    out = a.join(b, key, "full_outer").filter(F.when(same, True).otherwise(F.raise_error(F.lit("the tables differ in a row or a shared column"))))
    return out.drop("_a", "_b", *[f"_r_{c}" for c in shared])


def range_join(points: DataFrame, intervals: DataFrame, *, on: list[str], at: str, start: str, end: str, width: float) -> DataFrame:
    """Points inside intervals of equal keys, both ends included. Both sides are cut to buckets of
    `width`, so the join is on equal keys; an interval is repeated once per bucket that it touches."""
    bucket = lambda c: F.floor(F.col(c) / width)
    cut = intervals.withColumn("_bucket", F.explode(F.sequence(bucket(start), bucket(end))))
    return points.withColumn("_bucket", bucket(at)).join(cut, [*on, "_bucket"]).filter(F.col(at).between(F.col(start), F.col(end))).drop("_bucket")


def nearest(left: DataFrame, right: DataFrame, *, by: list[str], left_at: str, right_at: str, value: str, out: str = "nearest", width: float | None = None) -> DataFrame:
    """Left rows with the right row of equal keys whose time is nearest; of two equally near, the
    earlier. Each different time of a key is looked up once, in one union and two running windows, and left rows
    take the answer by key and time: no pairs. With `width`, times are cut to buckets so that a key
    with many times is many windows; what a bucket does not hold itself, its neighbours' edges give.

    Both windows run from their start to the current row, one by rising and one by falling time: Spark adds to such
    a frame row by row, but goes through the rest of the rows anew for each row of one that ends with the partition."""
    bucket = (F.floor(F.col("_t") / width) if width else F.lit(0)).cast("long").alias("_bucket")
    keep = F.struct(F.col(right_at).alias("at"), F.col(value).alias("value"))
    r = right.groupBy(*by, right_at).agg(F.min(value).alias(value)).select(*by, F.col(right_at).alias("_t"), keep.alias("_r"), F.lit(False).alias("_asked"))
    asked = left.select(*by, F.col(left_at).alias("_t")).distinct().select("*", F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), F.lit(True).alias("_asked"))
    both = asked.unionByName(r).select("*", bucket)
    here = [*by, "_bucket"]
    # one row a bucket: the right rows next to it on either side
    order = Window.partitionBy(*by)
    edges = both.groupBy(*here).agg(F.max_by("_r", F.when(F.col("_r").isNotNull(), F.col("_t"))).alias("_hi"), F.min_by("_r", F.when(F.col("_r").isNotNull(), F.col("_t"))).alias("_lo"))
    past = lambda c: F.last(c, ignorenulls=True)
    up, down = order.orderBy("_bucket"), order.orderBy(F.desc("_bucket"))
    edges = edges.select(*here, past("_hi").over(up.rowsBetween(Window.unboundedPreceding, -1)).alias("_p"), past("_lo").over(down.rowsBetween(Window.unboundedPreceding, -1)).alias("_q"))
    w, so_far = Window.partitionBy(*here), (Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_b", past("_r").over(w.orderBy("_t").rangeBetween(*so_far))).withColumn("_a", past("_r").over(w.orderBy(F.desc("_t")).rangeBetween(*so_far)))
    found = found.filter("_asked").join(edges, here).withColumns({"_b": F.coalesce("_b", "_p"), "_a": F.coalesce("_a", "_q")})
    near = F.when(F.col("_a").isNull() | (F.col("_t") - F.col("_b.at") <= F.col("_a.at") - F.col("_t")), F.col("_b")).otherwise(F.col("_a"))
    found = found.select(*[F.col(c).alias(f"_by_{c}") for c in by], "_t", near.alias("_n"))
    rows = left.join(found, [F.col(left_at) == F.col("_t"), *[F.col(c) == F.col(f"_by_{c}") for c in by]])
    return rows.select(*left.columns, F.col("_n.at").alias(f"{out}_at"), F.col("_n.value").alias(out))


def flipped_pairs(orders: DataFrame, *, sample: str, item: str, old: str, new: str) -> DataFrame:
    """Item pairs of a sample whose order differs between two rankings: (sample, first, second) in the new order."""
    a = orders.select(sample, F.col(item).alias("first"), F.col(old).alias("_o1"), F.col(new).alias("_n1"))
    b = orders.select(sample, F.col(item).alias("second"), F.col(old).alias("_o2"), F.col(new).alias("_n2"))
    return a.join(b, sample).filter("_n1 < _n2 and _o1 > _o2").select(sample, "first", "second")


def uncovered(pairs: DataFrame, witnesses: DataFrame, *, sample: str) -> DataFrame:
    """Pairs that no witness pair names, in either direction."""
    norm = [F.least("first", "second").alias("_x"), F.greatest("first", "second").alias("_y")]
    w = witnesses.select(sample, *norm).distinct()
    return pairs.select("*", *norm).join(w, [sample, "_x", "_y"], "left_anti").select(sample, "first", "second")


def mention_owner(df: DataFrame, *, text: str, ids: str, times: str) -> DataFrame:
    """Each time mention of a text goes to the nearest id mention by character position, the earlier
    of two; an id that gets exactly one time keeps it: (…, id, time)."""
    def mentions(pattern: str) -> Column:
        parts = F.split(text, f"(?={pattern})(?<!\\d)")
        lengths = F.transform(parts, F.length)
        starts = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.aggregate(F.slice(lengths, 1, k), F.lit(0), lambda a, v: a + v))
        found = F.zip_with(parts, starts, lambda p, s: F.struct(s.alias("at"), F.regexp_extract(p, f"^({pattern})", 1).alias("name")))
        return F.filter(found, lambda m: m["name"] != "")

    both = df.withColumn("_ids", mentions(ids)).withColumn("_times", mentions(times))
    near = F.transform("_times", lambda t: F.struct(t["name"].alias("time"), F.array_min(F.transform("_ids", lambda i: F.struct(F.abs(i["at"] - t["at"]).alias("gap"), i["at"].alias("at"), i["name"].alias("id"))))["id"].alias("id")))
    out = both.withColumn("_m", F.explode(near)).select(*df.columns, "_m.*").filter("id is not null")
    return out.withColumn("_n", F.count("*").over(Window.partitionBy(*[c for c in df.columns if c != text], "id"))).filter("_n = 1").drop("_n", text)


def reference_views(objects: DataFrame, views: DataFrame, tracks: DataFrame, *, scene: str, obj: str, view: str) -> DataFrame:
    """Every reference object in every view, with its track there if it has one."""
    return objects.crossJoin(F.broadcast(views)).join(tracks, [scene, view, obj], "left")


def parameter_matrix(*axes: DataFrame, order: list[str], quota: int | None = None) -> DataFrame:
    """All combinations of parameter tables, numbered from 1 in order, the columns of the first axis foremost; a
    quota beyond their number goes round again.

    Each axis is ranked alone. A number tells the ranks by division, like the digits of a clock, so the
    rows are looked up by equal ranks: nothing is multiplied out and no order is taken over all combinations."""
    spark = axes[0].sparkSession
    ranked, sizes = [], []
    for k, axis in enumerate(axes):
        own = F.struct(*[c for c in order if c in axis.columns], *[c for c in axis.columns if c not in order])
        rows = written(indexed(axis.withColumn("_order", F.struct(own, F.monotonically_increasing_id())), key="_order", index=f"_r{k}").drop("_order"), "axis")
        ranked.append(rows)
        sizes.append(rows.count())
    every = 1
    for n in sizes:
        every *= n
    out = spark.range(1, (every if quota is None else quota if every else 0) + 1).withColumnRenamed("id", "task_id")
    left = F.pmod(F.col("task_id") - 1, F.lit(max(1, every)))
    below = every
    for k, n in enumerate(sizes):
        below = below // max(1, n)
        out = out.withColumn(f"_r{k}", F.floor(left / F.lit(max(1, below))).cast("long") % F.lit(max(1, n)))
    for k, rows in enumerate(ranked):
        out = out.join(rows, f"_r{k}").drop(f"_r{k}")
    return out.select(*[c for axis in axes for c in axis.columns], "task_id")


def passages(hits: DataFrame, corpus: DataFrame, *, doc_id: str, text: str, query_id: str = "query_id", rank: str = "rank") -> DataFrame:
    """One text per query: its hits in order of rank, numbered, the first line as the title."""
    title = F.substring_index(text, "\n", 1)
    rest = F.when(F.instr(text, "\n") > 0, F.substring(F.col(text), F.instr(text, "\n") + 1, F.length(text))).otherwise("")
    one = F.concat(F.lit("Doc "), F.col(rank).cast("string"), F.lit("(Title: "), title, F.lit(") "), rest, F.lit("\n"))
    found = hits.join(corpus.select(F.col(doc_id), F.col(text)), doc_id)
    rows = found.groupBy(query_id).agg(F.array_sort(F.collect_list(F.struct(F.col(rank), one.alias("p")))).alias("_p"))
    return rows.select(query_id, F.array_join("_p.p", "").alias("passages"))
