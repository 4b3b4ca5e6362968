"""Timelines, intervals and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from an md5 of the seed and keys: the same in every run and in SQL."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def islands(df: DataFrame, *, keys: list[str], number: str) -> DataFrame:
    """Runs of consecutive numbers per key: (keys, start, end)."""
    rows = df.select(*keys, number).distinct()
    group = F.col(number) - F.row_number().over(Window.partitionBy(*keys).orderBy(number))
    return rows.withColumn("_g", group).groupBy(*keys, "_g").agg(F.min(number).alias("start"), F.max(number).alias("end")).drop("_g")


def chunk_count(n: Column, size: int, overlap: int) -> Column:
    """How many overlapping chunks cover n items: none begins once the tail is covered."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be from 0 to below the size")
    return F.when(n <= 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / (size - overlap)) + 1)


def chunks(items: DataFrame, *, keys: list[str], index: str, count: str, size: int, overlap: int) -> DataFrame:
    """Items with each chunk that they are in (`chunk`, from 0). `index` counts from 0, `count` is the sequence's length."""
    step = size - overlap
    last = chunk_count(F.col(count), size, overlap) - 1
    low = F.greatest(F.ceil((F.col(index) - size + 1) / step), F.lit(0))
    high = F.least(F.floor(F.col(index) / step), last)
    return items.withColumn("chunk", F.explode(F.sequence(low.cast("int"), high.cast("int"))))


def chunk_cost(df: DataFrame, *, count: str, size: int, overlap: int) -> DataFrame:
    """calls and items_sent of chunking a sequence of `count` items."""
    calls = chunk_count(F.col(count), size, overlap).cast("long")
    return df.withColumn("calls", calls).withColumn("items_sent", F.col(count) + F.greatest(F.col("calls") - 1, F.lit(0)) * overlap)


def uniform_points(df: DataFrame, *, start: Column, end: Column, n: int, middle: bool = False) -> DataFrame:
    """n points from start to end, both included, or the middles of n equal parts."""
    place = (lambda k: (k + 0.5) / n) if middle else (lambda k: k / F.lit(max(n - 1, 1)))
    points = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: start + (end - start) * place(k))
    return df.select("*", F.posexplode(points).alias("point", "at"))


def interval_points(intervals: DataFrame, *, key: str, start: str, end: str, per_second: float = 2.0, least: int = 1, most: int = 32) -> DataFrame:
    """Points spread evenly over a key's intervals by their total length, at the middles of equal parts:
    (key, point, at)."""
    w = Window.partitionBy(key).orderBy(start, end)
    laid = intervals.select(key, start, end, (F.col(end) - F.col(start)).alias("_len"))
    laid = laid.withColumn("_to", F.sum("_len").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_from", F.col("_to") - F.col("_len"))
    total = F.sum("_len").over(Window.partitionBy(key))
    n = F.least(F.greatest(F.ceil(total * per_second), F.lit(least)), F.lit(most))
    laid = laid.withColumn("_n", n).withColumn("_total", total)
    # the points k + 1/2 of n equal parts that fall in [from, to)
    low, high = F.ceil(F.col("_from") / F.col("_total") * F.col("_n") - 0.5), F.ceil(F.col("_to") / F.col("_total") * F.col("_n") - 0.5) - 1
    out = laid.filter((F.col("_total") > 0) & (low <= high)).withColumn("point", F.explode(F.sequence(low, high)))
    at = F.col(start) + (F.col("point") + 0.5) / F.col("_n") * F.col("_total") - F.col("_from")
    return out.select(key, "point", at.alias("at"))


def apportion(df: DataFrame, *, keys: list[str], share: str, total: Column, order: list[str], out: str = "allotted") -> DataFrame:
    """`total` whole units over a key's rows in proportion to share: floors first, the rest to the largest fractions, earlier rows first."""
    w = Window.partitionBy(*keys)
    exact = total * F.col(share) / F.sum(share).over(w)
    rows = df.withColumn("_x", exact).withColumn("_f", F.floor("_x"))
    left = total - F.sum("_f").over(w)
    rank = F.row_number().over(w.orderBy(F.desc(F.round(F.col("_x") - F.col("_f"), 9)), *order))
    return rows.withColumn(out, (F.col("_f") + (rank <= left).cast("long")).cast("long")).drop("_x", "_f")


#: Seconds that an event of a stitched timeline, and a micro action, may last, and how often each. Fixed values.
EVENT_SECONDS = {3: 1, 4: 2, 5: 3, 6: 3, 7: 2, 8: 1, 9: 1}
MICRO_SECONDS = {3: 1, 4: 3, 5: 4, 6: 3, 7: 2, 8: 1}


def weighted_pick(u: Column, weights: dict[int, int]) -> Column:
    """The value that a number u in [0, 1) picks by weight."""
    total, below, out = sum(weights.values()), 0, None
    for value, weight in list(weights.items())[:-1]:
        below += weight
        near = u * total < below
        out = F.when(near, value) if out is None else out.when(near, value)
    last = list(weights)[-1]
    return (F.lit(last) if out is None else out.otherwise(last)).cast("long")


def stitched_timeline(phases: DataFrame, *, task: str, phase: str, seed: int = 42, weights: dict[int, int] = EVENT_SECONDS) -> DataFrame:
    """Phases of a task in a seeded order on one timeline: duration (drawn by weight), position, start and end,
    and the task's answer, which names for each phase in its own order the position it is at."""
    rows = phases.withColumn("duration", weighted_pick(draw(seed, F.col(task), F.col(phase), F.lit("d")), weights))
    order = Window.partitionBy(task).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(task).cast("string"), F.col(phase).cast("string"), F.lit("o"))), phase)
    rows = rows.withColumn("position", F.row_number().over(order).cast("long"))
    rows = rows.withColumn("end", F.sum("duration").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("end") - F.col("duration"))
    answers = rows.groupBy(task).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(phase, "position"))), lambda x: x["position"].cast("string")), "->").alias("answer"))
    return rows.join(answers, task)


def event_timelines(events: DataFrame, *, task: str, phase: str, event: str, seed: int = 42, weights: dict[int, int] = EVENT_SECONDS) -> DataFrame:
    """Events of each phase one behind the other from 0 on, with durations drawn by weight: duration, start, end,
    and total_duration of the phase."""
    rows = events.withColumn("duration", weighted_pick(draw(seed, F.col(task), F.col(phase), F.col(event), F.lit("e")), weights))
    w = Window.partitionBy(task, phase)
    rows = rows.withColumn("end", F.sum("duration").over(w.orderBy(event).rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("end") - F.col("duration"))
    return rows.withColumn("total_duration", F.sum("duration").over(w))


def expand_span(start: Column, end: Column, duration: Column, *, half: float) -> tuple[Column, Column]:
    """A point becomes a window of half on both sides within the video; one outside becomes its first or
    last 2 half; intervals stay."""
    point = start == end
    s = F.when(~point, start).when(start < 0, 0.0).when(start > duration, F.greatest(duration - 2 * half, F.lit(0.0))).otherwise(F.greatest(start - half, F.lit(0.0)))
    e = F.when(~point, end).when(start < 0, F.least(F.lit(2 * half), duration)).when(start > duration, duration).otherwise(F.least(start + half, duration))
    return s, e


def repair_chunk_reference(df: DataFrame, *, text: str, start: str, end: str, duration: str) -> DataFrame:
    """Targets whose text cites 'Chunk k/n' but whose window is off by more than max(2 s, 5 % of the
    chunk) get that chunk's window; `repaired` says so."""
    k = F.regexp_extract(text, r"(?i)chunk\s+(\d+)\s*/\s*(\d+)", 1).try_cast("double")
    n = F.regexp_extract(text, r"(?i)chunk\s+(\d+)\s*/\s*(\d+)", 2).try_cast("double")
    width = F.col(duration) / n
    a, b = (k - 1) * width, k * width
    tolerance = F.greatest(F.lit(2.0), 0.05 * width)
    bad = F.coalesce((k >= 1) & (k <= n) & ((F.abs(F.col(start) - a) > tolerance) | (F.abs(F.col(end) - b) > tolerance)), F.lit(False))
    return df.withColumns({"repaired": bad, start: F.when(bad, a).otherwise(F.col(start)), end: F.when(bad, b).otherwise(F.col(end))})


def representatives(vectors: DataFrame, *, group: str, item: str, vector: str, k: int) -> DataFrame:
    """Up to k items per group: nearest to its centroid, farthest, first, last, then evenly spaced ones."""
    dims = vectors.select(group, F.posexplode(vector).alias("_d", "_x")).groupBy(group, "_d").agg(F.avg("_x").alias("_c"))
    centre = dims.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_d", "_c"))), lambda s: s["_c"]).alias("_centre"))
    gap = F.aggregate(F.zip_with(vector, "_centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    w = Window.partitionBy(group)
    rows = vectors.join(centre, group).withColumn("_gap", F.round(gap, 9)).drop("_centre")
    rows = rows.withColumn("_i", F.row_number().over(w.orderBy(item))).withColumn("_n", F.count("*").over(w))
    near, far = F.row_number().over(w.orderBy("_gap", item)), F.row_number().over(w.orderBy(F.desc("_gap"), item))
    step = F.greatest(F.floor(F.col("_n") / k), F.lit(1))
    rows = rows.withColumn("_near", near).withColumn("_far", far)
    role = F.when(F.col("_near") == 1, 0).when(F.col("_far") == 1, 1).when(F.col("_i") == 1, 2).when(F.col("_i") == F.col("_n"), 3).when((F.col("_i") - 1) % step == 0, 4).otherwise(5)
    names = F.element_at(F.array(*[F.lit(x) for x in ("nearest", "farthest", "first", "last", "uniform", "fill")]), F.col("_role") + 1)
    ranked = rows.withColumn("_role", role).withColumn("_r", F.row_number().over(w.orderBy("_role", "_i")))
    return ranked.filter(F.col("_r") <= k).select(group, item, names.alias("role"))


def equal_frames(targets: DataFrame, *, group: str, order: str, layer: str, frames: str) -> DataFrame:
    """Every target of a group takes the first target's number of frames; a layer 2 target takes at most
    what the layer 1 targets before it took."""
    w = Window.partitionBy(group).orderBy(order)
    first = F.first(frames).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    base = targets.withColumn("_first", first)
    last = F.last(F.when(F.col(layer) == 1, F.col(frames)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    even = F.when(F.col(layer) == 2, F.least("_first", F.coalesce(last, F.col("_first")))).otherwise(F.col("_first"))
    return base.withColumn("even_frames", even).drop("_first")


def before_turn(entries: DataFrame, *, turn: str, error_turn: Column) -> DataFrame:
    """Tool calls of turns before the error."""
    return entries.filter(F.col(turn) < error_turn)


def resume_history(history: Column, turn: Column, correction: Column) -> Column:
    """The first 2 + 2 (turn - 1) messages and the correction."""
    return F.concat(F.slice(history, 1, (2 + 2 * (turn - 1)).cast("int")), F.array(correction))


def slots(tasks: DataFrame, *, task: str, duration: str, start: str | None = None, seed: int = 42, low: int = 5, high: int = 15, last: float = 20.0) -> DataFrame:
    """Slots of seeded lengths from low to high seconds from `start` (0) on, one after the other; once at most `last` seconds
    remain, they are one slot: (task, slot, start, end)."""
    begin = F.col(start).cast("long") if start else F.lit(0).cast("long")
    most = F.ceil((F.col(duration) - begin) / low).cast("int")
    rows = tasks.withColumn("_from", begin).withColumn("slot", F.explode(F.sequence(F.lit(1), F.greatest(most, F.lit(1)))))
    rows = rows.withColumn("_len", F.floor(draw(seed, F.col(task), F.col("slot"), *([F.col(start)] if start else [])) * (high - low + 1)) + low)
    w = Window.partitionBy(task, "_from").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_end", F.col("_from") + F.sum("_len").over(w)).withColumn("_start", F.col("_end") - F.col("_len"))
    left, before = F.col(duration) - F.col("_start"), F.col(duration) - (F.col("_start") - F.lag("_len", 1, 0).over(Window.partitionBy(task, "_from").orderBy("slot")))
    rows = rows.withColumn("_left", left).withColumn("_first", (F.col("slot") == 1) | (before > last)).filter((F.col("_left") > 0) & F.col("_first"))
    return rows.select(task, "slot", F.col("_start").alias("start"), F.when(F.col("_left") <= last, F.col(duration)).otherwise(F.col("_end")).cast("long").alias("end"))


def gap_structure(tasks: DataFrame, *, task: str, seed: int = 42, low: int = 60, high: int = 150) -> DataFrame:
    """Per task three parts of low to high seconds each, begin, gap and end: (task, part, start, end, total_duration)."""
    parts = ["begin", "gap", "end"]
    length = lambda p: F.floor(draw(seed, F.col(task), F.lit(p)) * (high - low + 1)).cast("long") + low
    rows = tasks.select(task, *[length(p).alias(f"_{p}") for p in parts])
    ends = [sum((F.col(f"_{p}") for p in parts[1:k + 1]), F.col("_begin")) for k in range(3)]
    each = F.array(*[F.struct(F.lit(p).alias("part"), (ends[k] - F.col(f"_{p}")).alias("start"), ends[k].alias("end")) for k, p in enumerate(parts)])
    return rows.withColumn("total_duration", ends[2]).withColumn("_x", F.explode(each)).select(task, "_x.part", "_x.start", "_x.end", "total_duration")


def parallel_timelines(steps: DataFrame, *, task: str, step: str, events_a: str, events_b: str, seed: int = 42, weights: dict[int, int] = MICRO_SECONDS) -> DataFrame:
    """Two videos that go through the same steps, each with its own number of micro actions, whose seconds are
    drawn by weight: per step its interval in both, (start_a, end_a, start_b, end_b). Steps with no action
    in one of them are left out."""
    rows = steps.filter((F.col(events_a) > 0) & (F.col(events_b) > 0))
    order = Window.partitionBy(task).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    for side, n in (("a", events_a), ("b", events_b)):
        seconds = F.aggregate(F.transform(F.sequence(F.lit(1), F.col(n).cast("int")), lambda k: weighted_pick(draw(seed, F.col(task), F.col(step), F.lit(side), k), weights)), F.lit(0).cast("long"), lambda s, x: s + x)  # noqa: B023
        rows = rows.withColumn(f"_{side}", seconds).withColumn(f"end_{side}", F.sum(f"_{side}").over(order)).withColumn(f"start_{side}", F.col(f"end_{side}") - F.col(f"_{side}")).drop(f"_{side}")
    return rows


#: Seconds that a long video lasts: share of the videos, from, to. Fixed values.
LONG_SECONDS = [(0.10, 45, 90), (0.55, 120, 400), (0.30, 400, 700), (0.05, 700, 1100)]


def mixed_duration(u: Column, v: Column, ranges: list[tuple[float, int, int]] = LONG_SECONDS) -> Column:
    """A duration from a mixture of ranges: u in [0, 1) picks the range by its share, v where in it."""
    at = lambda low, high: F.floor(v * (high - low + 1)).cast("long") + low
    below, out = 0.0, None
    for share, low, high in ranges[:-1]:
        below = round(below + share, 9)
        out = F.when(u < below, at(low, high)) if out is None else out.when(u < below, at(low, high))
    rest = at(*ranges[-1][1:])
    return rest if out is None else out.otherwise(rest)


def proxy_ranges(ranges: Column, frames: Column, *, seconds: float = 12.0, most: int = 3) -> Column:
    """Frame ranges on a proxy timeline, the first few as text."""
    at = lambda f: f.cast("double") / F.greatest(frames - 1, F.lit(1)) * seconds
    shown = F.transform(F.slice(ranges, 1, most), lambda r: F.format_string("%.2f-%.2fs", at(r["start"]), at(r["end"])))
    return F.concat(F.array_join(shown, ", "), F.when(F.size(ranges) > most, F.lit(", ...")).otherwise(""))
