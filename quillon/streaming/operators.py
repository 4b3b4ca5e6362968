"""Bounded buffers, staleness, resume, ordered state and windowed metrics on streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.evaluation import aggregation_kind, time_statistics


def in_order(rows: Iterator[pd.DataFrame], order: str | None) -> pd.DataFrame:
    """A key's rows of a batch: by a column, or as they arrive."""
    every = pd.concat(list(rows), ignore_index=True)
    return every.sort_values(order, kind="stable", ignore_index=True) if order else every


class _LastN(StatefulProcessor):
    """The last n items of a key, and how many came, were taken out and were dropped."""

    def __init__(self, n: int, key: str, item: str, kind: T.DataType, order: str | None, op: str | None):
        self.n, self.key, self.item, self.kind, self.order, self.op = n, key, item, kind, order, op

    def init(self, handle: StatefulProcessorHandle) -> None:
        counts = [T.StructField(c, T.LongType()) for c in ("produced", "consumed", "dropped")]
        self.state = handle.getValueState("buffer", T.StructType([T.StructField("items", T.ArrayType(self.kind)), *counts]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        items, produced, consumed, dropped = self.state.get() if self.state.exists() else ([], 0, 0, 0)
        items = list(items)
        new = in_order(rows, self.order)
        for item, op in zip(new[self.item].tolist(), new[self.op].tolist() if self.op else ["put"] * len(new)):
            if op == "get":
                consumed += bool(items)
                items = items[1:]
            else:
                produced += 1
                dropped += len(items) >= self.n
                items = [*items[max(0, len(items) - self.n + 1):], item]
        self.state.update((items, produced, consumed, dropped))
        yield pd.DataFrame({self.key: [key[0]], "items": [items], "produced": [produced], "consumed": [consumed], "dropped": [dropped]})

    def close(self) -> None:
        pass


def bounded_buffer(stream: DataFrame, *, key: str, item: str, n: int, order: str | None = None, op: str | None = None) -> DataFrame:
    """Per key a first-in-first-out buffer of n items of any type; the oldest go when it is full. Items come in the
    order of a column or, without one, as they arrive; with a column `op`, rows that say "get" take the oldest item
    out. Each batch gives the buffer, produced, consumed and dropped of the keys that it touched."""
    kind = stream.schema[item].dataType
    schema = T.StructType([stream.schema[key], T.StructField("items", T.ArrayType(kind)), *[T.StructField(c, T.LongType()) for c in ("produced", "consumed", "dropped")]])
    return stream.groupBy(key).transformWithStateInPandas(_LastN(n, key, item, kind, order, op), schema, "Update", "None")


class _Staleness(StatefulProcessor):
    """Samples in flight for the current parameter version of a key."""

    def __init__(self, key: str, version: str, order: str | None, waiting: str | None, limit: int):
        self.key, self.version, self.order, self.waiting, self.limit = key, version, order, waiting, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("staleness", T.StructType([T.StructField(c, T.LongType()) for c in ("version", "in_flight", "resets", "paused")]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        current, count, resets, paused = self.state.get() if self.state.exists() else (None, 0, 0, 0)
        new = in_order(rows, self.order)
        waiting = new[self.waiting].tolist() if self.waiting else [0] * len(new)
        for version, left in zip(new[self.version].tolist(), waiting):
            if current is None or version > current:
                resets += current is not None
                current, count = version, int(left)
            if count >= self.limit:
                paused += 1  # generation waits: the sample is not begun
            else:
                count += 1
        self.state.update((current, count, resets, paused))
        yield pd.DataFrame({self.key: [key[0]], "current_version": [current], "in_flight": [count], "resets": [resets], "refused": [paused], "pause": [count >= self.limit]})

    def close(self) -> None:
        pass


def staleness_gate(stream: DataFrame, *, key: str, version: str, limit: int, order: str | None = None, waiting: str | None = None) -> DataFrame:
    """Per key the samples begun under its current parameter version, at most `limit`; a later version sets the count
    back to the samples still `waiting` then (0 without that column), and samples beyond the limit are refused until
    it comes. Each batch gives, for the keys it touched, the version, in_flight, resets, refused and whether
    generation is to pause."""
    schema = T.StructType([stream.schema[key], *[T.StructField(c, T.LongType()) for c in ("current_version", "in_flight", "resets", "refused")], T.StructField("pause", T.BooleanType())])
    return stream.groupBy(key).transformWithStateInPandas(_Staleness(key, version, order, waiting, limit), schema, "Update", "None")


class _Assembly(StatefulProcessor):
    """Rollouts that wait until a batch is full."""

    FIELDS = ("item", "seconds", "tool_seconds", "version_start", "version_end")
    BATCHES = 4096

    def __init__(self, key: str, size: int, names: dict[str, str], order: str | None):
        self.key, self.size, self.names, self.order = key, size, names, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        row = T.StructType([T.StructField("item", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in self.FIELDS[1:]]])
        self.state = handle.getValueState("waiting", T.StructType([T.StructField("rows", T.ArrayType(row)), T.StructField("batches", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting, number = self.state.get() if self.state.exists() else ([], 0)
        new = self._arrays(rows)
        old = list(zip(*waiting)) if len(waiting) else [[]] * len(self.FIELDS)
        columns = [np.concatenate([np.array(a, dtype=b.dtype), b]) for a, b in zip(old, new)]
        full = len(columns[0]) // self.size
        for at in range(0, full, self.BATCHES):  # a bounded number of batches at once, each a row of its array
            some = slice(at * self.size, min(full, at + self.BATCHES) * self.size)
            items, seconds, tools, start, end = [c[some].reshape(-1, self.size) for c in columns]
            span = np.abs(end - start)
            tp50, tp95, tp99 = np.percentile(seconds, [50, 95, 99], axis=1)
            values = [number + at + np.arange(len(items)), list(items), seconds.mean(axis=1), seconds.max(axis=1), seconds.min(axis=1), tp50, tp95, tp99, tools.max(axis=1), tools.min(axis=1), tools.mean(axis=1),
                      (span > 0).sum(axis=1), (span > 0).mean(axis=1), span.max(axis=1).astype(np.int64), 1 + (np.diff(np.sort(end, axis=1), axis=1) != 0).sum(axis=1)]
            yield pd.DataFrame({self.key: [key[0]] * len(items), **{n: v for (n, _), v in zip(ASSEMBLED, values)}})
        left = [c[full * self.size:].tolist() for c in columns]
        self.state.update((list(zip(*left)), number + full))

    def _arrays(self, rows: Iterator[pd.DataFrame]) -> list[np.ndarray]:
        """The fields of a key's rows as arrays of numbers, in order: five numbers a row, no objects."""
        names = [self.names[f] for f in self.FIELDS]
        parts = [[part[n].to_numpy() for n in names] + ([part[self.order].to_numpy()] if self.order else []) for part in rows]
        columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0)] * (len(names) + bool(self.order))
        del parts
        if np.isnan(columns[0].astype(np.float64)).any():
            raise ValueError(f"a row of a batch has no {names[0]}")
        place = pd.Series(columns.pop()).argsort(kind="stable").to_numpy() if self.order else slice(None)
        for k, c in enumerate(columns):
            columns[k] = c[place].astype(np.float64 if k else np.int64)
        return columns

    def close(self) -> None:
        pass


ASSEMBLED = [
    ("batch", T.LongType()), ("items", T.ArrayType(T.LongType())), *[(f"processing_time_{c}", T.DoubleType()) for c in ("avg", "max", "min", "tp50", "tp95", "tp99")],
    *[(f"tool_calls_{c}", T.DoubleType()) for c in ("max", "min", "mean")], ("partial_num", T.LongType()), ("partial_ratio", T.DoubleType()), ("max_partial_span", T.LongType()), ("version_diversity", T.LongType())]


def assembled_batches(stream: DataFrame, *, key: str, size: int, item: str, seconds: str, tool_seconds: str, version_start: str, version_end: str, order: str | None = None) -> DataFrame:
    """Per key (a trainer) its rollouts in batches of exactly `size`, across micro-batches; what does not fill a batch
    waits in state, fewer than `size` rows. A batch gives its number and items, statistics of processing and tool
    seconds, how many rollouts span parameter versions, their share and largest span, and the number of versions."""
    names = {"item": item, "seconds": seconds, "tool_seconds": tool_seconds, "version_start": version_start, "version_end": version_end}
    schema = T.StructType([stream.schema[key], *[T.StructField(n, k) for n, k in ASSEMBLED]])
    return stream.groupBy(key).transformWithStateInPandas(_Assembly(key, size, names, order), schema, "Append", "None")


def version_lag(samples: DataFrame, current: DataFrame, *, version: str, threshold: int) -> DataFrame:
    """Samples with the current version (a one-row table), their lag and whether it is within the threshold."""
    joined = samples.crossJoin(F.broadcast(current))
    return joined.withColumn("version_lag", F.col("current_version") - F.col(version)).withColumn("fresh", F.col("version_lag") <= threshold)


def staleness_limit(required: int, threshold: float, sync_step: int) -> int:
    """How many samples may be in flight for one parameter version."""
    return int(required * (threshold + 1) * sync_step)


def in_flight_report(samples: DataFrame, *, version: str, limit: int) -> DataFrame:
    """Per version: samples and whether generation would pause."""
    return samples.groupBy(version).agg(F.count("*").alias("in_flight")).withColumn("paused", F.col("in_flight") >= limit)


def new_by_id(stream: DataFrame, *, key: str, time: str | None = None, watermark: str | None = None) -> DataFrame:
    """Each id once; with a watermark the ids are remembered no longer than that."""
    if time and watermark:
        return stream.withWatermark(time, watermark).dropDuplicatesWithinWatermark([key])
    return stream.dropDuplicates([key])


def windowed_metrics(stream: DataFrame, *, time: str, name: str, value: str, width: str, watermark: str) -> DataFrame:
    """One value per metric and window of time, by the metric's name: maximum, minimum, sum or mean."""
    kind = aggregation_kind(F.col(name))
    out = F.avg(value)
    for k, form in (("max", F.max(value)), ("min", F.min(value)), ("sum", F.sum(value)), ("time_sum", F.sum(value))):
        out = F.when(F.first("_kind") == k, form).otherwise(out)
    rows = stream.withColumn("_kind", kind).withWatermark(time, watermark).groupBy(F.window(time, width).alias("w"), name).agg(out.alias("value"), F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), name, "value", "n")


def run_to_end(stream: DataFrame, path: str, checkpoint: str, *, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None, name: str | None = None) -> None:
    """Works off what is there and stops; a later run with the same checkpoint goes on from there. Batches
    go to Parquet, or to `each`, which may be called again for a batch that failed."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.foreachBatch(each).start() if each else writer.format("parquet").option("path", path).start()
    query.awaitTermination()


def batch_statistics(path: str, *, value: str) -> Callable[[DataFrame, int], None]:
    """For `each`: time statistics of every batch, in a folder of its own, so a repeated batch replaces itself."""
    def write(batch: DataFrame, number: int) -> None:
        time_statistics(batch, value=value).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def append_generated(path: str, generate: Callable[[DataFrame], DataFrame], *, length: Column, limit: int) -> Callable[[DataFrame, int], None]:
    """For `each`: rows generated from a batch that pass the length filter, in a folder per batch."""
    def write(batch: DataFrame, number: int) -> None:
        generate(batch).filter(F.coalesce(length, F.lit(limit + 1)) <= limit).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


# ---- ordered merge of updates -----------------------------------------------------------

UPDATE = "struct<op:string,key:string,value:string>"


def _merge(state: dict[str, list[str]], op: str, key: str, value: str) -> dict[str, list[str]]:
    if op == "reset":
        return {}
    if op == "clear":
        state.pop(key, None)
    elif op == "resolve":
        state[key] = [x for x in state.get(key, []) if x != value]
    elif op == "replace":
        state[key] = [value]
    elif op == "append" and value not in state.get(key, []):
        state[key] = [*state.get(key, []), value]
    return state


def merged_state(updates: DataFrame, *, key: str, order: list[str], op: str, field: str, value: str) -> DataFrame:
    """State of each key after all its updates in order: (key, state map of lists). reset empties all,
    clear a field, resolve removes a value, replace sets one, append adds a value not yet there."""
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(op).alias("op"), F.col(field).alias("field"), F.col(value).alias("value"))))
    empty = F.create_map().cast("map<string,array<string>>")

    def step(state: Column, u: Column) -> Column:
        have = F.coalesce(state[u["field"]], F.array().cast("array<string>"))
        others = F.map_filter(state, lambda k, v: k != u["field"])
        put = lambda values: F.map_concat(others, F.create_map(u["field"], values))
        return (F.when(u["op"] == "reset", empty).when(u["op"] == "clear", others).when(u["op"] == "resolve", put(F.array_remove(have, u["value"])))
                .when(u["op"] == "replace", put(F.array(u["value"]))).when(u["op"] == "append", F.when(F.array_contains(have, u["value"]), state).otherwise(put(F.concat(have, F.array(u["value"])))))
                .otherwise(state))

    return updates.groupBy(key).agg(items.alias("_u")).select(key, F.aggregate("_u", empty, step).alias("state"))


def object_memory(updates: DataFrame, *, key: str, order: list[str], obj: str, view: str, state: str, reset: Column | None = None) -> DataFrame:
    """(key, object, views): what was last seen of each object in each view, a map from view to state, after the
    key's last row for which `reset` holds. Names are trimmed; rows without an object's name say nothing, a row
    without a view is a note on the object. A nested memory is kept as one row an object, so no key is a single fold."""
    at = F.struct(*order)
    rows = updates.withColumn("_at", at)
    if reset is not None:
        last = rows.filter(reset).groupBy(key).agg(F.max("_at").alias("_last"))
        rows = rows.join(last, key, "left").filter((F.col("_last").isNull() | (F.col("_at") > F.col("_last"))) & ~F.coalesce(reset, F.lit(False)))
    name, seen = F.trim(obj), F.coalesce(F.when(F.trim(view) != "", F.trim(view)), F.when(F.col(view).isNull(), F.lit("note")))
    kept = rows.select(key, name.alias("object"), seen.alias("_view"), F.col(state).alias("_state"), "_at").filter("object != '' and _view is not null")
    latest = kept.groupBy(key, "object", "_view").agg(F.max_by(F.struct("_state"), "_at").alias("_s"))
    return latest.groupBy(key, "object").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_view", F.col("_s._state").alias("s"))))).alias("views"))


class _Merge(StatefulProcessor):
    def __init__(self, key: str, order: str):
        self.key, self.order = key, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("fields", T.StructType().add("field", T.StringType()), T.StructType().add("values", T.ArrayType(T.StringType())))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = {k[0]: list(v[0]) for k, v in self.state.iterator()} if self.state.exists() else {}
        updates = pd.concat(list(rows)).sort_values(self.order)
        state = reduce(lambda s, u: _merge(s, *u), zip(updates["op"], updates["field"], updates["value"]), state)
        self.state.clear()
        for k, v in state.items():
            self.state.updateValue((k,), (v,))
        yield pd.DataFrame({self.key: [key[0]], "fields": [sorted(state)], "n_values": [sum(map(len, state.values()))]})

    def close(self) -> None:
        pass


def merged_state_stream(updates: DataFrame, *, key: str, order: str) -> DataFrame:
    """The same on a stream of (key, order, op, field, value), whose batches come in order: after each batch the
    fields of the keys that it touched and how many values they hold."""
    schema = T.StructType([updates.schema[key], T.StructField("fields", T.ArrayType(T.StringType())), T.StructField("n_values", T.LongType())])
    return updates.groupBy(key).transformWithStateInPandas(_Merge(key, order), schema, "Update", "None")


def read_stream(spark: SparkSession, path: str, schema: T.StructType, *, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


# ---- nested memory ----------------------------------------------------------------------


class _Memory(StatefulProcessor):
    """What was last seen of each object in each view of a key; a reset begins a new epoch, and older entries are
    overwritten when they are next seen. A batch reads and writes the entries that it touches and no others."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.epoch = handle.getValueState("epoch", "epoch long")
        self.seen = handle.getMapState("seen", "object string, view string", "epoch long, state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        epoch = self.epoch.get()[0] if self.epoch.exists() else 0
        new, out = in_order(rows, "at"), {}
        for at, obj, view, state, reset in zip(new["at"].tolist(), new["object"].tolist(), new["view"].tolist(), new["state"].tolist(), new["is_reset"].tolist()):
            if reset:
                epoch, out = epoch + 1, {(None, None): (epoch + 1, at, None)}
            elif obj:
                out[obj, view] = (epoch, at, state)
        self.epoch.update((epoch,))
        for (obj, view), (e, _, state) in out.items():
            if obj is not None:
                self.seen.updateValue((obj, view), (e, state))
        changes = [(key[0], e, at, obj, view, state) for (obj, view), (e, at, state) in out.items()]
        yield pd.DataFrame(changes, columns=self.columns)

    def close(self) -> None:
        pass


def object_memory_stream(updates: DataFrame, *, key: str, order: str, obj: str, view: str, state: str, reset: Column) -> DataFrame:
    """`object_memory` on a stream whose batches come in order: what changes, (key, epoch, at, object, view, state), a row
    for each entry that a batch sets and one without an object for each key that it resets. `order` is a whole number."""
    seen = F.coalesce(F.when(F.trim(view) != "", F.trim(view)), F.when(F.col(view).isNull(), F.lit("note")))
    rows = updates.select(key, F.col(order).cast("long").alias("at"), F.trim(obj).alias("object"), seen.alias("view"), F.col(state).cast("string").alias("state"), F.coalesce(reset, F.lit(False)).alias("is_reset"))
    rows = rows.filter("is_reset or (object != '' and view is not null)")
    schema = T.StructType([updates.schema[key], *[T.StructField(c, k) for c, k in (("epoch", T.LongType()), ("at", T.LongType()), ("object", T.StringType()), ("view", T.StringType()), ("state", T.StringType()))]])
    return rows.groupBy(key).transformWithStateInPandas(_Memory(schema.names), schema, "Update", "None")


def memory_of_changes(changes: DataFrame, *, key: str) -> DataFrame:
    """(key, object, views) after all changes that `object_memory_stream` gave: the last of each entry, of the key's last epoch."""
    last = changes.groupBy(key).agg(F.max("epoch").alias("_last"))
    kept = changes.groupBy(key, "object", "view").agg(F.max_by(F.struct("epoch", "state"), F.struct("epoch", "at")).alias("_s")).filter("object is not null").join(last, key).filter("_s.epoch = _last")
    return kept.groupBy(key, "object").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("view", F.col("_s.state").alias("s"))))).alias("views"))


# ---- plugs ------------------------------------------------------------------------------


def generated(df: DataFrame, generate: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Rows that a user generator makes of a table, batch by batch."""
    return df.mapInPandas(generate, schema)


def curriculum_weights(progress: DataFrame, weights: DataFrame, *, key: str, score: str, rate: float = 0.5) -> DataFrame:
    """Weights of the next batch: moved by `rate` towards how far each key's mean score is from 1."""
    seen = progress.groupBy(key).agg(F.avg(score).alias("_m"))
    new = F.col("weight") * (1 - rate) + rate * (1 - F.col("_m"))
    return weights.join(seen, key, "left").select(key, F.when(F.col("_m").isNull(), F.col("weight")).otherwise(new).alias("weight"))
