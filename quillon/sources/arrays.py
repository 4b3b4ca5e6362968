"""Files that are one JSON array each, cut into byte ranges that many tasks read.

Whether a byte lies in a string, and how deep, depends on all bytes before it. A first pass therefore
reads each range once for both cases, a start inside and outside of a string, and keeps what the range
does to that state: a row of a few numbers. These rows are put together file by file, which tells for each
range its true state and how many elements begin before it. A second pass reads the elements that begin in
each range, the last one to its end beyond. A task holds one chunk and the element at hand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

#: Bytes of a range, and of what is read at once; files of one range that a task reads.
RANGE_BYTES, CHUNK_BYTES, FILES = 32 << 20, 1 << 20, 1000
_MARK = np.zeros(256, dtype=np.int8)  # 1 opens, -1 closes, 2 is a comma
for _c, _k in zip(b"[{]},", (1, 1, -1, -1, 2)):
    _MARK[_c] = _k
_BLANK = b" \t\r\n"


def opened(path: str):
    """A file to read from any place; paths are those that Spark lists."""
    from pyarrow import fs

    if path.startswith("file:/"):
        return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    store, inside = fs.FileSystem.from_uri(path)
    return store.open_input_file(inside)


def chunks(file, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of the file from start to stop."""
    while start < stop:
        data = file.read_at(min(CHUNK_BYTES, stop - start), start)
        if not data:
            return
        yield start, data
        start += len(data)


class Marks:
    """Brackets and commas of a chunk, and how many quotes come before each; `carry` is whether a backslash before
    the chunk escapes its first byte."""

    def __init__(self, data: bytes, carry: bool):
        a = np.frombuffer(data, dtype=np.uint8)
        quotes, slashes = np.flatnonzero(a == 34), np.flatnonzero(a == 92)
        self.carry = False
        if carry or len(slashes):
            first = np.flatnonzero(np.diff(slashes, prepend=-2) != 1)
            length = np.diff(np.append(first, len(slashes)))
            begin = slashes[first]
            odd = (length + ((begin == 0) & carry)) % 2 == 1
            escaped = (begin + length)[odd]
            if carry and not (len(begin) and begin[0] == 0):
                escaped = np.append(escaped, 0)
            quotes = quotes[~np.isin(quotes, escaped)]
            self.carry = bool((escaped == len(a)).any())
        self.at = np.flatnonzero(_MARK[a])
        self.kind = _MARK[a[self.at]]
        self.quoted = np.searchsorted(quotes, self.at)
        self.quotes = len(quotes)

    def outside(self, inside: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of those outside of strings: place, kind, and depth before it, from 0."""
        some = (self.quoted + inside) % 2 == 0
        kind = self.kind[some]
        step = np.where(kind == 2, 0, kind).astype(np.int64)
        return self.at[some], kind, np.cumsum(step) - step


_EFFECT = "file string, number int, start long, stop long, size long, case int, inside boolean, depth long, levels array<long>, commas array<long>, opens boolean"


def _escapes(file, start: int) -> bool:
    """Whether the byte at `start` follows an odd number of backslashes."""
    n, at = 0, start
    while at > 0:
        data = file.read_at(min(64, at), max(0, at - 64))
        more = len(data) - len(data.rstrip(b"\\"))
        n += more
        if more < len(data):
            break
        at -= len(data)
    return n % 2 == 1


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a range does to the state, for a start outside (case 0) and inside (1) of a string: the state at its end,
    and how many commas lie at each depth, counted from that at its start."""
    for batch in batches:
        for row in batch.to_pylist():
            with opened(row["file"]) as file:
                rows = _effect(file, row, (0, 1))
            yield pa.RecordBatch.from_pylist(rows, schema=_arrow(_EFFECT))


def _effect(file, row: dict, cases: tuple[int, ...]) -> list[dict]:
    carry, states = _escapes(file, row["start"]), [[bool(c), 0, {}] for c in cases]
    opens = None
    for _, data in chunks(file, row["start"], row["stop"]):
        if opens is None and data.strip(_BLANK):
            opens = data.lstrip(_BLANK)[:1] == b"["
        m = Marks(data, carry)
        carry = m.carry
        for state in states:
            _, kind, before = m.outside(state[0])
            depth, n = np.unique(before[kind == 2] + state[1], return_counts=True)
            for d, c in zip(depth.tolist(), n.tolist()):
                if d <= 1:
                    state[2][d] = state[2].get(d, 0) + c
            state[1] += int(kind[kind != 2].sum())
            state[0] ^= bool(m.quotes % 2)
    return [row | {"case": c, "inside": s[0], "depth": s[1], "levels": list(s[2]), "commas": list(s[2].values()), "opens": opens} for c, s in zip(cases, states)]


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ddl.split(", ")])


_START = "file string, number int, start long, stop long, size long, inside boolean, depth long, before long, fault string"


def _joined(table: pa.Table) -> pa.Table:
    return pa.Table.from_pylist(_states(table.to_pylist()), schema=_arrow(_START))


def _states(rows: list[dict]) -> list[dict]:
    """The ranges of one file, each with the state at its start and the commas of the array before it."""
    rows = sorted(rows, key=lambda r: (r["number"], r["case"]))
    inside, depth, before, out = False, 0, 0, []
    first = next((r["opens"] for r in rows if r["opens"] is not None), False)  # blank ranges do not say
    fault = None if first else "the root is not a list"
    for r in rows:
        if r["case"] != inside or len(out) > r["number"]:
            continue
        out.append({k: r[k] for k in ("file", "number", "start", "stop", "size")} | {"inside": inside, "depth": depth, "before": before, "fault": fault})
        before += sum(n for d, n in zip(r["levels"], r["commas"]) if d + depth == 1)
        inside, depth = r["inside"], depth + r["depth"]
    if fault is None and (inside or depth):
        out[-1]["fault"] = "the list does not end"
    return out


def elements(file, row: dict) -> Iterator[tuple[int, bytes]]:
    """(index, text) of the elements that begin in a range."""
    inside, depth, index = row["inside"], row["depth"], row["before"]
    carry, held = _escapes(file, row["start"]), None
    for place, data in chunks(file, row["start"], row["size"]):
        m = Marks(data, carry)
        at, kind, before = m.outside(inside)
        before = before + depth
        border = np.flatnonzero(((kind == 2) & (before == 1)) | ((kind == 1) & (before == 0)) | ((kind == -1) & (before == 1)))
        last = 0
        for k in border.tolist():
            if held is not None:
                text = b"".join([*held, data[last : at[k]]])
                if kind[k] == 2 or index or text.strip(_BLANK):  # [] has no element
                    yield index, text
                held = None
            if kind[k] == -1 or place + at[k] >= row["stop"]:
                return
            index += kind[k] == 2
            held, last = [], int(at[k]) + 1
        if held is not None:
            held.append(data[last:])
        elif place + len(data) >= row["stop"]:
            return
        carry, inside, depth = m.carry, inside ^ bool(m.quotes % 2), depth + int(kind[kind != 2].sum())


def _elements(strict: bool, rows: int = 1024):
    """Elements of ranges whose state is known, and of whole files (state null) whose state is found on the spot.
    Files that come one after the other share a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: list[tuple]) -> pa.RecordBatch:
            files, index, text = zip(*found)
            return pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(index, pa.int64()), pa.array([t.decode() for t in text], pa.string())], names=["file", "source_index", "raw"])

        found, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["fault"] and strict:
                    raise ValueError(f"{row['file']}: {row['fault']}")
                if row["fault"]:
                    continue
                with opened(row["file"]) as file:
                    if row["inside"] is None:
                        row = _states(_effect(file, row, (0,)))[0]
                        if row["fault"] and strict:
                            raise ValueError(f"{row['file']}: {row['fault']}")
                    for index, text in elements(file, row) if not row["fault"] else ():
                        found.append((row["file"], index, text))
                        size += len(text)
                        if len(found) >= rows or size >= CHUNK_BYTES:
                            yield out(found)
                            found, size = [], 0
        if found:
            yield out(found)

    return run


def array_elements(spark: SparkSession, path: str, *, glob: str | None = None, strict: bool = True, start: int = 0, limit: int | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, source_index, raw, and the columns of partitioned folders): the text of each element of each file's array,
    in files of any size. With `strict` a file whose root is no list, or that ends within one, raises; else it
    gives no row, and so does an empty file. Ranges without an element from `start` on, or beyond `limit` more, are not read again."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", glob is not None)
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    folders = [c for c in files.columns if c not in ("path", "modificationTime", "length", "content")]
    files = written(files.select(F.col("path").alias("file"), F.col("length").alias("size"), *folders), "files")
    cuts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))
    ranges = files.select("file", "size", F.posexplode(cuts).alias("number", "start"))
    ranges = ranges.select("file", "number", "start", F.least(F.col("start") + range_bytes, "size").alias("stop"), "size")
    # rows are small, their work is not: as many tasks as there are ranges' worth of bytes
    n, size, long = files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.count_if(F.col("size") > range_bytes)).first()
    tasks = max(1, -(-int(size) // range_bytes), -(-n // FILES), min(n, spark.sparkContext.defaultParallelism))
    spread = lambda df: df.repartition(tasks, "file", "number")
    # a file of one range begins where its range does: it is read whole by one task, with no pass before
    unknown = [F.lit(None).cast(k).alias(c) for c, k in (("inside", "boolean"), ("depth", "long"), ("before", "long"), ("fault", "string"))]
    whole = ranges.filter(F.col("size") <= range_bytes).select("file", F.col("number").cast("int").alias("number"), "start", "stop", "size", *unknown)
    states = spread(ranges.filter(F.col("size") > range_bytes)).mapInArrow(_effects, _EFFECT).groupBy("file").applyInArrow(_joined, _START)  # a row a range
    if start or limit is not None:
        after = F.lead("before").over(_by_file())
        states = states.withColumn("_after", after)
        if limit is not None:
            states = states.filter((F.col("before") < start + limit) | F.col("fault").isNotNull())
        states = states.filter(F.col("_after").isNull() | (F.col("_after") >= start) | F.col("fault").isNotNull()).drop("_after")
    found = spread(states.unionByName(whole) if 0 < long < n else states if long else whole).mapInArrow(_elements(strict), "file string, source_index long, raw string")
    if start or limit is not None:
        found = found.filter(F.col("source_index").between(start, start + limit - 1) if limit is not None else F.col("source_index") >= start)
    return found.join(files.select("file", *folders), "file") if folders else found


def _by_file():
    from pyspark.sql import Window

    return Window.partitionBy("file").orderBy("number")
