"""Prefix trie of conversations: every sequence of first turns that some conversation starts with.

Equal conversations are merged first. The distinct ones are dealt to sorted ranges of bounded size.
Within a range each candidate, the first d turns of one conversation, finds how far its equals reach
to the left and to the right on its own, by binary search in a sparse table of range minima over the
lengths of common prefixes of neighbours. The leftmost conversation of such an interval owns the node;
members, children, leaves and savings are differences of running sums, as the nodes of a subtree
follow each other in sorted order.

A node that reaches over the edge of a range comes in pieces. A range knows the sequences on both
sides of it, so each piece counts its own members, leaves and what begins in it; pieces add up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_batches, written

#: Bytes of a turn's name: 16 of its digest, then the length of its text as 4.
NAME = 20
#: Turns and conversations in one range, about.
RANGE_NODES = 50_000
#: Ids of one member list that travel in one row lie in one aligned range of so many (a power of 2).
ID_BITS = 12


def turn_sequences(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: id and `turns`, the hexadecimal names of its turns in their order.

    Turns are ordered by `turn_col`, null first, equal ones by their names, so that the order of rows
    does not matter. Null roles and texts count as empty, repeated rows are turns of their own, rows
    without an id belong to no conversation, texts are read whole and only by the task that reads them.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.substring(F.sha2(F.concat_ws(":", F.octet_length(role), F.concat(role, text)), 256), 1, 32)
    name = F.concat(digest, F.lpad(F.hex(F.octet_length(text)), 8, "0"))
    each = turns.select(F.col(id_col).cast("long").alias("id"), F.struct(F.col(turn_col).alias("at"), name.alias("name")).alias("t"))
    return each.filter("id is not null").groupBy("id").agg(F.sort_array(F.collect_list("t")).getField("name").alias("turns"))


def with_shared_starts(seqs: DataFrame, *, every: int = 5, most: int = 9) -> DataFrame:
    """Each conversation c with its first h turns replaced by those of conversation c - c mod `every`, as far as
    that has them (none if it does not exist), where h is the crc32 of c as text, modulo `most`."""
    h = (F.crc32(F.col("id").cast("string").cast("binary")) % most).cast("int")
    donors = seqs.select(F.col("id").alias("donor"), F.slice("turns", 1, most - 1).alias("given"))
    both = seqs.withColumns({"donor": F.col("id") - F.pmod("id", F.lit(every)), "h": h}).join(donors, "donor", "left")
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return both.select("id", F.concat(F.slice(F.coalesce("given", F.array().cast("array<string>")), F.lit(1), F.col("h")), rest).alias("turns"))


_SEQUENCE = "key binary, first long, n long, ends string"


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From blocks of member ids in order, one row per sequence; its members are hashed as they come."""
    names = [c.split()[0] for c in _SEQUENCE.split(", ")]
    rows: list[tuple] = []
    name = key = digest = None
    first = n = 0

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64(), pa.string()))], names=names)

    for batch in batches:
        for k, which in enumerate(batch.column("name").to_pylist()):
            ids = batch.column("ids")[k].as_py().encode()
            if which == name:
                digest.update(b",")
            else:
                if name is not None:
                    rows.append((key, first, n, digest.hexdigest()))
                name, key, digest, n = which, batch.column("key")[k].as_py(), hashlib.sha256(), 0
                first = batch.column("first")[k].as_py()
                if len(rows) >= 4096:
                    yield batch_of(rows)
                    rows = []
            digest.update(ids)
            n += batch.column("n")[k].as_py()
    if name is not None:
        yield batch_of([*rows, (key, first, n, digest.hexdigest())])


# ---- one range ------------------------------------------------------------------


def common_turns(a: np.ndarray, b: np.ndarray) -> int:
    """How many first turns two sequences share; rows of the arrays are turns."""
    n = min(len(a), len(b))
    differ = np.flatnonzero((a[:n] != b[:n]).any(axis=1))
    return int(differ[0]) if len(differ) else n


def neighbours(turns: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each sequence how many first turns it shares with the one before; 0 for the first."""
    out = np.zeros(len(size), dtype=np.int64)
    m = np.minimum(size[1:], size[:-1])
    some = np.flatnonzero(m)
    if len(some):
        m = m[some]
        step = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        equal = (turns[np.repeat(start[some], m) + step] == turns[np.repeat(start[some + 1], m) + step]).all(axis=1)
        place = np.where(equal, np.repeat(m, m), step)
        out[some + 1] = np.minimum.reduceat(place, np.cumsum(m) - m)
    return out


def minima(values: np.ndarray) -> list[np.ndarray]:
    """Sparse table: level k holds the least of each 2**k values in a row."""
    table = [values]
    while len(table[-1]) > 1 << (len(table) - 1):
        last, step = table[-1], 1 << (len(table) - 1)
        table.append(np.minimum(last[:-step], last[step:]))
    return table


def extents(table: list[np.ndarray], row: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far to the left and to the right of each row the sequences share its first `depth` turns, where
    the table is over what each shares with the one before."""
    n = len(table[0])
    left, right = row.copy(), row.copy()
    for k in reversed(range(len(table))):
        step, least = 1 << k, table[k]
        at = np.flatnonzero((left >= step) & (least[np.clip(left - step + 1, 0, len(least) - 1)] >= depth))
        left[at] -= step
        at = np.flatnonzero((right + step < n) & (least[np.clip(right + 1, 0, len(least) - 1)] >= depth))
        right[at] += step
    return left, right


def least_between(table: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value from a to b, both included."""
    level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
    out = np.empty(len(a), dtype=np.int64)
    for k, least in enumerate(table):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(least[a[at]], least[b[at] - (1 << k) + 1])
    return out


def prefix_names(key: bytes, most: int) -> list[bytes]:
    """Names of a sequence's first 0 .. `most` turns."""
    digest, out = hashlib.sha256(), []
    for d in range(most + 1):
        if d:
            digest.update(key[(d - 1) * NAME : d * NAME])
        out.append(digest.digest()[:16])
    return out


_PIECE = "name binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_KINDS = [pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string()]


def nodes_of(keys: list[bytes], first: np.ndarray, n: np.ndarray, ends: list[str], before: bytes | None, after: bytes | None) -> pa.Table:
    """Nodes of a range of distinct sequences in order, and pieces of those that it shares with the sequences
    before and after it; only pieces have a name."""
    order = sorted(range(len(keys)), key=keys.__getitem__)
    keys, ends, first, n = [keys[k] for k in order], [ends[k] for k in order], first[order], n[order]
    turns = np.frombuffer(b"".join(keys), dtype=np.uint32).reshape(-1, NAME // 4)
    size = np.array([len(k) // NAME for k in keys])
    start = np.cumsum(size) - size
    as_turns = lambda key: np.frombuffer(key or b"", dtype=np.uint32).reshape(-1, NAME // 4)
    low = -1 if before is None else common_turns(as_turns(before), as_turns(keys[0]))
    high = -1 if after is None else common_turns(as_turns(keys[-1]), as_turns(after))
    shared = neighbours(turns, start, size)
    table = minima(shared)
    # every candidate: depths 0 to its size of each row
    base = np.cumsum(size + 1) - (size + 1)
    row = np.repeat(np.arange(len(keys)), size + 1)
    depth = np.arange(len(row)) - base[row]
    left, right = extents(table, row, depth)
    node = np.flatnonzero(left == row)  # the leftmost owns it
    number = np.cumsum(left == row) - 1
    parent = number[base[left[node - (depth[node] > 0)]] + np.maximum(depth[node] - 1, 0)]
    row, depth, left, right = row[node], depth[node], left[node], right[node]
    opens = (left > 0) | (depth > low)
    cut = ~opens | ((right == len(keys) - 1) & (depth <= high))
    members = np.append(0, np.cumsum(n))
    here = members[right + 1] - members[left]
    last = turns[start[row] + np.maximum(depth - 1, 0)] if len(turns) else np.zeros((len(row), NAME // 4), np.uint32)
    length = np.where(depth > 0, last[:, NAME // 4 - 1].byteswap().astype(np.int64), 0)
    leaf = (depth == size[row]) & (right == left) & ((left < len(keys) - 1) | (depth > high))
    end = np.append(np.searchsorted(row, np.arange(len(keys))), len(row))[right + 1]  # after the subtree
    own = np.arange(len(row))
    between = lambda x: (s := np.append(0, np.cumsum(x)))[end] - s[own]
    born = opens & (depth > 0)
    children = np.bincount(parent[born], minlength=len(row))
    least = least_between(minima(first), left, right)
    names = [None] * len(row)
    edge = np.flatnonzero(cut)
    if len(edge):
        lefts, rights = edge[left[edge] == 0], edge[left[edge] > 0]
        for at, key in ((lefts, keys[0]), (rights, keys[-1])):
            if len(at):
                called = prefix_names(key, int(depth[at].max()))
                for k in at.tolist():
                    names[k] = called[depth[k]]
    above = cut[parent] & (depth > 0)
    closed = ~cut[parent] & (depth > 0)
    whole = depth == size[row]
    columns = [
        names, [names[p] if a else None for p, a in zip(parent.tolist(), above.tolist())], depth, least, pa.array(least[parent], mask=~closed), here, children,
        between(leaf), between(here * length - opens * length), [ends[r] if w else None for r, w in zip(row.tolist(), whole.tolist())]]
    return pa.table([x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(columns, _KINDS)], names=[c.split()[0] for c in _PIECE.split(", ")])


def _nodes(table: pa.Table, sides: pa.Table) -> pa.Table:
    if not table.num_rows:
        return pa.table([pa.array([], k) for k in _KINDS], names=[c.split()[0] for c in _PIECE.split(", ")])
    number = lambda c: np.asarray(table.column(c).combine_chunks(), dtype=np.int64)
    return nodes_of(table.column("key").to_pylist(), number("first"), number("n"), table.column("ends").to_pylist(), *(sides.column(c)[0].as_py() for c in ("before", "after")))


def prefix_trie(seqs: DataFrame, *, range_nodes: int = RANGE_NODES) -> DataFrame:
    """The trie of conversations (id, turns): one row per distinct sequence of first turns, the empty one included.

    Returns conv_id (the smallest member), depth, parent_conv_id (null for the root), n_convs, n_children,
    n_leaves (nodes without children in the subtree, itself included), saved_tokens (summed over the subtree,
    members but one times the bytes of the last text) and ends_sha256 (SHA-256 of the ids of the members
    that have no further turn, in numerical order and joined by commas; of nothing, that of no bytes).

    Equal conversations are members of the same nodes; one without turns is a member of the root alone. An
    id is one conversation, so ids that repeat count as often as they do. An empty table gives none. A turn
    is known by its name alone, however long its text; the names of one conversation are one value.
    """
    bounded_batches(seqs.sparkSession)
    rows = seqs.select("id", F.unhex(F.array_join("turns", "")).alias("key")).withColumn("name", F.unhex(F.substring(F.sha2("key", 256), 1, 32)))
    # members go on as blocks of ids: a sequence that very many share is a row for each block
    blocks = rows.groupBy("name", F.shiftright("id", ID_BITS).alias("block")).agg(
        F.first("key").alias("key"), F.min("id").alias("first"), F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids"))
    merged = blocks.repartition("name").sortWithinPartitions("name", "block").mapInArrow(_sequences, _SEQUENCE)
    merged = written(merged, "sequences")
    total = merged.agg(F.sum(F.length("key") / NAME + 1)).first()[0] or 0
    ranges = max(1, -(-int(total) // range_nodes))
    dealt = written(merged.repartitionByRange(ranges, "key").withColumn("range", F.spark_partition_id()), "ranges")
    order = Window.orderBy("range")  # one row for each range
    sides = dealt.groupBy("range").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    sides = sides.select("range", F.lag("high").over(order).alias("before"), F.lead("low").over(order).alias("after"))
    pieces = written(dealt.groupBy("range").cogroup(sides.groupBy("range")).applyInArrow(_nodes, _PIECE), "nodes")

    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    joined = pieces.filter("name is not null").groupBy("name").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"), *sums, F.max("ends_sha256").alias("ends_sha256"))
    joined = written(joined, "joined-nodes")  # at most as many as turns are shared over the edges of ranges
    every = pieces.filter("name is null").unionByName(joined)
    found = every.filter("parent is not null").drop("parent_conv_id").join(joined.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent")
    every = every.filter("parent is null").unionByName(found)
    nothing = hashlib.sha256(b"").hexdigest()
    return every.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))

