"""Embedding near-dedup over an inverted multi-index.

Vectors are scaled to length one and cut in two halves; each half has its own codebook, trained
on a bounded sample, and the pairs of nearest codes form a grid of cells. A vector lives in one
cell. As a query it visits the cells of the grid by multi-sequence traversal: both halves' codes
are ranked by how near their regions come, and of the pairs at the edge of what was visited so far
the nearest is next, until none can hold what is looked for. What lies behind the border of two
codes' regions is at least the distance to that border away, so at a target recall of 1.0 the
traversal stops at the radius of the threshold and no link can be missed. Below 1.0 it stops where
that share of made-up neighbours at the very threshold, drawn around the sample, have been reached.
What cells hold is then verified by its cosine in double precision.

Equal vectors of one label are one class with a multiplicity, so copies never meet as pairs. A
cell's residents and visitors are dealt to blocks of at most `block` each, every pair of blocks
is one matrix product, and a block reports counts and a spanning part of its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import written

#: Least number of codes per half; they grow with the cube root of the vectors of a label beyond `FEW`.
CODES, FEW = 8, 8192
#: Vectors that codebooks are trained on (or 16 for each code), and vectors in a block.
SAMPLE, BLOCK, ROUNDS, SEED = 4096, 512, 12, 11


def _matrix(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    """Rows of equally long arrays, or of binary numbers of the given kind, as doubles."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1).astype(np.float64)
    return np.asarray(column.flatten().cast(pa.float64())).reshape(len(column), -1)


def unit_halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    return unit[:, : x.shape[1] // 2], unit[:, x.shape[1] // 2 :]


def train_codes(points: np.ndarray, codes: int, seed: int = SEED, rounds: int = ROUNDS) -> np.ndarray:
    """k-means from a seeded start; fewer codes if there are fewer distinct points."""
    points = np.unique(points, axis=0)
    rng = np.random.default_rng(seed)
    centre = points[rng.choice(len(points), min(codes, len(points)), replace=False)]
    for _ in range(rounds):
        near = np.argmin(((points[:, None] - centre[None]) ** 2).sum(-1), axis=1)
        centre = np.array([points[near == k].mean(axis=0) if (near == k).any() else centre[k] for k in range(len(centre))])
    return centre


def region_gaps(points: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest code, lower bound of the distance from each point to each code's region). Points and
    codes may have unlike lengths; what is missing counts as zeros."""
    size = min(points.shape[1], centre.shape[1])
    square = (points**2).sum(1)[:, None] - 2 * points[:, :size] @ centre[:, :size].T + (centre**2).sum(1)[None]
    near = square.argmin(axis=1)
    apart = np.sqrt(((centre[:, None] - centre[None]) ** 2).sum(-1))[near]
    excess = square - square[np.arange(len(points)), near][:, None]
    return near, np.where(apart > 0, excess / np.where(apart > 0, 2 * apart, 1), 0.0)


def multi_sequence(first: np.ndarray, second: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of the product grid in the order of first[v, i] + second[v, j], for all rows v at once and up to
    `limit`: (v, i, j), each row's cells in its order.

    Both costs are ranked; of each rank in the first half only its next rank in the second is in
    question, and only once the rank before it is further on."""
    n, width = first.shape
    left, right = np.argsort(first, axis=1), np.argsort(second, axis=1)
    a, b = np.take_along_axis(first, left, axis=1), np.take_along_axis(second, right, axis=1)
    b = np.concatenate((b, np.full((n, 1), np.inf)), axis=1)  # beyond the last
    at = np.zeros((n, width), dtype=np.int64)
    cost = np.full((n, width + 1), np.inf)
    cost[:, 0] = a[:, 0] + b[:, 0]
    rows, out = np.arange(n), []
    while True:
        pick = cost[rows].argmin(axis=1)
        go = cost[rows, pick] <= limit
        rows, pick = rows[go], pick[go]
        if not len(rows):
            break
        here = at[rows, pick]
        out.append((rows, left[rows, pick], right[rows, here]))
        at[rows, pick] = here = here + 1
        before = np.where(pick > 0, at[rows, np.maximum(pick - 1, 0)], np.iinfo(np.int64).max)
        cost[rows, pick] = np.where(before > here, a[rows, pick] + b[rows, here], np.inf)
        some = pick + 1 < width
        r, p = rows[some], pick[some] + 1
        wakes = ~np.isfinite(cost[r, p]) & (at[r, p] < here[some])
        r, p = r[wakes], p[wakes]
        cost[r, p] = a[r, p] + b[r, at[r, p]]
    if not out:
        return (np.zeros(0, dtype=np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out))


def stop_radius(sample: np.ndarray, first: np.ndarray, second: np.ndarray, threshold: float, target: float) -> float:
    """How far the traversal must go for the target recall: at 1.0 as far as a link can reach; below, so far
    that it meets that share of neighbours drawn at random at the threshold's distance from the sample."""
    radius = float(np.sqrt(2 - 2 * threshold))
    if target >= 1:
        return radius
    rng = np.random.default_rng(SEED)
    unit = sample / np.linalg.norm(sample, axis=1)[:, None]
    side = rng.normal(size=unit.shape)
    side -= (side * unit).sum(axis=1)[:, None] * unit
    other = threshold * unit + np.sqrt(1 - threshold**2) * side / np.linalg.norm(side, axis=1)[:, None]
    home, there = [], []
    for x, out in ((unit, home), (other, there)):
        for half, centre in zip(unit_halves(x), (first, second)):
            out.append(region_gaps(half, centre))
    at = np.arange(len(unit))
    cells = [h[0][0] * len(second) + h[1][0] for h in (home, there)]
    # the one whose cell comes first visits the other's
    gap = [np.sqrt(x[0][1][at, y[0][0]] ** 2 + x[1][1][at, y[1][0]] ** 2) for x, y in ((home, there), (there, home))]
    return min(radius, float(np.quantile(np.where(cells[0] <= cells[1], *gap), target)))


def _visits(first: np.ndarray, second: np.ndarray, radius: float, kind: type):
    """Each vector's own cell and the cells it visits, as rows for the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = np.asarray(batch.column("size"))
            for size in np.unique(length):
                same = batch.take(pa.array(np.flatnonzero(length == size)))
                for at in range(0, same.num_rows, 1024):
                    part = same.slice(at, 1024)
                    left, right = unit_halves(_matrix(part.column("vector"), kind))
                    i, gap_i = region_gaps(left, first)
                    j, gap_j = region_gaps(right, second)
                    home = i * len(second) + j
                    row, a, b = multi_sequence(gap_i**2, gap_j**2, radius * radius + 1e-9)
                    cell = a * len(second) + b
                    visit = cell > home[row]  # the other way round, the neighbour comes here
                    row, cell = row[visit], cell[visit]
                    rows = np.concatenate((np.arange(len(home)), row))
                    cells, guest = np.concatenate((home, cell)).astype(np.int32), np.arange(len(rows)) >= len(home)
                    for k in range(0, len(rows), 8192):
                        pick = pa.array(rows[k : k + 8192])
                        yield pa.RecordBatch.from_arrays(
                            [part.column("label").take(pick), part.column("size").take(pick), pa.array(cells[k : k + 8192]), pa.array(guest[k : k + 8192]), part.column("key").take(pick), part.column("n").take(pick), part.column("vector").take(pick)],
                            names=["label", "size", "cell", "visits", "key", "n", "vector"])

    return run


def _compare(threshold: float, kind: type):
    """Counts and spanning links of whole blocks; their rows come in order, residents first."""
    schema = pa.schema([("key", pa.binary()), ("links", pa.int64()), ("to", pa.binary())])

    def solve(part: pa.RecordBatch) -> pa.RecordBatch | None:
        visits = part.column("visits").to_numpy(zero_copy_only=False)
        x = _matrix(part.column("vector"), kind)
        names, keys = np.unique(np.array(part.column("key").to_pylist(), dtype="S16"), return_inverse=True)
        n = np.asarray(part.column("n"))
        unit = x / np.linalg.norm(x, axis=1)[:, None]
        stay, come = np.flatnonzero(~visits), np.flatnonzero(visits)
        if not len(stay) or not len(come):
            return None
        near = unit[come] @ unit[stay].T >= threshold
        if part.column("within")[0].as_py():  # the block against itself: each pair once, none with itself
            near &= keys[come][:, None] < keys[stay][None, :]
        if not near.any():
            return None
        key = np.concatenate((keys[come], keys[stay]))
        links = np.concatenate((near @ n[stay], near.T @ n[come]))
        # label both sides by the smallest key that they reach within the block
        low, size = key.copy(), len(come)
        while True:
            was = low.copy()
            low[:size] = np.minimum(low[:size], np.where(near, low[None, size:], len(names)).min(axis=1))
            low[size:] = np.minimum(low[size:], np.where(near, low[:size, None], len(names)).min(axis=0))
            if (was == low).all():
                break
        some = links > 0
        text = lambda k: pa.array([x.ljust(16, b"\0") for x in names[k].tolist()], pa.binary())
        return pa.RecordBatch.from_arrays([text(key[some]), pa.array(links[some]), text(low[some])], schema=schema)

    def edges(batch: pa.RecordBatch) -> np.ndarray:
        names = np.stack([np.asarray(batch.column(c)) for c in ("block", "more")])
        return np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held:
            batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            bounds = [0, *edges(batch).tolist(), batch.num_rows]
            for a, b in zip(bounds[:-1], bounds[1:]):
                if got := solve(batch.slice(a, b - a)):
                    yield got

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if held and any(batch.column(c)[0] != held[-1].column(c)[-1] for c in ("block", "more")):
                yield from flush(held)
                held = []
            inner = edges(batch)
            if len(inner):
                yield from flush([*held, batch.slice(0, inner[-1])])
                held, batch = [], batch.slice(inner[-1])
            held.append(batch)
        yield from flush(held)

    return run


def near_links(classes: DataFrame, *, threshold: float, codes: int | None = None, sample: int = SAMPLE, block: int = BLOCK, target: float = 1.0, kind: type = np.float64) -> DataFrame:
    """classes(label, size, key, n, vector as `kind` numbers in bytes) -> (key, links, to): how many vectors
    each links to, in parts, and a key that it is connected with. Only vectors of equal label and size meet."""
    if codes is None:
        most = classes.groupBy("label", "size").agg(F.count("*").alias("k")).agg(F.max("k")).first()[0] or 0
        codes = max(CODES, round(CODES * (most / FEW) ** (1 / 3)))
    ranked = classes.select("size", "vector", F.xxhash64("vector").alias("h")).orderBy("h").limit(max(sample, 16 * codes))
    chosen = [_matrix(pa.array([bytes(r.vector)], pa.binary()), kind) for r in ranked.collect()]  # bounded: at most so many vectors
    halves = [unit_halves(x) for x in chosen] or [(np.zeros((1, 1)), np.zeros((1, 1)))]
    width = [max(h[k].shape[1] for h in halves) for k in (0, 1)]
    first, second = (train_codes(np.concatenate([np.pad(h[k], ((0, 0), (0, width[k] - h[k].shape[1]))) for h in halves]), codes) for k in (0, 1))
    sizes = [x.shape[1] for x in chosen]
    usual = max(set(sizes), key=sizes.count) if sizes else 1
    radius = stop_radius(np.concatenate([x for x in chosen if x.shape[1] == usual] or [np.ones((1, 1))]), first, second, threshold, target)
    placed = classes.mapInArrow(_visits(first, second, radius, kind), f"label {classes.schema['label'].dataType.simpleString()}, size int, cell int, visits boolean, key binary, n long, vector binary")
    placed = written(placed, "cells")
    where = ["label", "size", "cell"]
    counts = placed.groupBy(*where).agg(F.count_if("visits").alias("v"), F.count_if(~F.col("visits")).alias("r"))
    parts = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / block)).cast("int")
    counts = written(counts.select(*where, parts("v").alias("vs"), parts("r").alias("rs")), "cell-sizes")
    rows = placed.join(counts, where)
    side = lambda name, count: F.pmod(F.xxhash64("key", F.lit(name)), F.col(count)).cast("int")
    own, guest = side("r", "rs"), side("v", "vs")
    # a visitor meets every block of residents; residents also meet each other, the later block as visitors
    deal = lambda i, j, visits, among: F.struct(i.alias("i"), j.alias("j"), F.lit(visits).alias("visits"), F.lit(among).alias("among"))
    every = lambda count: F.sequence(F.lit(0), F.col(count) - 1)
    visitor = F.transform(every("rs"), lambda i: deal(i, guest, True, False))
    host = F.transform(every("vs"), lambda j: deal(own, j, False, False))
    lower = F.transform(F.filter(every("rs"), lambda j: j >= own), lambda j: deal(own, j, False, True))
    upper = F.transform(F.filter(every("rs"), lambda i: i <= own), lambda i: deal(i, own, True, True))
    dealt = rows.withColumn("d", F.explode(F.when(F.col("visits"), visitor).otherwise(F.concat(host, lower, upper))))
    name: list[Column] = [*map(F.col, where), F.col("d.i"), F.col("d.j"), F.col("d.among")]
    dealt = dealt.select(F.xxhash64(*name).alias("block"), F.xxhash64(F.lit("more"), *name).alias("more"), "d.visits", (F.col("d.among") & (F.col("d.i") == F.col("d.j"))).alias("within"), "key", "n", "vector")
    return dealt.repartition("block").sortWithinPartitions("block", "more").mapInArrow(_compare(threshold, kind), "key binary, links long, to binary")


def embedding_dedup(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, codes: int | None = None, sample: int = SAMPLE, block: int = BLOCK, target: float = 1.0) -> DataFrame:
    """Links vectors of equal label whose cosine, in double precision, is at least `threshold`.

    Returns one row per row of `vectors`: the id, n_links (other rows linked directly),
    component_id (the smallest id reachable) and kept (the id is component_id). Vectors that are
    null, zero or hold nulls, infinities or NaN, and rows without a label, link with nothing and
    are kept. Vectors of different lengths do not link; of any length all take part. Repeated rows
    are equal vectors: each links with the other. Null ids are left out of minima. Ties at the
    threshold link. Other columns are not read, whatever their names. An empty table gives none.
    `target` is the share of links at the very threshold that the traversal must reach; 1.0 misses
    none.
    """
    kind = np.float32 if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else np.float64
    base = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.col("label").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    base = base.select("id", F.when(usable, F.col("label")).alias("label"), F.when(usable, F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))).alias("v"))
    # a class is named by 128 bits of its label and vector: two hashes from different starts
    name = F.unhex(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(k), "label", "v")), 16, "0") for k in (0, 1)]))
    base = written(base.withColumn("key", F.when(F.col("label").isNotNull(), name)), "vectors")
    classes = base.filter("label is not null").groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = written(classes.withColumn("size", F.size("v")), "classes")
    packed = classes.select("label", "size", "key", "n", "v").mapInArrow(_packed(kind), f"label {base.schema['label'].dataType.simpleString()}, size int, key binary, n long, vector binary")
    link_parts = written(near_links(packed, threshold=threshold, codes=codes, sample=sample, block=block, target=target, kind=kind), "link-parts")
    counts = written(link_parts.groupBy("key").agg(F.sum("links").alias("links")), "link-counts")
    groups = written(components(link_parts.select(F.col("key").alias("a"), F.col("to").alias("b"))), "groups")
    whole = classes.select("key", "n", "low").join(groups.withColumnRenamed("id", "key"), "key", "left").join(counts, "key", "left")
    whole = written(whole.select("key", F.coalesce("component_id", "key").alias("c"), "low", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "components")
    lows = written(whole.groupBy("c").agg(F.min("low").alias("component_id")), "component-lows")
    named = written(whole.join(lows, "c").select("key", "n_links", "component_id"), "named")
    out = base.select("id", "key").join(named, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _packed(kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.asarray(v.values).astype(kind).tobytes() for v in batch.column("v")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("label", "size", "key", "n")], pa.array(vectors, pa.binary())], names=["label", "size", "key", "n", "vector"])

    return run
