"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked by BK-trees over shards.

Fingerprints within `radius` bits agree on at least one of radius + 1 bit blocks, so each goes
to one shard per block, named by that block's bits. A shard with more than `limit` fingerprints
is divided again: of its other bits, cut into 6 blocks, two fingerprints within 3 bits agree on
at least 3, which gives 20 finer shards; and once more. After that at most 2**12 fingerprints
fit a shard, whatever the data, and no candidate is ever dropped.

A task holds many whole shards as one forest of BK-trees. Children hang below their parent by
their distance from it; a search goes down only edges within the radius of its own distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import bounded_batches, written

SHINGLE, RADIUS, LIMIT = 3, 3, 256
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BITS = np.arange(64, dtype=np.uint64)
_ROWS = 1 << 15


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """A hash of each run of `shingle` words; of all words if there are fewer. No word: none."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined, size = b" ".join(words), len(words)
    if size <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, size) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: size - shingle + 1].tolist()
    ends = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends)], dtype=np.uint64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """A bit is set if it is in over half of the shingles' hashes. No word: zero."""
    h = shingle_hashes(text, shingle)
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), _ROWS):
        bits = np.unpackbits(h[k : k + _ROWS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << _BITS)[ones * 2 > len(h)].sum(dtype=np.uint64))


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint((x.as_py() or "").encode(), shingle) for x in batch.column("text")]
            values = np.array(found, dtype=np.uint64).view(np.int64)
            rest = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in rest] + [pa.array(values)], names=[*rest, "f"])

    return run


# ---- the forest of one task --------------------------------------------------


def near_pairs(code: np.ndarray, shard: np.ndarray, radius: int = RADIUS, step: int = 1 << 20, ask: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index pairs (earlier, later), and how far apart, of codes of equal shard within `radius` bits, found in one BK-tree per
    shard; of the later ones only those that `ask`. A code is a 64-bit word, or a row of several.

    `shard` is sorted. Trees grow level by level: of the codes that reached a node, the first at
    each distance becomes its child there and the others move down to it. A search keeps a
    frontier of (code, node) and follows children whose edge is within the radius."""
    n = len(code)
    if n < 2:
        return
    code = code.reshape(n, -1)
    span = 64 * code.shape[1] + 1  # more than any distance

    def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(code[a] ^ code[b]).sum(axis=1, dtype=np.int64)

    first = np.ones(n, dtype=bool)
    first[1:] = shard[1:] != shard[:-1]
    root = np.flatnonzero(first)[np.cumsum(first) - 1]
    parent, edge = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64)
    waiting = np.flatnonzero(~first)
    at = root[waiting]
    while len(waiting):
        far = apart(waiting, at)
        _, child, which = np.unique(at * span + far, return_index=True, return_inverse=True)
        new = waiting[child]
        parent[new], edge[new] = at[child], far[child]
        moved = new[which]
        stay = moved != waiting
        waiting, at = waiting[stay], moved[stay]
    order = np.lexsort((edge, parent))
    order = order[np.searchsorted(parent[order], 0) :]
    key = parent[order] * (2 * span) + edge[order]  # children by parent, then by edge
    size = max(1, min(n, step // 64))
    asking = np.arange(n) if ask is None else np.flatnonzero(ask)
    for a in range(0, len(asking), size):
        query = asking[a : a + size]
        node = root[query]
        while len(query):
            far = apart(query, node)
            hit = (far <= radius) & (node < query)
            if hit.any():
                yield node[hit], query[hit], far[hit]
            low = np.searchsorted(key, node * (2 * span) + np.maximum(far - radius, 0))
            high = np.searchsorted(key, node * (2 * span) + np.minimum(far + radius, span), side="right")
            count = high - low
            some = count > 0
            low, count = low[some], count[some]
            query = np.repeat(query[some], count)
            node = order[np.repeat(low - np.cumsum(count) + count, count) + np.arange(len(query))]


def _spanning(a: np.ndarray, b: np.ndarray, head: dict[int, int]) -> list[tuple[int, int]]:
    """The links that join what was apart so far."""
    def top(x: int) -> int:
        while (y := head.get(x, x)) != x:
            head[x] = head.get(y, y)
            x = y
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = top(x), top(y)
        if p != q:
            head[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _link(radius: int):
    """Links of whole shards; their rows come in order."""

    def solve(shard: np.ndarray, code: np.ndarray) -> pa.RecordBatch:
        head: dict[int, int] = {}
        out: list[tuple[int, int]] = []
        bits = code.view(np.uint64)
        for a, b, _ in near_pairs(bits, shard, radius):
            out += _spanning(a, b, head)
        pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(code[pairs[:, 0]]), pa.array(code[pairs[:, 1]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, codes = [], []
        rows = 0
        for batch in batches:
            shards.append(np.asarray(batch.column("shard")))
            codes.append(np.asarray(batch.column("f")))
            rows += batch.num_rows
            if rows > _ROWS:
                shard, code = np.concatenate(shards), np.concatenate(codes)
                cut = int(np.searchsorted(shard, shard[-1]))  # the last shard may go on
                if cut:
                    yield solve(shard[:cut], code[:cut])
                shards, codes, rows = [shard[cut:]], [code[cut:]], 0
        if shards:
            yield solve(np.concatenate(shards), np.concatenate(codes))

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A finer shard for each choice of 3 of 6 blocks of the bits that `used` leaves open."""
    names = ["f", "used", "shard"]
    for batch in batches:
        f = np.asarray(batch.column("f")).view(np.uint64)
        used = np.asarray(batch.column("used")).view(np.uint64)
        shard = np.asarray(batch.column("shard")).view(np.uint64)
        for mask in np.unique(used):
            at = np.flatnonzero(used == mask)
            free = [b for b in range(64) if not int(mask) >> b & 1]
            size = len(free) // 6
            blocks = [np.uint64(sum(1 << b for b in free[k * size : (k + 1) * size if k < 5 else None])) for k in range(6)]
            for pick in combinations(blocks, 3):
                more = np.uint64(sum(int(x) for x in pick))
                name = _name(shard[at] ^ more, f[at] & more)
                yield pa.RecordBatch.from_arrays([pa.array(f[at].view(np.int64)), pa.array(np.full(len(at), mask | more).view(np.int64)), pa.array(name.view(np.int64))], names=names)


def _name(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A shard's name from that of the coarser one and the bits added. Should two ever get the same, they are searched as one."""
    h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def link_fingerprints(prints: DataFrame, *, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """prints(f) of distinct 64-bit fingerprints -> links(a, b) that connect all pairs within
    `radius` bits (a spanning part of them; none that is farther)."""
    if not 0 <= radius <= 3:
        raise ValueError("radius must be from 0 to 3")
    size = 64 // (radius + 1)
    masks = [((1 << size) - 1) << (size * k) for k in range(radius + 1)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    wanted = F.explode(F.array(*[F.struct(F.lit(m).alias("used"), F.xxhash64(F.lit(k), F.col("f").bitwiseAND(F.lit(m))).alias("shard")) for k, m in enumerate(signed)])).alias("s")
    level = prints.select("f", wanted).select("f", "s.used", "s.shard")
    ready = None
    for _ in range(2):
        counts = level.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > limit).select("shard")
        counts = written(counts, "large-shards")
        fit = level.join(counts, "shard", "left_anti").select("f", "shard")
        ready = fit if ready is None else ready.unionByName(fit)
        large = level.join(counts, "shard", "left_semi").select("f", "used", "shard")
        level = large.mapInArrow(_spread, "f long, used long, shard long")
    ready = ready.unionByName(level.select("f", "shard"))
    return ready.repartition("shard").sortWithinPartitions("shard").mapInArrow(_link(radius), "a long, b long")


def simhash_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Groups documents whose fingerprints link, directly or over others, at `radius` bits or fewer.

    Returns one row per row of `docs`: the id, fingerprint (16 lower-case hex digits),
    component_id (the smallest id in the group) and kept (the id is component_id). A-Z are
    lower-cased; a shingle is `shingle` words joined by spaces, repeats included; fewer words give
    their whole sequence; null, empty and blank texts have fingerprint zero, and link with each
    other and with any fingerprint near zero. Repeated rows link and are kept alike. Null ids are
    left out of the minimum; a group of none but null ids has a null component_id. Texts are read
    whole, however long. Other columns of `docs` are not read. An empty table gives none.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    prints = written(base.mapInArrow(_fingerprints(shingle), f"id {kind}, f long"), "fingerprints")
    each = written(prints.groupBy("f").agg(F.min("id").alias("low")), "distinct-fingerprints")
    groups = components(link_fingerprints(each.select("f"), radius=radius))
    grouped = each.join(groups.withColumnRenamed("id", "f"), "f", "left")
    whole = grouped.select("f", "low", F.coalesce("component_id", "f").alias("c"))
    lows = whole.groupBy("c").agg(F.min("low").alias("component_id"))
    named = written(whole.join(lows, "c").select("f", "component_id"), "classes")
    out = prints.join(named, "f")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
