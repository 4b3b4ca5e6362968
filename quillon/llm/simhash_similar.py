"""SimHash near-dedup of texts by the similarity of their word shingles: wide fingerprints find the
candidates in BK-trees, and the shingles themselves decide.

The similarity is the share of common among all distinct shingles of two texts. Two sets of
similarity s agree on a fingerprint bit with probability 1 - acos(2s / (1 + s)) / pi. From that
follow the radius that all but a small share of the links keep to, and how many shard tables are
needed: a table names shards by some of the bits, so many that unlike fingerprints fill a shard
with about `SHARD`, and there are as many tables as leave a link unmet in all with a small
probability. Both grow slowly with the corpus (the tables with about its fourth root), and no
candidate is dropped.

Links are verified by the shingles of both texts, so none is false. A search reports only as many
candidates as connect what it found, the nearest, and these are verified by a join. Where one of them
fails, all that its candidates connect is searched once more with the shingles at hand, so that the
other candidates are verified on the spot and only links are reported. What is larger than a block is
dealt: in the first search one common member connects the blocks of a shard, in the second whatever
does not belong to the largest group meets all blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, comb, log, log2, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import bounded_batches, row_key, rows_of_keys, written
from .simhash_dedup import near_pairs
from .words import Words, chunks, spans

SHINGLE, SIMILARITY, SEED = 5, 0.8, 23
#: Bits of a fingerprint, in 64-bit words; share of the links at the very threshold that the radius, and
#: that the tables, may miss; unlike fingerprints in a shard, about; fingerprints in a block, at most about.
BITS, MISS, SHARD, BLOCK = 128, 0.01, 256, 2048
#: Candidates that a task holds before it leaves only the nearest that connect them.
PAIRS = 1 << 21
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SHINGLES = 0xD6E8FEB86659FD93


def agreement(similarity: float) -> float:
    """The probability that two sets of this similarity, of about equal size, agree on a bit."""
    return 1 - acos(2 * similarity / (1 + similarity)) / pi


def search_radius(similarity: float, bits: int = BITS, miss: float = MISS) -> int:
    """The bits that all but a share `miss` of such pairs differ in at most."""
    p, total = 1 - agreement(similarity), 0.0
    for r in range(bits + 1):
        total += comb(bits, r) * p**r * (1 - p) ** (bits - r)
        if total >= 1 - miss:
            return r
    return bits


def tables(rows: int, similarity: float, bits: int = BITS, miss: float = MISS) -> list[np.ndarray]:
    """The bits that name a shard, for each table."""
    chosen = min(bits // 2, max(0, ceil(log2(max(rows, 1) / SHARD))))
    count = 1 if not chosen else ceil(log(miss) / log(1 - agreement(similarity) ** chosen))
    rng = np.random.default_rng(SEED)
    return [np.sort(rng.choice(bits, chosen, replace=False)) for _ in range(count)]


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct names of each text's shingles, A-Z lower-cased; fewer words are one shingle,
    no word is one of its own."""
    words = Words([t.translate(_LOWER) for t in texts])
    name, first = words.names()[:, 0], words.first
    many = np.diff(first)
    counts = np.maximum(many - shingle + 1, np.minimum(many, 1))
    start = np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    end = np.minimum(start + shingle, np.repeat(first[1:], counts))
    h, edge = spans(name, _SHINGLES, start, end), np.cumsum(counts)
    return [np.unique(h[b - n : b]) if n else np.zeros(1, dtype=np.uint64) for b, n in zip(edge.tolist(), counts.tolist())]


def wide_fingerprint(s: np.ndarray) -> np.ndarray:
    """A bit is set if it is in over half of the names, each stretched to BITS bits."""
    ones, seeds = np.zeros(BITS, dtype=np.int64), np.arange(BITS // 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(0, len(s), 1 << 14):
        h = s[k : k + (1 << 14), None] ^ seeds
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(29)
        ones += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(s), bitorder="little").view(np.uint64)


def similar(x: np.ndarray, y: np.ndarray, similarity: float = SIMILARITY) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


_WORDS = [f"f{k}" for k in range(BITS // 64)]


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                sets = shingle_sets(texts, shingle)
                code = np.array([wide_fingerprint(s) for s in sets]).view(np.int64).reshape(len(sets), -1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("key"), part.column("t"), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array(list(map(len, sets)), pa.int64()), *[pa.array(c.copy()) for c in code.T]],
                    names=["id", "key", "t", "d", "n", *_WORDS])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in chunks(batch, "text"):
                sets = [s.tobytes() for s in shingle_sets(texts, shingle)]
                yield pa.RecordBatch.from_arrays([pa.array(list(map(xxhash.xxh3_128_digest, sets)), pa.binary()), pa.array(sets, pa.binary())], names=["d", "s"])

    return run


def _verified(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), similarity) for x, y in zip(batch.column("s"), batch.column("t"))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _joined(a: np.ndarray, b: np.ndarray, root: np.ndarray, linked=None) -> np.ndarray:
    """Which of the pairs, in their order, join what was apart so far, if they are `linked`; `root` is brought up to date."""
    new = np.flatnonzero(root[a] != root[b])
    if linked is None:
        new = new[np.sort(np.unique(np.stack((root[a[new]], root[b[new]])), axis=1, return_index=True)[1])]
    out, head = [], {}

    def top(x: int) -> int:
        while (y := head.get(x, x)) != x:
            head[x] = head.get(y, y)
            x = y
        return x

    for k in new.tolist():
        p, q = top(int(root[a[k]])), top(int(root[b[k]]))
        if p != q and (linked is None or linked(a[k], b[k])):
            head[max(p, q)] = min(p, q)
            out.append(k)
    settled = np.arange(len(root))
    for x in list(head):
        settled[x] = top(x)
    root[:] = settled[root]
    return np.array(out, dtype=np.int64)


def _forest(pairs: list[tuple], root: np.ndarray, linked=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As many of the pairs (a, b, how far apart) as connect all that they connect, the nearest first."""
    a, b, far = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (zip(*pairs) if pairs else ((), (), ())))
    keep = [np.zeros(0, dtype=np.int64)]
    order = np.argsort(far, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(far[order])) + 1):
        keep.append(at[_joined(a[at], b[at], root, linked)])
    at = np.concatenate(keep)
    return a[at], b[at], far[at]


def _searched(radius: int, similarity: float, verify: bool):
    """Connecting candidates of whole blocks, whose rows come in order, or with `verify` connecting links of
    what is in different groups `c`."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        d, block = table.column("d").combine_chunks(), table.column("block").to_numpy()
        code = np.stack([table.column(w).to_numpy() for w in _WORDS], axis=1).view(np.uint64)
        n = table.column("n").to_numpy()
        ask, linked, root = None, None, np.arange(len(n))
        if verify:
            ask, raw = table.column("asks").to_numpy(), table.column("s").combine_chunks()
            # groups are apart in different blocks, so that a block does not rely on what another finds
            group = np.unique(np.array(table.column("c").to_pylist(), dtype="S16"), return_inverse=True)[1]
            root = np.unique(np.stack((block, group)), axis=1, return_index=True, return_inverse=True)
            root = root[1][root[2].ravel()]
            linked = lambda x, y: similar(np.frombuffer(raw[int(x)].as_buffer(), np.uint64), np.frombuffer(raw[int(y)].as_buffer(), np.uint64), similarity)
        found, held, out = [], 0, []
        for a, b, far in near_pairs(code, block, radius, ask=ask):
            some = (root[a] != root[b]) & (np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b]) - 1e-9)
            found.append((a[some], b[some], far[some]))
            held += len(found[-1][0])
            if held > PAIRS:
                if verify:
                    out.append(_forest(found, root, linked))
                    found = []
                else:
                    found = [_forest(found, np.arange(len(n)))]
                held = sum(len(x[0]) for x in found)
        out.append(_forest(found, root, linked))
        a, b = (np.concatenate([x[k] for x in out]) for k in (0, 1))
        return pa.RecordBatch.from_arrays([d.take(pa.array(a)), d.take(pa.array(b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size = [], 0, 0
        for batch in batches:
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows > 1 << 14 or size > 1 << 25:
                table = pa.Table.from_batches(held)
                names = table.column("block").to_numpy()
                cut = int(np.argmax(names == names[-1]))  # the last block may go on
                if cut:
                    yield solve(table.slice(0, cut))
                    table = table.slice(cut)
                    held, rows, size = [x for x in table.to_batches() if x.num_rows], table.num_rows, table.nbytes
        if rows:
            yield solve(pa.Table.from_batches(held))

    return run


def _links(each: DataFrame, docs: DataFrame, text_col: str, *, shingle: int, similarity: float) -> DataFrame:
    """each(d, n, t, fingerprint) of distinct shingle sets -> links(a, b) that connect similar ones."""
    radius = search_radius(similarity)
    masks = []
    for bits in tables(each.count(), similarity):
        words = [sum(1 << int(b % 64) for b in bits if b // 64 == k) for k in range(BITS // 64)]
        masks.append([m - (1 << 64) if m >> 63 else m for m in words])
    shard = F.explode(F.array(*[F.xxhash64(F.lit(k), *[F.col(w).bitwiseAND(F.lit(m)) for w, m in zip(_WORDS, row)]) for k, row in enumerate(masks)])).alias("shard")
    row = ["d", "n", *_WORDS]
    posts = each.select(shard, *row)

    def search(dealt: DataFrame, verify: bool, label: str) -> DataFrame:
        columns = ["block", *row, *(["asks", "c", "s"] if verify else [])]
        order = ["block", "asks"] if verify else ["block"]
        found = dealt.select(*columns).repartition("block").sortWithinPartitions(*order).mapInArrow(_searched(radius, similarity, verify), "a binary, b binary")
        return written(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), label)

    def sets_of(met: DataFrame, label: str) -> DataFrame:
        """The shingle sets of met(d, t)."""
        met = written(met.select("t").distinct(), f"{label}-met")
        texts = docs.select(F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text")).join(met, "t")
        return written(texts.select("text").mapInArrow(_sets(shingle), "d binary, s binary").dropDuplicates(["d"]), f"{label}-sets")

    # once: within blocks, and what connects the candidates
    large = posts.groupBy("shard").agg(F.count("*").alias("rows")).filter(F.col("rows") > BLOCK)
    large = written(large.select("shard", F.ceil(F.col("rows") / (BLOCK // 2)).cast("int").alias("parts")), "large-shards")
    common = posts.join(large, "shard").groupBy("shard").agg(F.min(F.struct(*row)).alias("x"), F.first("parts").alias("parts"))
    common = common.select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "x.*")
    dealt = posts.join(large, "shard", "left").select("shard", F.pmod(F.xxhash64("d"), F.coalesce("parts", F.lit(1))).alias("part"), *row)
    dealt = dealt.unionByName(common).withColumn("block", F.xxhash64("shard", F.col("part").cast("long")))
    pairs = search(dealt, False, "candidates")
    ends = pairs.select(F.col("a").alias("d")).union(pairs.select(F.col("b").alias("d"))).distinct()
    sets = sets_of(ends.join(each.select("d", "t"), "d"), "candidates")
    both = pairs.join(sets.withColumnRenamed("d", "a"), "a").join(sets.select(F.col("d").alias("b"), F.col("s").alias("t")), "b")
    links = written(both.select("a", "b", "s", "t").mapInArrow(_verified(similarity), "a binary, b binary"), "links")

    # again, where one of these failed or a shard was cut: all that candidates connect
    near = written(components(pairs).withColumnRenamed("component_id", "k"), "near")
    failed = pairs.join(links, ["a", "b"], "left_anti").select(F.col("a").alias("id"))
    cut = posts.join(large, "shard", "left_semi").select(F.col("d").alias("id"))
    open_ = written(near.join(failed.union(cut).distinct(), "id").select("k").distinct(), "open")
    rest = near.join(open_, "k").withColumnRenamed("id", "d").join(components(links).withColumnRenamed("id", "d"), "d", "left")
    rest = rest.select("k", "d", F.coalesce("component_id", "d").alias("c")).join(each.select(*row), "d")
    rest = written(rest.join(sets, "d").withColumn("size", 1 + F.col("n") / 2048), "open-rows")
    sums = rest.groupBy("k", "c").agg(F.sum("size").alias("x"), F.count("*").alias("rows")).groupBy("k")
    sums = sums.agg(F.max_by("c", F.struct("rows", "c")).alias("most"), F.max_by("x", F.struct("rows", "c")).alias("many"), F.sum("x").alias("x"), F.count("*").alias("groups"))
    block = BLOCK // 4  # smaller ones: here pairs are verified, not only found
    parts = lambda x: F.when(F.col("x") > block, F.ceil(x / block)).otherwise(1).cast("int")
    sums = sums.filter("groups > 1").select("k", "most", parts(F.col("many")).alias("hosts"), parts(F.col("x") - F.col("many")).alias("guests"))
    rest = rest.join(written(sums, "open-sizes"), "k").withColumn("asks", F.col("c") != F.col("most"))
    own = F.pmod(F.xxhash64("d"), F.when(F.col("asks"), F.col("guests")).otherwise(F.col("hosts"))).cast("int")
    every = lambda n, f: F.transform(F.sequence(F.lit(0), n - 1), f)
    # the largest group's parts each meet every part of the others, and these each other
    meets = F.when(~F.col("asks"), every(F.col("guests"), lambda j: F.struct(own.alias("i"), j.alias("j")))).otherwise(F.concat(
        every(F.col("hosts"), lambda i: F.struct(i.alias("i"), own.alias("j"))),
        F.filter(every(F.col("guests"), lambda j: F.struct((-1 - F.least(own, j)).alias("i"), F.greatest(own, j).alias("j"))), lambda x: F.col("guests") > 1)))
    dealt = rest.withColumn("m", F.explode(meets)).withColumn("block", F.xxhash64("k", "m.i", "m.j"))
    return links.unionByName(search(dealt, True, "more-links"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The documents that stay, one of each group, with all their columns.

    Documents whose sets of `shingle`-word shingles have at least this similarity link, and groups
    are what links, directly or over others. A-Z are lower-cased; fewer words are one shingle; null,
    empty and blank texts are alike. The smallest id stays, null being larger than any other, and of
    rows that share it, and of repeated rows, the one with the smallest row_key. Rows of equal ids
    and unlike texts all stay. Texts are read whole, however long. Columns may have any names. An
    empty table gives none. No link is false; of the links of exactly this similarity about one in
    thirty may be missed, of closer ones far fewer."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), row_key(docs, text_col).alias("key"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    rows = written(base.mapInArrow(_fingerprints(shingle), f"id {kind}, key binary, t long, d binary, n long, {', '.join(f'{w} long' for w in _WORDS)}"), "fingerprints")
    lowest = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("low")
    each = written(rows.groupBy("d").agg(lowest, *[F.first(c).alias(c) for c in ("n", *_WORDS)], F.min("t").alias("t")), "distinct-sets")
    groups = components(_links(each, docs, text_col, shingle=shingle, similarity=similarity))
    whole = each.select("d", "low").join(groups.withColumnRenamed("id", "d"), "d", "left")
    stay = whole.groupBy(F.coalesce("component_id", "d").alias("c")).agg(F.min("low").alias("low")).select(F.col("low.key").alias("key"))
    return rows_of_keys(docs, written(stay, "stay"), text_col)
