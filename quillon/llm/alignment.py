"""Alignment of two tokenizers: which of their tokens cover the same bytes, and how often which pairs meet.

No token of either vocabulary crosses from a character that is no white space to a blank, so a text is
cut there into units, and a batch aligns each of its different units once.

Pairs are counted outside of memory. A batch of documents sorts its pairs by radix (a digit of the
second side's id), then by side, and writes one zstd run for each digit; which document holds which pair
how often stays with the batch. Runs of many batches are merged by a heap over their next side, which
gives one run of sums; those runs go to finer radix buckets and are merged again. As a merge goes side by
side, it knows each side's highest count when it leaves it. Counts and highest ones then go back the way
the runs came, to the batches and their documents.

A run holds a pair once however many documents have it, and a bucket of the last merge gets one run from
each of many batches, so a pair, or a side, that a third of all links have is no larger part there.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters
from .packing import pack, unpack
from .shared import bounded_batches, written
from .words import mix

#: Characters of text in a batch, and documents among them.
BATCH_BYTES, BATCH_DOCS = 6 << 20, 8192
#: Digits of the first radix; bytes of runs that make a wave, merged digit by digit; pairs in a bucket of the last merge.
DIGITS, WAVE_BYTES, BUCKET_PAIRS = 32, 64 << 20, 250_000
#: Bytes that a pair and its sum take in a packed run, about.
PAIR_BYTES = 4
#: A side is spread over one bucket in so many.
SPREAD = 64
#: Where no token of either vocabulary crosses: before a blank, after what no version of Unicode takes for white space.
BORDER = re.compile("(?<=[^\\s\u180e\u200b\ufeff])(?= )")


class Units:
    """Alignment of many units, one behind the other: n_a, n_b and n_groups of each (0 where the tokens of a side are
    not the bytes of the unit, which `bad` says), the groups as text, and the pairs of its links (side b in the upper
    32 bits), those of unit k from edge[k] to edge[k + 1]."""

    def __init__(self, raw: list[bytes], a: list[list[int]], b: list[list[int]], bytes_a: list[bytes], bytes_b: list[bytes]):
        size = np.array([len(x) for x in raw], dtype=np.int64)
        flat, length, count, edge = [], [], [], []
        self.bad = np.zeros(len(raw), dtype=bool)
        for ids, known in ((a, bytes_a), (b, bytes_b)):
            tokens = [*chain.from_iterable(ids)]
            flat.append(np.array(tokens, dtype=np.int64))
            length.append(np.array([*map(len, map(known.__getitem__, tokens))], dtype=np.int64))
            count.append(np.array([*map(len, ids)], dtype=np.int64))
            edge.append(np.append(0, np.cumsum(count[-1])))
            sums = np.append(0, np.cumsum(length[-1]))[edge[-1]]
            if (np.diff(sums) != size).any() or b"".join(map(known.__getitem__, tokens)) != b"".join(raw):
                self.bad |= np.array([b"".join([known[k] for k in x]) != y for x, y in zip(ids, raw)], dtype=bool)
        if self.bad.any():
            keep = [~np.repeat(self.bad, n) for n in count]
            flat, length = ([x[k] for x, k in zip(y, keep)] for y in (flat, length))
            count = [np.where(self.bad, 0, n) for n in count]
            edge = [np.append(0, np.cumsum(n)) for n in count]
        (flat_a, flat_b), (length_a, length_b), (self.n_a, self.n_b), (edge_a, _) = flat, length, count, edge
        end_a, end_b = np.cumsum(length_a), np.cumsum(length_b)
        low, high = np.searchsorted(end_b, end_a - length_a, side="right"), np.searchsorted(end_b - length_b, end_a, side="left")
        many = high - low  # tokens of side b that share a byte with each of side a
        other = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
        self.pairs = flat_b[other].astype(np.uint64) << np.uint64(32) | np.repeat(flat_a, many).astype(np.uint64)
        self.edge = np.append(0, np.cumsum(many))[edge_a]
        # groups end where tokens of both sides end
        cut = np.flatnonzero(np.isin(end_a, end_b, assume_unique=True)) if len(end_a) else np.zeros(0, np.int64)
        to_a, to_b = (cut + 1).tolist(), (np.searchsorted(end_b, end_a[cut]) + 1).tolist()
        name_a, name_b = ([*map(str, x.tolist())] for x in (flat_a, flat_b))
        text = [f"{','.join(name_a[i:j])}|{','.join(name_b[k:m])}" for i, j, k, m in zip([0, *to_a], to_a, [0, *to_b], to_b)]
        border = np.searchsorted(cut, edge_a)
        self.n_groups = np.diff(border)
        border = border.tolist()
        self.text = [text[i] if j == i + 1 else ";".join(text[i:j]) for i, j in zip(border, border[1:])]


class Tokenizers:
    """Both vocabularies, with the bytes of each token."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs as many tasks as there are cores
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = {letter: k for k, letter in enumerate(byte_letters())}
        with open(path_a, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            if all(c in byte for c in token):
                self.bytes_a[k] = bytes(byte[c] for c in token)
        piece = self.b.id_to_piece
        self.bytes_b = [bytes([int(piece(k)[3:5], 16)]) if self.b.is_byte(k) else piece(k).replace("▁", " ").encode() for k in range(self.b.get_piece_size())]
        self.blank = self.b.piece_to_id("▁")

    def units(self, texts: list[str]) -> Units:
        ids_a, ids_b = [], []
        for at in range(0, len(texts), 4096):
            some = texts[at : at + 4096]
            ids_a += [e.ids for e in self.a.encode_batch(some, add_special_tokens=False)]
            ids_b += self.b.encode([u[1:] for u in some], num_threads=1)  # it puts the first blank there itself
        return Units([t.encode() for t in texts], ids_a, [b or [self.blank] for b in ids_b], self.bytes_a, self.bytes_b)


@lru_cache(maxsize=2)
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    """One for each worker process."""
    return Tokenizers(path_a, path_b)


# ---- runs -----------------------------------------------------------------------


def sides(runs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, slice]], np.ndarray | None]]:
    """Merges runs of (pairs in order, times), side by side: the pairs of a side, their sums, the pieces of
    the runs that hold them, and to which pair each item of those pieces belongs (None: in order, there is one piece)."""
    heads, edges, heap = [], [], []
    for k, (pairs, _) in enumerate(runs):
        side = pairs >> np.uint64(32)
        cut = np.flatnonzero(np.diff(side)) + 1
        edges.append([0, *cut.tolist(), len(pairs)])
        heads.append([int(side[0]), *side[cut].tolist()])
        heap.append((heads[-1][0], k, 0))
    heapq.heapify(heap)
    while heap:
        now, pieces = heap[0][0], []
        while heap and heap[0][0] == now:
            _, k, i = heap[0]
            pieces.append((k, slice(edges[k][i], edges[k][i + 1])))
            if i + 1 < len(heads[k]):
                heapq.heapreplace(heap, (heads[k][i + 1], k, i + 1))
            else:
                heapq.heappop(heap)
        if len(pieces) == 1:
            k, cut = pieces[0]
            yield runs[k][0][cut], runs[k][1][cut], pieces, None
            continue
        pairs, which = np.unique(np.concatenate([runs[k][0][cut] for k, cut in pieces]), return_inverse=True)
        sums = np.zeros(len(pairs), dtype=np.int64)
        np.add.at(sums, which, np.concatenate([runs[k][1][cut] for k, cut in pieces]))
        yield pairs, sums, pieces, which


def _runs(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    return [tuple(unpack(x, np.uint64, np.int64)) for x in table.column("run").to_pylist()]


def by_radix(pairs: np.ndarray, where: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each place that has pairs, in order, which they are, in order."""
    order = np.lexsort((pairs, where))
    place, first = np.unique(where[order], return_index=True)
    for x, a, b in zip(place.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]):
        yield x, order[a:b]


def digit_of(pairs: np.ndarray) -> np.ndarray:
    return (mix(pairs >> np.uint64(32)) % np.uint64(DIGITS)).astype(np.int64)


def bucket_of(pairs: np.ndarray, buckets: int) -> np.ndarray:
    """Sides go to any bucket, each spread over one in SPREAD of them by the other side."""
    side, other = mix(pairs >> np.uint64(32)), mix((pairs & np.uint64(0xFFFFFFFF)) + np.uint64(1))
    return ((side % np.uint64(buckets) + other % np.uint64(max(1, buckets // SPREAD))) % np.uint64(buckets)).astype(np.int64)


def _encoded(path_a: str, path_b: str, kind: pa.DataType, names: list[str], with_groups: bool):
    """Rows of documents, and rows of runs that have a digit."""
    kinds = [pa.int64(), pa.int32(), pa.binary(), kind, *[pa.int64()] * 3, pa.string(), pa.binary(), pa.binary(), pa.string()]

    def rows(*columns) -> pa.RecordBatch:
        n = next(len(c) for c in columns if c is not None)
        return pa.RecordBatch.from_arrays([pa.nulls(n, k) if c is None else c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        both, serial = tokenizers(path_a, path_b), TaskContext.get().partitionId() << 24
        for ids, texts in parts(batches):
            seen = [BORDER.split(" " + t) if t else [] for t in texts]
            order = {u: k for k, u in enumerate(dict.fromkeys(chain.from_iterable(seen)))}
            code = np.fromiter(map(order.__getitem__, chain.from_iterable(seen)), dtype=np.int64)
            many = np.array([len(x) for x in seen])
            doc = np.repeat(np.arange(len(seen)), many)
            del seen
            units = both.units([*order])
            bad = np.zeros(len(texts), dtype=bool)
            bad[doc[units.bad[code]]] = True
            some = ~bad[doc]
            counts = [np.bincount(doc[some], weights=x[code[some]], minlength=len(texts)).astype(np.int64) for x in (units.n_a, units.n_b, units.n_groups)]
            at = np.cumsum(many) - many
            groups = ["" if x else ";".join([units.text[k] for k in code[i : i + n].tolist()]) for x, i, n in zip(bad.tolist(), at.tolist(), many.tolist())]
            # pairs of this batch in the order of its runs, and how often each document has which
            sizes = np.diff(units.edge)
            pairs, rank = np.unique(units.pairs, return_inverse=True)
            runs = list(by_radix(pairs, digit_of(pairs)))
            place = np.empty(len(pairs), dtype=np.int64)
            place[np.concatenate([x for _, x in runs]) if runs else []] = np.arange(len(pairs))
            rank = place[rank]
            held, repeats = np.unique(doc[some] << 32 | code[some], return_counts=True)
            m = sizes[held & 0xFFFFFFFF]
            at = np.repeat(units.edge[held & 0xFFFFFFFF] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            entry, which = np.unique(np.repeat(held >> 32, m) << 32 | rank[at], return_inverse=True)
            total = np.zeros(len(entry), dtype=np.int64)
            np.add.at(total, which, np.repeat(repeats, m))
            sums = np.zeros(len(pairs), dtype=np.int64)
            np.add.at(sums, entry & 0xFFFFFFFF, total)
            for digit, x in runs:  # pairs that only texts without tokens have are 0 times there
                yield rows([serial], [digit], [pack(pairs[x], sums[place[x]])], *[None] * 8)
            edge = np.searchsorted(entry >> 32, np.arange(len(texts) + 1))
            rank32, total32 = (entry & 0xFFFFFFFF).astype(np.uint32), total.astype(np.uint32)
            cut = lambda x: [x[a:b].tobytes() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
            yield rows([serial] * len(texts), None, None, ids, *counts, [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups], cut(rank32), cut(total32), groups if with_groups else None)
            serial += 1

    return run


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Ids and texts, about BATCH_BYTES characters of them at once, or one longer text."""
    held, texts, size = [], [], 0
    for batch in batches:
        ids, at = batch.column("id"), 0
        for k, t in enumerate(batch.column("text").to_pylist()):
            n = len(t or "")
            if texts and (size + n > BATCH_BYTES or len(texts) >= BATCH_DOCS):
                yield pa.concat_arrays([*held, ids.slice(at, k - at)]), texts
                held, texts, size, at = [], [], 0, k
            texts.append(t)
            size += n
        held.append(ids.slice(at))
    if texts:
        yield pa.concat_arrays(held), texts


# ---- merging --------------------------------------------------------------------

_SUMS = "wave long, digit int, run binary"
_SPLIT = "wave long, digit int, bucket int, run binary"
_BEST = "side long, most long"
_FOUND = "wave long, digit int, bucket int, counts binary, best binary"
_ANSWER = "batch long, digit int, counts binary, best binary"


def _table(schema: str, *columns: list) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def _sum(table: pa.Table) -> pa.Table:
    """The runs of a wave of batches and a digit as one."""
    found = [(pairs, sums) for pairs, sums, _, _ in sides(_runs(table))]
    return _table(_SUMS, [table.column("wave")[0].as_py()], [table.column("digit")[0].as_py()], [pack(*(np.concatenate(x) for x in zip(*found)))])


def _split(buckets: int):
    """Runs of sums, cut to the buckets of the last merge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                pairs, sums = unpack(batch.column("run")[r].as_py(), np.uint64, np.int64)
                cut = [(b, pack(pairs[x], sums[x])) for b, x in by_radix(pairs, bucket_of(pairs, buckets))]
                n = len(cut)
                yield _table(_SPLIT, [batch.column("wave")[r].as_py()] * n, [batch.column("digit")[r].as_py()] * n, *([x[k] for x in cut] for k in (0, 1))).to_batches()[0]

    return run


def _highest(table: pa.Table) -> pa.Table:
    """Of each side the highest count that a pair of this bucket has."""
    found = [(int(pairs[0] >> np.uint64(32)), int(sums.max())) for pairs, sums, _, _ in sides(_runs(table))]
    return _table(_BEST, *zip(*found))


def _found(handle):
    """For each run of a bucket, in its order, how often its pairs are linked in all, and whether no pair of that side is more often."""

    def run(table: pa.Table) -> pa.Table:
        most, runs = handle.value, _runs(table)
        counts, best = ([np.empty(len(p), dtype=k) for p, _ in runs] for k in (np.int64, np.uint8))
        for pairs, sums, pieces, which in sides(runs):
            top = sums == most[int(pairs[0] >> np.uint64(32))]
            at = 0
            for k, cut in pieces:
                n = cut.stop - cut.start
                own = slice(None) if which is None else which[at : at + n]
                counts[k][cut], best[k][cut] = sums[own], top[own]
                at += n
        return _table(_FOUND, *(table.column(c).to_pylist() for c in ("wave", "digit", "bucket")), [pack(x) for x in counts], [pack(x) for x in best])

    return run


def _joined(rows: list[dict], by: str) -> list[np.ndarray]:
    """Counts and highest ones of several answers, one after the other."""
    rows = sorted(rows, key=lambda r: r[by])
    return [np.concatenate([unpack(r[c], k)[0] for r in rows]) if rows else np.zeros(0, k) for c, k in (("counts", np.int64), ("best", np.uint8))]


def _back(buckets: int):
    """What the last merge found for a wave's sums, for each of its runs."""

    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        runs = _runs(table)
        pairs = np.concatenate([p for p, *_ in sides(runs)])
        order = np.concatenate([x for _, x in by_radix(pairs, bucket_of(pairs, buckets))])
        counts, best = np.empty(len(pairs), np.int64), np.empty(len(pairs), np.uint8)
        counts[order], best[order] = _joined(found.to_pylist(), "bucket")
        at = [np.searchsorted(pairs, p) for p, _ in runs]
        return _table(_ANSWER, table.column("batch").to_pylist(), table.column("digit").to_pylist(), [pack(counts[x]) for x in at], [pack(best[x]) for x in at])

    return run


def _totals(kind: pa.DataType, names: list[str], keep: list[str]):
    """Documents of a batch with the counts of their pairs."""

    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        counts, best = _joined(found.to_pylist(), "digit")
        ranks, times = ([np.frombuffer(x, np.uint32) for x in table.column(c).to_pylist()] for c in ("ranks", "times"))
        edge = np.cumsum([0] + [len(x) for x in ranks])
        rank = np.concatenate([np.zeros(0, np.uint32), *ranks])
        many = np.concatenate([np.zeros(0, np.uint32), *times]).astype(np.int64)
        between = lambda x: (s := np.append(0, np.cumsum(x)))[edge[1:]] - s[edge[:-1]]
        sums = [between(many), between(many * best[rank].astype(np.int64)), between(many * counts[rank])]
        own = [table.column(c) for c in ("id", "n_a", "n_b", "n_groups")]
        return pa.table([*own, *[pa.array(x, pa.int64()) for x in sums], *[table.column(c) for c in keep]], names=names)

    return run


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def align(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None, with_groups: bool = False, wave_bytes: int = WAVE_BYTES, bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """Aligns the tokens of a byte-level BPE (side a, of a blank and the text) and of a piece BPE (side b, which
    puts that blank there itself), without special tokens, whose strings are ordinary text.

    Returns one row per row of `docs`: the id, n_a and n_b (tokens), n_groups (stretches between places where
    tokens of both sides end), n_links (pairs of tokens that share a byte), n_best (links whose pair of ids no
    other pair of that side-b id exceeds over all rows, ties included), count_sum (over the links, how often
    their pair is linked over all rows), groups_sha256 (of the groups `a1,a2|b1;a3|b2`, ids in order) and,
    if asked for, the groups themselves. Null and empty texts, and those that the tokens of a side do not give
    back byte by byte, have no tokens: zeros and an empty hash, and add nothing to the counts. Repeated rows
    count each. Texts are read whole; other columns are not read, whatever their names. An empty table gives none.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    path_a, path_b = path_a or default_paths()[0], path_b or default_paths()[1]
    field = docs.schema[id_col]
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(field.dataType)
    schema = f"batch long, digit int, run binary, id {field.dataType.simpleString()}, n_a long, n_b long, n_groups long, groups_sha256 string, ranks binary, times binary, groups string"
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = [x.split()[0] for x in schema.split(", ")]
    encoded = written(base.mapInArrow(_encoded(path_a, path_b, kind, names, with_groups), schema), "encoded")
    homes, runs = encoded.filter("digit is null"), encoded.filter("digit is not null").select("batch", "digit", "run")
    waves = max(1, -(-int(runs.agg(F.sum(F.octet_length("run"))).first()[0] or 0) // wave_bytes))
    runs = runs.withColumn("wave", F.pmod(F.xxhash64("batch"), F.lit(waves)))
    sums = written(runs.groupBy("wave", "digit").applyInArrow(_sum, _SUMS), "sums")
    total = sums.agg(F.sum(F.octet_length("run"))).first()[0] or 0
    buckets = max(1, -(-int(total) // (PAIR_BYTES * bucket_pairs)))
    split = written(sums.mapInArrow(_split(buckets), _SPLIT), "split")
    most = split.groupBy("bucket").applyInArrow(_highest, _BEST).groupBy("side").agg(F.max("most").alias("most")).collect()
    handle = spark.sparkContext.broadcast({r.side: r.most for r in most})  # one number for each id of side b
    found = split.groupBy("bucket").applyInArrow(_found(handle), _FOUND)
    answers = runs.groupBy("wave", "digit").cogroup(found.groupBy("wave", "digit")).applyInArrow(_back(buckets), _ANSWER)
    keep = ["groups_sha256"] + ["groups"] * with_groups
    out = [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", *keep]
    result = f"`{id_col}` {field.dataType.simpleString()}, " + ", ".join(f"{c} long" for c in out[1:7]) + "".join(f", {c} string" for c in keep)
    return homes.drop("digit", "run").groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_totals(kind, out, keep), result)
