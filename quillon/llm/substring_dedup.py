"""Substring dedup: words inside a long word sequence that occurs more than once are removed.

Recompression names the runs and pairs of words, round by round, by hashes of their content,
so all tasks name alike without exchanging a dictionary. Every window of `width` words owns an
anchor, a high-level symbol that all its occurrences share. Only anchors seen at least twice go
on; their surroundings are compared by 128-bit digests, first whole stretches of windows and,
where those differ, window by window.

No step gathers a symbol's occurrences: counts are partial aggregates, equal stretches are
merged before they meet, and decisions go back by joins whose right side has unique keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .recompression import Parse, Tokens
from .shared import bounded_batches, written
from .words import chunks, texts_of

WIDTH = 35
_STRETCH = "symbol long, context long, k1 long, k2 int, place long, weight long"
_WINDOW = "symbol long, context long, n long, slot int, w1 long, w2 long"


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64, copy=False).view(np.int64) if values.dtype != np.int64 else values)


def _batch(schema: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else _long(np.asarray(c)) for c in columns], names=[x.split()[0] for x in schema.split(", ")])


def _stretches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                p = Parse(texts, width)
                symbol, context, first, count, weight = p.stretches()
                if not len(first):
                    continue
                doc = np.searchsorted(p.words.first, first, side="right") - 1
                pick = pa.array(doc)
                place = ((first - p.words.first[doc]) << 32) | count
                yield _batch(_STRETCH, symbol, context, part.column("k1").take(pick), part.column("k2").take(pick), place, weight)

    return run


def _windows(width: int):
    """Every window of the stretches that come with a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                p = Tokens(texts)
                lists = part.column("stretches")
                owner = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths().fill_null(0)))
                flat = lists.flatten()
                place = np.asarray(flat.field("place"))
                count = place & 0xFFFFFFFF
                count = np.where(count > width, 1, count)  # only equal windows in a row are so many: one stands for all
                base = p.words.first[owner] + (place >> 32)
                row = np.repeat(np.arange(len(place)), count)
                slot = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                at = base[row] + slot
                one, two = p.digests(at, at + width)
                pick = pa.array(row)
                yield _batch(_WINDOW, flat.field("symbol").take(pick), flat.field("context").take(pick), flat.field("n").take(pick), pa.array(slot.astype(np.int32)), one, two)

    return run


def _cut(width: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("marks")
            ends = np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))
            flat = lists.flatten()
            places, masks = np.asarray(flat.field("place")), np.asarray(flat.field("mask"))
            words, gone, digests, kept_texts = [], [], [], []
            for k, text in enumerate(texts_of(batch.column("text"))):
                own = text.split()
                a, b = (ends[k - 1] if k else 0), ends[k]
                words.append(len(own))
                if a == b:
                    gone.append(0)
                else:
                    cover = np.zeros(len(own) + 1, dtype=np.int32)
                    for place, mask in zip(places[a:b].tolist(), masks[a:b].tolist()):
                        first, count = place >> 32, place & 0xFFFFFFFF
                        if mask == -1:  # all of them, be there ever so many
                            cover[first] += 1
                            cover[first + count + width - 1] -= 1
                            continue
                        for slot in range(count):
                            if mask >> slot & 1:
                                cover[first + slot] += 1
                                cover[first + slot + width] -= 1
                    stay = np.cumsum(cover[:-1]) == 0
                    own = list(compress(own, stay.tolist()))
                    gone.append(words[-1] - len(own))
                kept = b" ".join(own)
                digests.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    kept_texts.append(kept.decode())
            out = [batch.column(c) for c in batch.schema.names if c not in ("text", "marks")]
            out += [pa.array(words, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests)]
            if with_text:
                out.append(pa.array(kept_texts, pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=[c for c in batch.schema.names if c not in ("text", "marks")] + ["n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text)

    return run


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, with_text: bool = False) -> DataFrame:
    """Removes each word that lies in a window of `width` words which also starts elsewhere.

    Returns one row per row of `docs`: the id, n_words, n_removed, kept_sha256 and, if asked for,
    kept_text (kept words joined by one space). Windows are judged on the input; one that starts
    twice in the same text counts, overlapping itself or not. Null and empty texts have no words
    and keep the empty text. A text shorter than `width` words keeps all. Repeated rows count as
    separate occurrences, so at `width` words or more they lose everything, each alike. Very long
    texts are worked on whole. Other columns of `docs` are not read. An empty table gives none.
    """
    if not 2 <= width <= 60:
        raise ValueError("width must be from 2 to 60")
    bounded_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    base = base.withColumn("k1", F.xxhash64("id", "text")).withColumn("k2", F.hash("id", "text"))
    parsed = written(base.select("k1", "k2", "text").mapInArrow(_stretches(width), _STRETCH), "stretches")
    # what a join looks up is written first: only between two plain exchanges can Spark split a hot symbol
    twice = written(parsed.groupBy("symbol").agg(F.sum("weight").alias("w")).filter("w > 1").select("symbol"), "twice")
    shared = written(parsed.join(twice, "symbol", "left_semi"), "shared")

    contexts = shared.groupBy("symbol", "context").agg(F.sum("weight").alias("n"), F.min(F.struct("k1", "k2", "place")).alias("one"))
    contexts = written(contexts, "contexts")
    differ = written(contexts.groupBy("symbol").agg(F.count("*").alias("c")).filter("c > 1").select("symbol"), "differ")
    single = contexts.join(differ, "symbol", "left_semi").select("one.k1", "one.k2", F.struct("one.place", "symbol", "context", "n").alias("s"))
    asked = single.groupBy("k1", "k2").agg(F.collect_list("s").alias("stretches"))
    looked = base.select("k1", "k2", "text").join(asked, ["k1", "k2"]).select("text", "stretches")
    windows = written(looked.mapInArrow(_windows(width), _WINDOW), "windows")
    again = written(windows.groupBy("w1", "w2").agg(F.sum("n").alias("c")).filter("c > 1").select("w1", "w2"), "again")
    masks = windows.join(again, ["w1", "w2"], "left_semi").groupBy("symbol", "context").agg(F.bit_or(F.expr("shiftleft(1L, slot)")).alias("mask"))

    settled = contexts.join(masks, ["symbol", "context"], "left")
    settled = settled.select("symbol", "context", F.when(F.col("n") > 1, F.lit(-1)).otherwise(F.coalesce("mask", F.lit(0))).cast("long").alias("mask")).filter("mask != 0")
    settled = written(settled, "settled")
    marks = shared.join(settled, ["symbol", "context"]).groupBy("k1", "k2").agg(F.collect_set(F.struct("place", "mask")).alias("marks"))
    joined = base.join(marks, ["k1", "k2"], "left").select(F.col("id").alias(id_col), "text", "marks")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return joined.mapInArrow(_cut(width, with_text), schema)
