"""Mixing sources to target weights by capped water-filling, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sampling import running_totals
from .shared import row_key, rows_of_keys, written

WEIGHTS, SHARE, EPOCHS, SEED = (3.0, 1.0, 2.0), 1.5, 2.0, 7
#: Distinct rows in a bucket, about.
BUCKET_ROWS = 2_000
WORD = r"[^\x20\x09-\x0D]+"


def water_fill(sources: DataFrame, *, total: float, epochs: float) -> DataFrame:
    """sources(source, weight, source_size) -> the same with target.

    Targets are in proportion to weight until one exceeds epochs * source_size; it is held there
    and the excess goes to the others by weight, until none is above. The level (words per weight)
    only rises, so the full sources of a round are those below the last level: a round is one
    aggregate of a single row. If all are full, that is as much as there is. No sources, no targets."""
    state = sources.withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    level, full = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > F.col("cap") if full >= 0 else F.lit(False)
        row = state.agg(F.sum(F.when(above, F.col("cap"))).alias("held"), F.sum(F.when(~above, F.col("weight"))).alias("open"), F.count_if(above).alias("full")).first()
        if not row.open:
            return state.withColumn("target", F.col("cap")).drop("cap")
        if row.full == full:
            return state.withColumn("target", F.when(above, F.col("cap")).otherwise(F.col("weight") * F.lit(level))).drop("cap")
        level, full = max(total - (row.held or 0.0), 0.0) / row.open, row.full


def _targets(rows: DataFrame, weights: tuple[float, ...], share: float, epochs: float) -> DataFrame:
    """rows(source, size, n) -> per source: source_size, target, times (whole turns), part (words once more), buckets."""
    sources = written(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("distinct_rows")), "sources")
    # their turn in the order of code points, null last, without bringing all sources together
    ranked = sources.withColumn("_one", F.lit(1).cast("long")).withColumn("_order", F.struct(F.col("source").isNull().alias("none"), F.col("source").alias("name")))
    ranked = running_totals(ranked, key="_order", value="_one")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("before") % len(weights) + 1).cast("int"))
    sources = written(ranked.select("source", "source_size", "distinct_rows", weight.alias("weight")), "weights")
    total = float(sources.agg(F.sum("source_size")).first()[0] or 0) * share
    targets = water_fill(sources, total=total, epochs=epochs).withColumn("target", F.round("target", 6))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    part = F.round(F.col("target") - whole * F.col("source_size")).cast("long")
    buckets = F.ceil(F.col("distinct_rows") / BUCKET_ROWS).cast("long")
    return written(targets.select(F.col("source").alias("s"), "source_size", "target", whole.alias("times"), part.alias("part"), buckets.alias("buckets")), "targets")


def _taken(base: DataFrame, names: list[str], *, weights: tuple[float, ...], share: float, epochs: float, seed: int) -> DataFrame:
    """base(source, id, size, ...) -> for each distinct row of it by `names`: n (how often it occurs), words
    (of its source before it) and its source's figures. Rows are ordered by a seeded draw and then by `names`."""
    rows = written(base.groupBy(*names).agg(F.count("*").alias("n")), "sizes")
    targets = _targets(rows, weights, share, epochs)
    # a null id has no draw of its own: what else the row holds spreads such rows
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.concat_ws(":", F.lit("none"), *[F.hex(F.col(c)) for c in names if c not in ("source", "id")]))))
    known = rows.join(targets, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("draw", draw)
    # buckets in the order of the draw: by its first digits
    known = written(known.withColumn("bucket", F.floor(F.conv(F.substring("draw", 1, 8), 16, 10).cast("long") * F.col("buckets") / F.lit(1 << 32))), "drawn")
    sums = known.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before"))
    offsets = written(offsets, "offsets")
    inner = Window.partitionBy("source", "bucket").orderBy("draw", *names).rowsBetween(Window.unboundedPreceding, -1)
    placed = known.withColumn("inside", F.coalesce(F.sum(F.col("size") * F.col("n")).over(inner), F.lit(0)))
    joined = placed.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    return joined.withColumn("words", F.col("before") + F.col("inside"))


def _extra(turn):
    """Words that the row's `turn`-th occurrence, from 0 on, gives once more."""
    return F.least(F.col("size"), F.greatest(F.lit(0), F.col("part") - F.col("words") - turn * F.col("size")))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, seed: int = SEED) -> DataFrame:
    """How many words of each document a mix takes.

    A document's size is its number of words `[^\\x20\\x09-\\x0D]+` (null: 0). Sources, by code point
    with null last, weigh `weights` in turn, and share `share` times all sizes, none more than
    `epochs` times its own. A source's target of r times its size takes every document floor(r)
    times; what is left goes once more over its documents in the order of a seeded hash of the id,
    until the target is met; the document there gives the part that is missing.

    Returns one row per row of `docs`: the id, size, source_size, target (of the source, to 6
    decimals), taken. Rows that share an id come one after the other by size; those of one source,
    id and size are interchangeable here. Equal runs take equal words, however the rows lie. A
    source without words has target 0. Texts are read whole. Other columns of `docs` are not read,
    whatever their names. An empty table gives none.

    Rows of equal source, id and size are counted before anything is brought together, and the words
    before a row are summed over hash ranges of its source first, as many as it has rows for, and
    then within its range, so that a source with a third of all rows is no single group.
    """
    base = docs.select(
        F.col(source_col).alias("source"), F.col(id_col).alias("id"),
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    rows = _taken(base, ["source", "id", "size"], weights=weights, share=share, epochs=epochs, seed=seed)
    rows = rows.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("times") * F.col("size") + _extra(F.col("turn"))).cast("long").alias("taken"))


def repeated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself: every document with all its columns as many times as it is taken, a part of a
    document counting as whole from a half on.

    Documents without words (null, empty or blank texts) are not taken. Rows that share an id come
    one after the other by size and whole row; repeated rows count each. Null ids and sources are
    taken like others. Texts are read whole, columns may have any names. An empty table gives none."""
    base = docs.select(
        F.col(source_col).alias("source"), F.col(id_col).alias("id"),
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"), row_key(docs, text_col).alias("key"))
    rows = _taken(base, ["source", "id", "size", "key"], weights=weights, share=share, epochs=epochs, seed=seed).filter("size > 0")
    # of n equal rows, `whole` are taken in full once more and then at most one in part, as a whole from a half on
    whole = F.greatest(F.lit(0), F.least(F.col("n"), F.floor((F.col("part") - F.col("words")) / F.col("size"))))
    half = F.when((whole < F.col("n")) & (_extra(whole) * 2 >= F.col("size")), 1).otherwise(0)
    rows = rows.select("key", (F.col("times") * F.col("n") + whole + half).cast("long").alias("copies")).filter("copies > 0")
    return rows_of_keys(docs, written(rows, "copies"), text_col, times="copies")
