"""Exact dedup by a heavy-hitter split, in DataFrame functions alone.

A Misra-Gries frequent-items sketch over the digests names the few that may be heavy; their
exact counts verify them. Rows of the heavy digests are decided by a broadcast of at most
`candidates` winners and never shuffled. All other digests are counted by a partial aggregate; the
groups with more than one row are written and joined back, so that no group is ever held by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import row_key, rows_of_keys, written

#: Bound on the heavy digests, so on the broadcast: 256 rows of 32 + 24 bytes.
CANDIDATES = 256
#: Counters of the sketch in each task. A digest with over 1/COUNTERS of the rows cannot escape it.
COUNTERS = 4096
#: Share of the rows from which a digest counts as heavy.
HEAVY = 1 / 2000


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only. `lower` is the cheap way where it does the same."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def normalised(text: Column) -> Column:
    """The text that is compared: A-Z lower-cased, null as empty."""
    return F.coalesce(lower_ascii(text), F.lit(""))


def _decided(base: DataFrame) -> DataFrame:
    """base(id, digest, ...) -> the same with keep_id and group_size of each digest's group."""
    base = written(base, "digests")
    total = base.agg(F.count("*").alias("rows"))
    sketch = base.agg(F.expr(f"approx_top_k(hex(digest), {CANDIDATES}, {COUNTERS})").alias("top"))
    likely = sketch.select(F.explode("top.item").alias("hex")).select(F.unhex("hex").alias("digest"))
    sums = (F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    heavy = (
        base.join(F.broadcast(likely), "digest", "left_semi").groupBy("digest").agg(*sums)
        .join(F.broadcast(total), F.col("group_size") > F.greatest(F.lit(1), F.col("rows") * HEAVY)).drop("rows")
    )
    heavy = written(heavy, "heavy")  # at most CANDIDATES rows
    decided = base.join(F.broadcast(heavy), "digest")
    rest = base.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    groups = written(rest.groupBy("digest").agg(*sums).filter("group_size > 1"), "groups")
    rest = rest.join(groups, "digest", "left").withColumns({
        "keep_id": F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")), "group_size": F.coalesce("group_size", F.lit(1))})
    return decided.unionByName(rest)


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of texts that are equal after lower-casing A-Z, the row with the largest id stays.

    Returns one row per row of `docs`: the id, keep_id (id of the row that stays), group_size
    (rows with that text), kept, text_sha256 of the normalised text. A null text equals an empty
    one; texts are read whole, however long. Rows that tie on the largest id are one row repeated:
    all of them are kept=true and count in group_size; see `one_of_each` for leaving one. A null id
    is smaller than any other; if all of a group are null, keep_id is null and all are kept. Other
    columns of `docs` are not read, whatever their names. An empty table gives none.
    """
    base = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"))
    return _decided(base).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, one of each group of equal texts, with all their columns.

    The group's largest id stays, null being smaller than any other; of rows that share it, and of
    repeated rows, the one with the smallest row_key. Rows with equal ids and different texts are
    different groups and all stay. A null text equals an empty one. Texts are read whole, however
    long. Columns may have any names. An empty table gives none."""
    base = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"), row_key(docs, text_col).alias("key"))
    best = F.col("id").eqNullSafe(F.col("keep_id"))
    stay = _decided(base).filter(best).groupBy("digest").agg(F.min("key").alias("key"))
    return rows_of_keys(docs, written(stay.select("key"), "stay"), text_col)
