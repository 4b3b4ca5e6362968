"""Tables and files that driver and executors share: everything goes below spark.checkpoint.dir."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import discard, new_path, shared_folder, written

__all__ = ["bounded_batches", "discard", "new_path", "quoted", "row_key", "rows_of_keys", "shared_folder", "spare", "written"]


def bounded_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Arrow batches of at most a few MB, however long the texts: rows here hold whole documents, and
    Spark's usual 10,000 of them would not fit beside each other. Smaller settings stay."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    have = spark.conf.get(key).lower().rstrip("b")
    if not have.isdigit() or int(have) > size:  # set in other units, if at all
        spark.conf.set(key, str(size))


def spare(docs: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own beside those of `docs`, whatever they are called."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def row_key(docs: DataFrame, text_col: str) -> Column:
    """SHA-256 of a whole row: rows with equal keys are one row repeated, whatever their ids."""
    rest = [F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(docs.columns) if c != text_col]
    return F.unhex(F.sha2(F.concat_ws(" ", F.coalesce(F.sha2(F.col(text_col), 256), F.lit("-")), F.to_json(F.struct(F.lit(0), *rest))), 256))


def rows_of_keys(docs: DataFrame, keys: DataFrame, text_col: str, times: str | None = None) -> DataFrame:
    """The rows of `docs` whose row_key is in keys(key), with all their columns; of a repeated row, one.
    With `times`, a column of `keys`, as many of each. Texts are shuffled once, by their row's key."""
    key, count, copy = spare(docs, "_key", "_times", "_copy")
    named = keys.select(F.col("key").alias(key), *([F.col(times).alias(count)] if times else []))
    one = docs.withColumn(key, row_key(docs, text_col)).dropDuplicates([key])
    kept = one.join(named, key, "inner" if times else "left_semi")
    if times:
        kept = kept.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(count))))
    return kept.select(*[F.col(quoted(c)) for c in docs.columns])
