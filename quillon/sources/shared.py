"""Tables that driver and executors share: everything goes below spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where spark.checkpoint.dir is unset and all runs in
    one local process. On a cluster an unset folder is an error: executors would not see each other's files."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="quillon-")
    return _OWN[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes the rows to the shared folder and reads them back: later jobs neither compute them
    again nor need the executors that made them."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts_for(df: DataFrame, rows: int = 100_000) -> int:
    """How many partitions the table needs at about `rows` rows each. What is dealt to that many by its groups' keys keeps
    a task's sorts, windows and hash maps at one size, however large the table is."""
    return max(1, -(-df.count() // rows))


def discard(table: DataFrame) -> None:
    """Deletes a table that `written` returned, once all that is made of it is written itself: nothing that a lost
    executor takes along then needs it again."""
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    spark._jvm.java.lang.System.gc()  # Spark deletes the shuffles of finished jobs once their plans are collected
