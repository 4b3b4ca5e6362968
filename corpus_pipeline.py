"""A corpus pipeline: documents in, encoded documents out. Each stage is (name, function) and
works on all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import exact_dedup, mixing, simhash_similar
from quillon.llm.bpe import bpe_encode
from quillon.llm.language_id import known_language
from quillon.llm.shared import written


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language cannot be told, go."""
    return known_language(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact_dedup.one_of_each(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that share 0.8 or more of their five-word shingles, directly or over others, the one with the smallest id stays."""
    return simhash_similar.one_of_each(docs, shingle=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, its one fractional document rounded."""
    return mixing.repeated(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text and what they decode to."""
    return bpe_encode(docs, with_ids=True).select("doc_id", "n_tokens", "ids", "ids_sha256", F.col("decoded_sha256"))


STAGES = [
    ("language_id", keep_known_languages),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Language scores, fingerprint groups and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
