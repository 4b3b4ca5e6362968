"""Token counts of a corpus for every context limit, from one exact length histogram.

Each task encodes whole texts and sends on how many have each length; that table is all the
corpus leaves. Suffix sums over it say, for any limit, how many documents reach it and how many
tokens a cut at the limit leaves. They are taken level by level, 1024 lengths at a time, so no
task sees more lengths than that and what it gets from the level above.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import HIGH, REMEMBERED, unassigned
from .shared import bounded_batches, written

STRETCH = regex.compile(r"\s*\S+|\s+")
_FAN = 1024
_LEVELS = 4


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Lengths:
    """How many tokens a text has, from those of its stretches: white space and what follows it up to
    the next. No token crosses from one to another, so the most frequent are encoded once."""

    def __init__(self, path: str, pattern: str):
        self.encode, self.young = encoding(path, pattern).encode_ordinary, unassigned()
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def __call__(self, text: str) -> int:
        if HIGH.search(text) and self.young.search(text):  # letters that the tables here may class otherwise
            return len(self.encode(text))
        stretches = STRETCH.findall(text)
        known, older, encode = self.known, self.older, self.encode
        for x in set(stretches).difference(known):
            have = older.get(x)
            known[x] = len(encode(x)) if have is None else have
        total = sum(map(known.__getitem__, stretches))
        if len(known) > REMEMBERED:
            self.older, self.known = known, {}
        return total


@lru_cache(maxsize=4)
def lengths(path: str, pattern: str) -> Lengths:
    """One for each worker process."""
    return Lengths(path, pattern)


def _lengths(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = lengths(path, pattern)
        seen: Counter[int] = Counter()
        for batch in batches:
            seen.update(count(t.as_py() or "") for t in batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.int64()), pa.array(seen.values(), pa.int64())], names=["length", "n_docs"])

    return run


def length_histogram(docs: DataFrame, *, text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(length, n_docs): how many documents are encoded to how many tokens. Null and empty texts
    have length 0; repeated rows count each; strings of special tokens are ordinary text. No rows, no lengths."""
    bounded_batches(docs.sparkSession)
    run = _lengths(path or default_path(), pattern or default_pattern())
    return docs.select(F.col(text_col)).mapInArrow(run, "length long, n_docs long").groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def with_suffix_sums(histogram: DataFrame) -> DataFrame:
    """histogram(length, n_docs) and, for each length, docs_at_least and tokens_at_least: how many
    documents are that long or longer, and their tokens."""
    level = histogram.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"))
    levels = [level.withColumnsRenamed({"length": "k0", "n_docs": "d0", "n_tokens": "t0"})]
    for i in range(1, _LEVELS):
        up = levels[-1].groupBy(F.floor(F.col(f"k{i - 1}") / _FAN).alias(f"k{i}"))
        levels.append(up.agg(F.sum(f"d{i - 1}").alias(f"d{i}"), F.sum(f"t{i - 1}").alias(f"t{i}")))
    beyond = None  # what lies in later blocks of each level
    for i in reversed(range(_LEVELS)):
        own = levels[i].withColumn(f"k{i + 1}", F.floor(F.col(f"k{i}") / _FAN))
        later = Window.partitionBy(f"k{i + 1}").orderBy(F.desc(f"k{i}")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        own = own.withColumns({"ds": F.sum(f"d{i}").over(later), "ts": F.sum(f"t{i}").over(later)})
        if beyond is not None:
            own = own.join(beyond, f"k{i + 1}").withColumns({"ds": F.col("ds") + F.col("bd"), "ts": F.col("ts") + F.col("bt")}).drop("bd", "bt")
        beyond = own.select(f"k{i}", (F.col("ds") - F.col(f"d{i}")).alias("bd"), (F.col("ts") - F.col(f"t{i}")).alias("bt"))
    return own.select(F.col("k0").alias("length"), F.col("d0").alias("n_docs"), F.col("ds").alias("docs_at_least"), F.col("ts").alias("tokens_at_least"))


def token_counts(docs: DataFrame, *, text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per encoded length L that occurs: n_docs, docs_at_least, tokens_at_least, total_docs,
    total_tokens, truncated_tokens (tokens left if every document is cut at L) and quantile (share
    of the documents with at most L tokens). Null and empty texts have length 0, repeated rows and
    texts of equal length count each, texts are read whole, and no other column is read, whatever
    its name. An empty table gives none. The corpus is encoded once: the histogram is written, and
    all sums are taken from what is read back."""
    histogram = written(length_histogram(docs, text_col=text_col, path=path, pattern=pattern), "lengths")
    sums = with_suffix_sums(histogram)
    total = sums.agg(F.sum("n_docs").alias("total_docs"), F.sum(F.col("length") * F.col("n_docs")).alias("total_tokens"))
    left = F.col("total_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")
    share = (F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("total_docs")
    return sums.crossJoin(F.broadcast(total)).withColumns({"truncated_tokens": left, "quantile": share})


def truncated_total(counts: DataFrame, limits: DataFrame) -> DataFrame:
    """limits(limit_tokens) -> truncated_tokens at each: from token_counts, whether a document has that length or not."""
    cut = F.least("length", "limit_tokens") * F.col("n_docs")
    return F.broadcast(limits).crossJoin(counts).groupBy("limit_tokens").agg(F.sum(cut).alias("truncated_tokens"))


def length_quantile(counts: DataFrame, q: float) -> DataFrame:
    """The smallest length that at least a share `q` of the documents do not exceed."""
    return counts.filter(F.col("quantile") >= q).agg(F.min("length").alias("length"))
