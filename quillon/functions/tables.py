"""Table functions for SQL: generators of rows, and scorers of whole tables, as Python UDTFs.

`SELECT * FROM name(TABLE(t) PARTITION BY k ORDER BY x)` gives a generator the rows of each k in order. What it
gives back has columns that follow from those of the table, which `analyze` works out before anything runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


class Generator:
    """A data generator: `columns` from those of its table, rows from each row and at the end of each partition.
    One is made for each partition, so what it remembers is about the rows of one key only."""

    def columns(self, table: T.StructType, **options) -> T.StructType:
        raise NotImplementedError

    def rows(self, row: Row, **options) -> Iterator[tuple]:
        return iter(())

    def end(self) -> Iterator[tuple]:
        return iter(())


def register_generator(spark: SparkSession, name: str, generator: type[Generator]) -> None:
    """Makes a generator callable from SQL: name(TABLE(...) [PARTITION BY ...], option => value, ...)."""

    class Generated:
        def __init__(self):
            self.made = generator()

        @staticmethod
        def analyze(table: AnalyzeArgument, **options: AnalyzeArgument) -> AnalyzeResult:
            if not table.isTable:
                raise ValueError(f"{name} takes a table first")
            return AnalyzeResult(schema=generator().columns(table.dataType, **{k: v.value for k, v in options.items()}))

        def eval(self, row: Row, **options):
            yield from self.made.rows(row, **options)

        def terminate(self):
            yield from self.made.end()

    spark.udtf.register(name, udtf(Generated))


def register_scorer(spark: SparkSession, name: str, score: Callable[..., float | None], columns: list[str]) -> None:
    """Makes a scorer callable from SQL: name(TABLE(...), option => value, ...) is the table with a column `score`,
    which is `score` of the named columns and options, or null where that fails."""

    class Scored(Generator):
        def columns(self, table, **options):
            if missing := [c for c in columns if c not in table.names]:
                raise ValueError(f"{name} needs the columns {missing}")
            return T.StructType([f for f in table.fields if f.name != "score"] + [T.StructField("score", T.DoubleType())])

        def rows(self, row, **options):
            try:
                got = score(*(row[c] for c in columns), **options)
            except Exception:
                got = None
            yield (*(row[c] for c in row.__fields__ if c != "score"), None if got is None else float(got))

    register_generator(spark, name, Scored)


class Neighbours(Generator):
    """Each row's text with what its `before` predecessors said, as context: (key, context, text). Holds so many texts."""

    def __init__(self):
        self.held: list[str] = []

    def columns(self, table, key="doc_id", text="text", before=1):
        kinds = {f.name: f.dataType for f in table.fields}
        if missing := {key, text} - set(kinds):
            raise ValueError(f"the table has no column {', '.join(sorted(missing))}")
        return T.StructType([T.StructField(key, kinds[key]), T.StructField("context", T.ArrayType(T.StringType())), T.StructField(text, T.StringType())])

    def rows(self, row, key="doc_id", text="text", before=1):
        yield row[key], list(self.held), row[text]
        self.held = [*self.held, row[text]][-before:] if before else []
