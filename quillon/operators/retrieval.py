"""Top-k retrieval for a stated set of queries that skips what cannot be among the best.

Both searches first find, for each query, a score that its k-th best has at least, from a part of the corpus,
and then leave out what cannot reach it: by words, blocks and terms whose largest weights do not add up; by vectors,
groups whose distance from their pivot does not bring them near enough. Nothing is approximate.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

TERM = re.compile("[a-z0-9]+")


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


# ---- words ----------------------------------------------------------------------

#: Documents of a block and characters among them; terms up to which the index holds only those that are asked for.
BLOCK_DOCS, BLOCK_CHARS, ASKED_TERMS = 4096, 4 << 20, 1 << 20
#: Queries that meet a block at once; one block in so many gives the first bounds.
QUERY_BLOCK, SAMPLE = 1024, 16
_INDEX = "block long, n_docs long, length long, terms array<string>, size array<int>, most_tf array<int>, least array<int>, doc array<int>, tf array<int>, len array<int>"


def _index(asked: frozenset[str] | None, id_kind: pa.DataType):
    """Postings of a block of documents: its terms, how many of its documents each has, the largest tf and the
    smallest length among those, and then document, tf by tf, all terms one after the other."""
    names = [x.split()[0] for x in _INDEX.split(", ")] + ["ids"]
    every = [None, *(asked or ())]
    number_of = {w: k for k, w in enumerate(every) if k}

    def block(number: int, ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
        length, held = np.zeros(len(texts), dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
        flat, own = [], {}
        for k, t in enumerate(texts):
            words = TERM.findall(t) if t else []
            length[k] = len(words)
            # numbers from 1 of the words that are asked for: a text's words are looked up once, without a step of ours for each
            found = list(filter(None, map(number_of.get, words))) if asked is not None else [own.setdefault(w, len(own) + 1) for w in words]
            held[k] = len(found)
            flat.append(np.array(found, dtype=np.int64))
        flat = np.concatenate(flat)
        names_of, seen = (every, np.unique(flat)) if asked is not None else ([None, *own], np.arange(1, len(own) + 1))
        order = sorted(seen.tolist(), key=names_of.__getitem__)
        terms = [names_of[c] for c in order]
        place = np.zeros(len(names_of), dtype=np.int64)
        place[order] = np.arange(len(terms))
        key, tf = np.unique(place[flat] << 32 | np.repeat(np.arange(len(texts)), held), return_counts=True)
        term, doc = key >> 32, (key & 0xFFFFFFFF).astype(np.int32)
        first = np.searchsorted(term, np.arange(len(terms)))
        most = np.maximum.reduceat(tf, first) if len(terms) else tf
        least = np.minimum.reduceat(length[doc], first) if len(terms) else tf
        size = np.diff(np.append(first, len(key)))
        one = lambda x: pa.array([x.astype(np.int32).tolist()], pa.list_(pa.int32()))
        columns = [pa.array([number]), pa.array([len(texts)], pa.int64()), pa.array([int(length.sum())], pa.int64()), pa.array([terms], pa.list_(pa.string()))]
        columns += [one(x) for x in (size, most, least, doc, tf, length)] + [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, texts, size = TaskContext.get().partitionId() << 24, [], [], 0
        for batch in batches:
            for k, t in enumerate(batch.column("text").to_pylist()):
                if texts and (len(texts) >= BLOCK_DOCS or size + len(t or "") > BLOCK_CHARS):
                    yield block(number, pa.array(ids, id_kind), texts)
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(batch.column("id")[k].as_py())
                texts.append(t)
                size += len(t or "")
        if texts:
            yield block(number, pa.array(ids, id_kind), texts)

    return run


def lexical_index(docs: DataFrame, *, doc_id: str, text: str, asked: DataFrame | None = None) -> DataFrame:
    """A written index of blocks of documents, by the terms of `asked`(term) if these are few enough to be sent to
    all tasks, else by all terms."""
    spark = docs.sparkSession
    few = None
    if asked is not None and asked.limit(ASKED_TERMS + 1).count() <= ASKED_TERMS:
        few = frozenset(r.term for r in asked.collect())
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[doc_id].dataType
    base = docs.select(F.col(doc_id).alias("id"), F.lower(F.col(text)).alias("text"))
    return written(base.mapInArrow(_index(few, to_arrow_type(kind)), f"{_INDEX}, ids array<{kind.simpleString()}>"), "postings")


class Scorer:
    """Largest and real BM25 scores in one block."""

    def __init__(self, batch: pa.RecordBatch, r: int, k1: float, b: float):
        get = lambda c: np.asarray(batch.column(c)[r].values)
        self.place = {t: k for k, t in enumerate(batch.column("terms")[r].as_py())}
        size = get("size")
        self.edge = np.append(0, np.cumsum(size))
        self.doc, self.tf, self.len, self.ids = get("doc"), get("tf"), get("len"), batch.column("ids")[r].values
        self.k1, self.norm = k1, k1 * (1 - b + b * self.len / batch.column("avg_len")[r].as_py())
        most, least = get("most_tf"), get("least")
        self.top = most * (k1 + 1) / (most + k1 * (1 - b + b * least / batch.column("avg_len")[r].as_py()))
        order = pc.sort_indices(self.ids) if len(self.ids) else pa.array([], pa.uint64())
        self.rank = np.empty(len(self.ids), dtype=np.int64)
        self.rank[np.asarray(order)] = np.arange(len(self.ids))

    def best(self, terms: list[str], idf: list[float], k: int, least: float) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Documents and scores that may be among the k best of the query and reach `least`; how many have any of its
        terms and how many got a score in full. Terms are taken by falling largest weight, until those left cannot
        lift a new document to the bound; a document goes as soon as they cannot lift it."""
        have = [(x * self.top[self.place[t]], self.place[t], x, n) for n, (t, x) in enumerate(zip(terms, idf)) if t in self.place]
        have.sort(key=lambda h: (-h[0], h[3]))
        matching = 0
        if have:
            seen = np.zeros(len(self.len), dtype=bool)
            for _, t, _, _ in have:
                seen[self.doc[self.edge[t] : self.edge[t + 1]]] = True
            matching = int(seen.sum())
        rest = np.append(np.cumsum([h[0] for h in have][::-1])[::-1], 0.0)  # largest weights from each term on
        if rest[0] < least - 1e-7:
            return np.zeros(0, np.int64), np.zeros(0), matching, 0
        score, open_ = np.zeros(len(self.len)), np.zeros(len(self.len), dtype=bool)
        bound, live = least, None
        for i, (_, t, x, _) in enumerate(have):
            at = slice(self.edge[t], self.edge[t + 1])
            doc, tf = self.doc[at], self.tf[at]
            if rest[i] < bound - 1e-7:  # no new documents from here on
                if live is None:
                    live = np.flatnonzero(open_)
                live = live[score[live] + rest[i] >= bound - 1e-7]
                if not len(live):
                    return live, np.zeros(0), matching, 0
                where = np.minimum(np.searchsorted(doc, live), len(doc) - 1)
                hit = doc[where] == live
                doc, tf = live[hit], tf[where[hit]]
            else:
                open_[doc] = True
            score[doc] += x * tf * (self.k1 + 1) / (tf + self.norm[doc])
            if len(doc) >= k:  # what k documents have so far is a bound, too
                bound = max(bound, np.partition(score[doc], -k)[-k])
        live = np.flatnonzero(open_) if live is None else live
        live = live[score[live] >= bound - 1e-7]
        # once more in the order of the query, so that equal documents have equal scores wherever they are
        exact = np.zeros(len(live))
        for _, t, x, _ in sorted(have, key=lambda h: h[3]):
            doc, tf = self.doc[self.edge[t] : self.edge[t + 1]], self.tf[self.edge[t] : self.edge[t + 1]]
            where = np.minimum(np.searchsorted(doc, live), len(doc) - 1)
            hit = doc[where] == live
            exact[hit] += x * tf[where[hit]] * (self.k1 + 1) / (tf[where[hit]] + self.norm[live[hit]])
        full = len(live)
        live, exact = live[exact > 0], exact[exact > 0]
        kept = k_best(exact, self.rank[live], k)
        return live[kept], exact[kept], matching, full


def k_best(score: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """All that may be among the k best by a score rounded to nine digits and then by rank: of each rounded score the
    first k by rank, down to one step below the k-th."""
    if len(score) <= k:
        return np.arange(len(score))
    step = np.round(score * 1e9).astype(np.int64)
    order = np.lexsort((rank, -step))
    last = step[order[k - 1]]
    order = order[step[order] >= last - 1]
    _, first, many = np.unique(-step[order], return_index=True, return_counts=True)
    nth = np.arange(len(order)) - np.repeat(first, many)
    return order[nth < k]


_HIT = "query_id {query}, doc_id {doc}, score double, matching long, scored long"


def _search(k: int, k1: float, b: float, query_kind: pa.DataType, doc_kind: pa.DataType):
    """Candidates of each query in each block, and a row without a document for what was left out."""
    names = [x.split()[0] for x in _HIT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                scorer = Scorer(batch, r, k1, b)
                for q in batch.column("queries")[r].as_py():
                    at, score, matching, full = scorer.best(q["terms"], q["idf"], k, q["least"])
                    ids = pa.concat_arrays([scorer.ids.take(pa.array(at, pa.int64())), pa.nulls(1, doc_kind)])
                    n = len(at)
                    yield pa.RecordBatch.from_arrays([pa.array([q["query_id"]] * (n + 1), query_kind), ids, pa.array([*score.tolist(), None], pa.float64()), pa.array([0] * n + [matching]), pa.array([0] * n + [full])], names=names)

    return run


def bm25_search(queries: DataFrame, docs: DataFrame, *, k: int, query_id: str, query: str, doc_id: str, text: str, k1: float = 0.9, b: float = 0.4, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """The k documents of largest BM25 score for each query (query_id, doc_id, score, rank), ties by id, and one row
    with how many (query, document) pairs share a term (`matching`) and how many got a full score (`scored`).

    An index of blocks knows each term's largest tf and smallest length, hence the most that it can add there. One
    block in `sample` is searched first; the k-th best score there is a bound for all. Queries are dealt to blocks of
    QUERY_BLOCK and meet each block of documents once. A query whose terms no document has gives no row.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    asked = queries.select(F.col(query_id).alias("query_id"), F.posexplode(F.array_distinct(tokens(F.col(query)))).alias("at", "term"))
    asked = written(asked, "asked-terms")
    index = lexical_index(docs, doc_id=doc_id, text=text, asked=asked.select("term").distinct())
    stats = index.agg(F.sum("n_docs").alias("n_docs"), (F.sum("length") / F.sum("n_docs")).alias("avg_len"))  # one row
    df = index.select(F.explode(F.arrays_zip("terms", "size")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.size").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = asked.join(df, "term").crossJoin(F.broadcast(stats)).select("query_id", "at", "term", idf.alias("idf"))
    terms = weighed.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("at", "term", "idf"))).alias("t"))  # a query's own terms
    terms = written(terms.select("query_id", F.col("t.term").alias("terms"), F.col("t.idf").alias("idf")), "queries")
    parts = max(1, -(-terms.count() // QUERY_BLOCK))
    kinds = [to_arrow_type(x) for x in (terms.schema["query_id"].dataType, docs.schema[doc_id].dataType)]
    schema = _HIT.format(query=terms.schema["query_id"].dataType.simpleString(), doc=docs.schema[doc_id].dataType.simpleString())

    def search(blocks: DataFrame, least: DataFrame | None) -> DataFrame:
        asking = terms.withColumn("least", F.lit(0.0)) if least is None else terms.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
        asking = asking.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(parts)).alias("part")).agg(F.collect_list(F.struct("query_id", "terms", "idf", "least")).alias("queries"))  # about QUERY_BLOCK
        each = blocks.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint")))).crossJoin(F.broadcast(stats.select("avg_len")))
        return each.join(asking, "part").mapInArrow(_search(k, k1, b, *kinds), schema)

    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    ranked = lambda hits: hits.filter("doc_id is not null").withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= k)
    first = written(search(index.filter(F.pmod(F.xxhash64("block"), F.lit(sample)) == 0), None), "first-hits")
    least = ranked(first).filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    hits = written(search(index.filter(F.pmod(F.xxhash64("block"), F.lit(sample)) != 0), least).unionByName(first), "hits")
    visits = hits.agg(F.sum("matching").alias("matching"), F.sum("scored").alias("scored"))
    return ranked(hits).select("query_id", "doc_id", "score", "rank"), visits


def bm25_top_k(queries: DataFrame, docs: DataFrame, **options) -> DataFrame:
    """The hits of `bm25_search`."""
    return bm25_search(queries, docs, **options)[0]


# ---- vectors --------------------------------------------------------------------

#: Pivots at most, vectors in a chunk of a group, queries that meet a chunk at once, groups that a query searches first,
#: and rows of a batch of (query, group) pairs.
PIVOTS, CHUNK, ASKING, FIRST_GROUPS, ROWS = 4096, 8192, 4096, 2, 8192
_PLACED = "doc_id {doc}, v array<double>, pivot int, far double"


def _matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(rows, -1)


def _placed(handle):
    """The nearest pivot of each vector, and its distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = handle.value
        square = (pivots**2).sum(axis=1)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = _matrix(part.column("v"), part.num_rows)
                near = (square - 2 * x @ pivots.T).argmin(axis=1)
                far = np.sqrt(((x - pivots[near]) ** 2).sum(axis=1)) * (1 + 1e-9)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("v"), pa.array(near, pa.int32()), pa.array(far)], names=["doc_id", "v", "pivot", "far"])

    return run


def _wanted(handle, first: int | None):
    """(query, group) pairs to search: the `first` groups by their bound, or all that may hold a score of `least` or more and were not searched yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, radius, groups = handle.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                q = _matrix(part.column("v"), part.num_rows)
                bound = q @ pivots[groups].T + np.sqrt((q**2).sum(axis=1))[:, None] * radius[groups]
                bound += 1e-9 * (1 + np.abs(bound))
                order = np.argsort(-bound, axis=1, kind="stable")[:, :FIRST_GROUPS]
                early = np.zeros(bound.shape, dtype=bool)
                np.put_along_axis(early, order, True, axis=1)
                if first is None:
                    early = ~early & (bound >= np.asarray(part.column("least").fill_null(-np.inf))[:, None])
                row, group = np.nonzero(early)
                for cut in range(0, len(row), ROWS):  # a query's vector is repeated for each of its groups
                    take = pa.array(row[cut : cut + ROWS])
                    yield pa.RecordBatch.from_arrays([part.column("query_id").take(take), part.column("v").take(take), pa.array(groups[group[cut : cut + ROWS]], pa.int32())], names=["query_id", "v", "pivot"])

    return run


def _nearest_of_chunk(k: int, kinds: list[pa.DataType]):
    def run(q: pa.Table, d: pa.Table) -> pa.Table:
        rows, cols, scores = [], [], []
        if q.num_rows and d.num_rows:
            vectors = _matrix(d.column("v"), d.num_rows)
            rank = np.empty(d.num_rows, dtype=np.int64)
            rank[np.asarray(pc.sort_indices(d.column("doc_id")))] = np.arange(d.num_rows)
            for at in range(0, q.num_rows, 256):
                score = _matrix(q.column("v").slice(at, 256), min(256, q.num_rows - at)) @ vectors.T
                for r, s in enumerate(score):
                    few = np.flatnonzero(s >= np.partition(s, -k)[-k]) if len(s) > k else np.arange(len(s))
                    few = few[np.lexsort((rank[few], -s[few]))][:k]
                    rows.append(np.full(len(few), at + r))
                    cols.append(few)
                    scores.append(s[few])
        joined = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        rows, cols, scores = joined(rows, np.int64), joined(cols, np.int64), joined(scores, np.float64)
        out = [q.column("query_id").take(pa.array(rows)), d.column("doc_id").take(pa.array(cols)), pa.array(scores)]
        # one row without a document: how many pairs were looked at
        none = [pa.nulls(1, k) for k in (*kinds, pa.float64())]
        columns = [pa.chunked_array([*(x.chunks if isinstance(x, pa.ChunkedArray) else [x]), y]) for x, y in zip(out, none)]
        return pa.table([*columns, pa.array([0] * len(rows) + [q.num_rows * d.num_rows], pa.int64())], names=["query_id", "doc_id", "score", "visited"])

    return run


def dense_search(queries: DataFrame, corpus: DataFrame, *, k: int, query_id: str, doc_id: str, vector: str, pivots: int | None = None, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """The k corpus rows of largest inner product for each query (query_id, doc_id, score, rank), in double
    precision, ties by id, and one row with the (query, row) pairs there are (`pairs`) and that were multiplied (`visited`).

    Corpus rows go to the nearest of some pivots, drawn from them by hash. Within a radius r of a pivot no inner
    product exceeds that of the pivot by more than r times the query's length. Each query searches its most
    promising groups first; its k-th best score there leaves out all groups that cannot reach it. Groups are
    searched in chunks, so one of any size is many tasks. Vectors must be of one length and without nulls.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = corpus.sparkSession
    d = corpus.select(F.col(doc_id).alias("doc_id"), F.col(vector).cast("array<double>").alias("v"))
    q = written(queries.select(F.col(query_id).alias("query_id"), F.col(vector).cast("array<double>").alias("v")), "query-vectors")
    n = d.count()
    most = min(PIVOTS, pivots or max(1, round(2 * n**0.5)))
    drawn = d.select("v").withColumn("h", F.xxhash64("v")).orderBy("h").limit(most).toArrow()  # PIVOTS vectors at most
    kinds = [to_arrow_type(t) for t in (q.schema["query_id"].dataType, d.schema["doc_id"].dataType)]
    hit = f"query_id {q.schema['query_id'].dataType.simpleString()}, doc_id {d.schema['doc_id'].dataType.simpleString()}, score double, visited long"
    if not drawn.num_rows:
        none = spark.createDataFrame([], hit)
        return none.select("query_id", "doc_id", "score", F.lit(0).cast("long").alias("rank")), q.agg(F.lit(0).cast("long").alias("pairs"), F.lit(0).cast("long").alias("visited"))
    table = np.unique(_matrix(drawn.column("v"), drawn.num_rows), axis=0)
    schema = _PLACED.format(doc=d.schema["doc_id"].dataType.simpleString())
    placed = written(d.mapInArrow(_placed(spark.sparkContext.broadcast(table)), schema), "placed-vectors")
    groups = placed.groupBy("pivot").agg(F.max("far").alias("far"), F.count("*").alias("n")).toArrow()  # one row for each pivot
    number, far = np.asarray(groups.column("pivot")), np.asarray(groups.column("far"))
    radius = np.zeros(len(table))
    radius[number] = far
    handle = spark.sparkContext.broadcast((table, radius, np.sort(number)))
    chunks = spark.createDataFrame([(int(p), max(1, -(-int(c) // chunk))) for p, c in zip(number, np.asarray(groups.column("n")))], "pivot int, chunks int")
    asked = q.count()
    asking_parts = max(1, -(-asked // ASKING))
    dealt = placed.join(F.broadcast(chunks), "pivot").select("pivot", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int").alias("chunk"), "doc_id", "v")
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(asking_parts - 1))))

    def search(asking: DataFrame, first: int | None) -> DataFrame:
        columns = f"query_id {q.schema['query_id'].dataType.simpleString()}, v array<double>, pivot int"
        pairs = asking.mapInArrow(_wanted(handle, first), columns).join(F.broadcast(chunks), "pivot")
        pairs = pairs.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
        pairs = pairs.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(asking_parts)).cast("int"))
        return pairs.groupBy("pivot", "chunk", "part").cogroup(dealt.groupBy("pivot", "chunk", "part")).applyInArrow(_nearest_of_chunk(k, kinds), hit)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    ranked = lambda hits: hits.filter("doc_id is not null").withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= k)
    early = written(search(q, FIRST_GROUPS), "first-hits")
    least = ranked(early).filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    hits = written(search(q.join(least, "query_id", "left"), None).unionByName(early), "hits")
    visits = hits.agg(F.lit(n * asked).cast("long").alias("pairs"), F.sum("visited").alias("visited"))
    return ranked(hits).select("query_id", "doc_id", "score", "rank"), visits


def dense_top_k(queries: DataFrame, corpus: DataFrame, **options) -> DataFrame:
    """The hits of `dense_search`."""
    return dense_search(queries, corpus, **options)[0]
