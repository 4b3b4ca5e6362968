"""Top-k searches that skip against ones that look at everything, and how much they skip."""

import math
import random
import re
from collections import Counter

import numpy as np
from quillon.operators import retrieval as re_

FOLDER = "/root/testdata/sf0.01"


def plain_bm25(docs, queries, k, k1=0.9, b=0.4):
    words = {i: re.findall("[a-z0-9]+", (t or "").lower()) for i, t in docs}
    n, avg = len(docs), sum(map(len, words.values())) / max(1, len(docs))
    tf = {i: Counter(w) for i, w in words.items()}
    df = Counter(t for c in tf.values() for t in c)
    out, matching = {}, 0
    for q, text in queries:
        terms = set(re.findall("[a-z0-9]+", (text or "").lower()))
        scores = {}
        for i, c in tf.items():
            have = [t for t in terms if c[t]]
            if have:
                scores[i] = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * (k1 + 1) / (c[t] + k1 * (1 - b + b * len(words[i]) / avg)) for t in have)
        matching += len(scores)
        out[q] = sorted(scores, key=lambda i: (-round(scores[i], 9), i))[:k], scores
    return out, matching


def same_hits(got, want):
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.doc_id, r.score))
    assert set(found) == {q for q, (ids, _) in want.items() if ids}
    for q, rows in found.items():
        ids, scores = want[q]
        assert [i for _, i, _ in sorted(rows)] == ids and all(math.isclose(s, scores[i], rel_tol=1e-9) for _, i, s in rows)


def test_words_over_many_blocks(spark, monkeypatch):
    draw = random.Random(2)
    docs = [(k, " ".join(f"t{min(int(draw.paretovariate(0.7)), 400)}" for _ in range(draw.randint(0, 60)))) for k in range(1500)]
    docs += [(2000 + k, "t3 t17 t44") for k in range(30)] + [(5000, None), (5001, ""), (5002, "T17, t17! t99-t44")]
    queries = [(q, " ".join(f"t{draw.randint(1, 400)}" for _ in range(draw.randint(1, 9)))) for q in range(40)] + [(90, "t3 t17 t44"), (91, "nothing of it"), (92, None), (93, "")]
    d = spark.createDataFrame(docs, "doc int, text string").repartition(6).selectExpr("*", "1 as block", "2 as score")
    q = spark.createDataFrame(queries, "q int, text string").selectExpr("*", "1 as terms")
    monkeypatch.setattr(re_, "QUERY_BLOCK", 7)
    hits, visits = re_.bm25_search(q, d, k=5, query_id="q", query="text", doc_id="doc", text="text", sample=3)
    want, matching = plain_bm25(docs, queries, 5)
    same_hits(hits.collect(), want)
    v = visits.first()
    assert v.matching == matching and v.scored < matching / 4


def test_words_of_whole_tables(spark):
    d, q = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "benchmark"))
    hits, visits = re_.bm25_search(q, d, k=5, query_id="item_id", query="text", doc_id="doc_id", text="text")
    want, matching = plain_bm25([(r.doc_id, r.text) for r in d.collect()], [(r.item_id, r.text) for r in q.collect()], 5)
    same_hits(hits.collect(), want)
    v = visits.first()
    assert v.matching == matching and v.scored < matching / 10


def test_no_documents_or_queries(spark):
    d, q = spark.createDataFrame([], "doc int, text string"), spark.createDataFrame([(1, "a")], "q int, text string")
    options = dict(k=3, query_id="q", query="text", doc_id="doc", text="text")
    assert re_.bm25_top_k(q, d, **options).count() == 0
    assert re_.bm25_top_k(q.limit(0), spark.createDataFrame([(1, "a")], d.schema), **options).count() == 0


def vectors(n, seed, groups=40, size=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, size))
    x = centres[rng.integers(0, groups, n)] + 0.05 * rng.normal(size=(n, size))
    return x / np.linalg.norm(x, axis=1)[:, None]


def share_visited(spark, n):
    x = vectors(n, 4)
    x[7] = x[3] = x[11]  # ties
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id int, v array<double>").repartition(5)
    hits, visits = re_.dense_search(df.filter("id % 20 = 3"), df, k=6, query_id="id", doc_id="id", vector="v", chunk=50)
    score = x @ x.T
    got = {}
    for r in hits.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.doc_id, r.score))
    assert set(got) == set(range(3, n, 20))
    for q, rows in got.items():
        want = sorted(range(n), key=lambda i: (-score[q][i], i))[:6]
        found = [i for _, i, _ in sorted(rows)]
        assert np.allclose(score[q][found], score[q][want]) and len(set(found)) == 6
    assert [i for _, i, _ in sorted(got[3])][:3] == [3, 7, 11]
    v = visits.first()
    assert v.pairs == n * len(got)
    return v.visited / v.pairs


def test_vectors_and_a_share_that_falls(spark):
    small, large = share_visited(spark, 300), share_visited(spark, 2400)
    assert large < small < 1 and large < 0.2


def test_few_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "id int, v array<double>")
    got = re_.dense_top_k(df, df, k=5, query_id="id", doc_id="id", vector="v").collect()
    assert sorted((r.query_id, r.rank, r.doc_id, r.score) for r in got) == [(1, 1, 1, 1.0), (1, 2, 2, 0.0), (2, 1, 2, 4.0), (2, 2, 1, 0.0)]
    assert re_.dense_top_k(df, df.limit(0), k=5, query_id="id", doc_id="id", vector="v").count() == 0
