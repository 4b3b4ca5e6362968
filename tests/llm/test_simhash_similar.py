"""The near-dedup of texts by similarity against the similarity of all pairs."""

import random

import corpus_pipeline
import numpy as np
import pytest
from quillon.llm.simhash_similar import one_of_each, search_radius, tables, wide_fingerprint


def brute(rows):
    sets = []
    for _, text in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    head = list(range(len(rows)))

    def top(x):
        while head[x] != x:
            x = head[x]
        return x

    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if 5 * len(b) >= 4 * len(a) and 5 * len(a) >= 4 * len(b) and 5 * len(a & b) >= 4 * len(a | b):
                head[top(i)] = top(j)
    low = {}
    for k, (i, _) in enumerate(rows):
        low[top(k)] = min(low.get(top(k), i), i)
    return sorted(low.values())


def edited():
    rng = random.Random(3)
    rows = []
    for base in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((30, 120, 400)))]
        for _ in range(15):  # from nearly equal to well below 0.8, around one text and one after the other
            copy = list(words)
            for k in rng.sample(range(len(copy)), rng.randrange(1, max(2, len(copy) // 25))):
                copy[k] = f"x{rng.randrange(5000)}"
            rows.append((len(rows), " ".join(["one very common line in all of them"] * (base % 3) + copy)))
            words = copy if base % 2 else words
    loop = "the same five words again " * 30  # one shingle holds most of the count, not of the set
    rows += [(900, None), (901, " "), (902, "x"), (903, "x y"), (904, loop + "first end of it here today"), (905, loop + "another one that nobody wrote before")]
    return rows


@pytest.mark.parametrize("folder", [None, "/root/testdata/sf0.01"])
def test_all_pairs(spark, folder):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()] if folder else edited()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert got == brute(rows) and len(got) < len(rows)


def test_recall_at_the_threshold(spark):
    """Pairs of a similarity of 0.8 to 0.85 exactly, each pair unlike all others: the links found."""
    rng = random.Random(8)
    rows, pairs = [], 0
    for k in range(400):
        n = rng.choice((40, 100, 300))
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        shingles = n - 4
        tail = int(shingles * rng.uniform(0.19, 0.245) / 2)  # so many shingles at the end are other ones in each
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: n - tail] + [f"x{rng.randrange(10**6)}" for _ in range(tail)]))]
    want = brute(rows)
    pairs = len(rows) - len(want)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = one_of_each(docs)
    found = len(rows) - got.count()
    assert pairs > 300 and 0.96 * pairs <= found <= pairs
    assert {r.doc_id for r in got.collect()} >= set(want)


def test_large_groups(spark, monkeypatch):
    """Shards larger than a block: groups of near copies, some at the edge of similarity, and other texts."""
    import quillon.llm.simhash_similar as module

    monkeypatch.setattr(module, "BLOCK", 16)
    rng = random.Random(4)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(300):
        copy = list(base)
        for j in rng.sample(range(200), rng.randrange(6)):
            copy[j] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
    rows += [(1000 + k, " ".join(f"y{rng.randrange(10**6)}" for _ in range(60))) for k in range(100)]
    rows += [(2000 + k, rows[k][1]) for k in range(0, 300, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in one_of_each(docs).collect()) == brute(rows)


def test_ids_and_names_that_clash(spark):
    names = ("_id", "_key", "key", "d", "n", "f0", "t", "shard", "c", "_copy")
    texts = ["alpha beta gamma delta epsilon zeta", "one two three four five six", "and quite another text under this id"]
    rows = [(7, texts[0]), (7, texts[1]), (None, texts[2]), (None, "a b"), (None, "a  B"), (None, None), (4, ""), (9, texts[0]), (7, texts[0]), (5, "long words " * 50_000)]
    df = spark.createDataFrame([(*r, *map(str, range(10))) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = [sorted(map(repr, one_of_each(df.repartition(n)).collect())) for n in (1, 4)]
    left = one_of_each(df)
    assert got[0] == got[1] and left.columns == df.columns and one_of_each(df.limit(0)).count() == 0
    assert sorted(((r.doc_id, (r.text or "").lower().split()[:2]) for r in left.collect()), key=str) == sorted([(7, ["alpha", "beta"]), (7, ["one", "two"]), (None, ["and", "quite"]), (None, ["a", "b"]), (4, []), (5, ["long", "words"])], key=str)


def test_figures():
    """More fingerprints take more tables, not a larger radius; a search finds what its figures promise."""
    assert [len(tables(n, 0.8)) for n in (10, 10**5, 10**7, 10**9)] == sorted(len(tables(n, 0.8)) for n in (10, 10**5, 10**7, 10**9))
    assert search_radius(0.8) < 32 and search_radius(0.95) < search_radius(0.8) < search_radius(0.6)
    rng = np.random.default_rng(1)
    radius, met = search_radius(0.8), 0
    shards = tables(50_000, 0.8)
    for _ in range(300):
        x = rng.integers(0, 2**63, 900, dtype=np.uint64)
        a, b = (np.unpackbits(wide_fingerprint(np.sort(s)).view(np.uint8), bitorder="little") for s in (x[:800], x[89:889]))
        met += (a != b).sum() <= radius and any((a[t] == b[t]).all() for t in shards)
    assert met >= 0.95 * 300
