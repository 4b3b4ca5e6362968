import numpy as np
import xxhash
from quillon.llm.components import components
from quillon.llm.simhash_dedup import fingerprint, link_fingerprints, near_pairs, simhash_dedup

DATA = "/root/testdata/sf0.001"


def slow(text, k=3):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    s = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def classes(items, linked):
    head = list(range(len(items)))

    def top(x):
        while head[x] != x:
            x = head[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = top(i), top(j)
                head[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(items))]


def brute(rows):
    f = [slow(t) for _, t in rows]
    c = classes(f, lambda a, b: (a ^ b).bit_count() <= 3)
    low = {k: min(rows[i][0] for i in range(len(rows)) if c[i] == k) for k in set(c)}
    return sorted((rows[i][0], f"{f[i]:016x}", low[c[i]]) for i in range(len(rows)))


def test_fingerprint(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(F.xxhash64(F.lit("a b é"))).first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest("a b é".encode(), 42)
    for t in ("", " ", "one", "One two", "a b c", "a b c d  e\tf" * 9, "Ä ä Z z" * 50):
        assert fingerprint(t.encode()) == slow(t)


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    rows += [(90001, None), (90000, ""), (90002, "x"), (90002, "x"), (90003, "long words " * 20000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, component_id int")
    assert sorted(tuple(r)[:3] for r in simhash_dedup(df).collect()) == brute(rows)
    assert {r.doc_id for r in simhash_dedup(df).filter("kept").collect()} == {c for _, _, c in brute(rows)}


def test_empty(spark):
    assert simhash_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def dense(n, seed):
    rng = np.random.default_rng(seed)
    near = [0x0123456789ABCDEF ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for _ in range(n)]
    return sorted({*near, *map(int, rng.integers(0, 2**63, n // 4))})


def test_forest():
    codes = np.array(dense(600, 1), dtype=np.uint64)
    shard = np.sort(np.random.default_rng(2).integers(0, 4, len(codes)))
    got = {(a, b) for x, y, _ in near_pairs(codes, shard) for a, b in zip(x.tolist(), y.tolist())}
    want = {(i, j) for j in range(len(codes)) for i in range(j) if shard[i] == shard[j] and (int(codes[i]) ^ int(codes[j])).bit_count() <= 3}
    assert got == want


def test_dense_shards_are_divided(spark):
    codes = dense(900, 3)
    df = spark.createDataFrame([(c - 2**64 if c >> 63 else c,) for c in codes], "f long")
    links = link_fingerprints(df, limit=16)
    want = classes(codes, lambda a, b: (a ^ b).bit_count() <= 3)
    got = {r.id & (2**64 - 1): r.component_id for r in components(links).collect()}
    index = {c: want[k] for k, c in enumerate(codes)}
    assert len({(got.get(c, c), index[c]) for c in codes}) == len({got.get(c, c) for c in codes}) == len(set(want))


def test_components(spark):
    rng = np.random.default_rng(5)
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + k) for k in range(1, 200)] + [tuple(map(int, x)) for x in rng.integers(2000, 2400, (250, 2))]
    got = {r.id: r.component_id for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    ids = sorted({x for p in links for x in p})
    near = {frozenset(p) for p in links}
    want = classes(ids, lambda a, b: frozenset((a, b)) in near)
    for i, c in zip(ids, want):
        assert got.get(i, i) == ids[c]
