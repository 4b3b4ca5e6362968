import math
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from quillon.llm import pitman_yor
from quillon.llm.pitman_yor import draw_tables, lm_score, perplexity, stirling

DATA = "/root/testdata/sf0.01"


def brute(rows):
    def tokens(t):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split() + [None]

    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    c = Counter(w for (_, t), h in zip(rows, held) if not h for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return {(i, h, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n): sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)) for (i, t), h in zip(rows, held)}


def check(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, score string").repartition(3)
    got = lm_score(df, **options).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert abs(want[r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens] - r.base_score) < 1e-6 * max(1, -r.base_score)
        assert r.score <= 1e-12 and math.isfinite(r.score)
    return got


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = check(spark, rows, bucket_tokens=60_000)
    for held in (False, True):
        part = [r for r in got if r.held_out == held]
        n = sum(r.n_tokens for r in part)
        model, base = (10 ** (-sum(getattr(r, x) for r in part) / n) for x in ("score", "base_score"))
        assert model < 0.95 * base, (held, model, base)


def test_odd_rows_and_repeats(spark):
    rows = [(1, None), (2, ""), (3, "A a b"), (4, "A a b"), (5, " \t"), (None, "c"), (16, "x"), (6, "long words here " * 30_000), (7, "b"), (7, "b")]
    first = sorted(map(tuple, check(spark, rows)), key=str)
    assert sorted(map(tuple, check(spark, rows[::-1])), key=str) == first


def test_nothing_to_learn(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    [r] = check(spark, [(held, "a b")])
    assert r.score == r.base_score == r.train_tokens == 0
    assert lm_score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def seatings(c, d):
    """Weight of each number of tables, over all seatings of c customers one by one."""
    out = Counter()
    for choice in product(range(c), repeat=c - 1):
        sizes, weight = [1], 1.0
        for x in choice:
            if x < len(sizes):
                weight *= sizes[x] - d
                sizes[x] += 1
            elif x == len(sizes):
                sizes.append(1)
            else:
                break
        else:
            out[len(sizes)] += weight
    return out


def test_stirling():
    for c in range(1, 7):
        want = seatings(c, 0.3)
        for t in range(1, c + 1):
            assert math.isclose(math.exp(stirling(0.3)[c, t]), want[t], rel_tol=1e-9)


@pytest.mark.parametrize("c, others, p", [(5, 40, 0.05), (7, 0, 0.5)])
def test_draws_follow_their_distribution(c, others, p):
    d, strength, n = 0.4, 1.0, 40_000
    w = {t: x * math.prod((strength + d * (others + k)) * p for k in range(t)) for t, x in seatings(c, d).items()}
    drawn = Counter(draw_tables(np.full(n, c), np.full(n, others), np.full(n, p), d, strength, np.random.default_rng(1)).tolist())
    for t, x in w.items():
        assert abs(drawn[t] / n - x / sum(w.values())) < 0.01


def test_many_customers():
    """Far beyond the exact part, tables grow as one by one seating makes them grow."""
    rng, c, others, p, d = np.random.default_rng(2), 3000, 50, 0.02, 0.5
    got = draw_tables(np.full(400, c), np.full(400, others), np.full(400, p), d, 1.0, rng).mean()
    slow = []
    for _ in range(60):
        t = int(draw_tables(np.array([32]), np.array([others]), np.array([p]), d, 1.0, rng)[0])
        for i in range(32, c):
            a = (1 + d * (others + t)) * p
            t += rng.random() < a / (a + i - d * t)
        slow.append(t)
    assert abs(got - np.mean(slow)) < 4 * np.std(slow) / math.sqrt(60) + 0.3


# ---- one bucket against a franchise of restaurants seated one customer at a time ----

NONE = np.zeros(0, dtype=np.uint64)
DISCOUNTS = [0.3, 0.4, 0.5]


def bucket_of(counts):
    """counts: {(context, word): times}; contexts and words are small numbers, a context's ending is its last digit."""
    words = np.unique([w for _, w in counts]).astype(np.uint64)
    name = lambda u: (u << 16) | (u % 10)
    contexts = np.unique([name(u) for u, _ in counts]).astype(np.uint64)
    rows = sorted((int(np.searchsorted(words, w)), int(np.searchsorted(contexts, name(u))), c) for (u, w), c in counts.items())
    of, index, c = (np.array(x, dtype=np.uint32) for x in zip(*rows))
    data = pitman_yor.pack(words, np.bincount(of, minlength=len(words)).astype(np.uint32), contexts, index, c)
    return pitman_yor.Bucket(0, data, pitman_yor.Common(NONE)), words, contexts


def globals_of(b):
    ending = [np.bincount(b.ending, weights=x, minlength=pitman_yor.ENDINGS) for x in (b.c1, b.t1)]
    none = np.zeros((2, 1))
    return pitman_yor.Globals(none, np.array(ending), (b.c0.sum(), b.t0.sum()), 1 / (len(b.words) + 1), np.zeros(0, np.int64), np.zeros((2, 0), np.int64), DISCOUNTS)


COUNTS = {(11, 1): 4, (11, 2): 1, (21, 1): 3, (21, 3): 2, (12, 2): 2, (12, 1): 1, (12, 4): 0, (32, 4): 5, (11, 4): 0}


class Restaurant:
    def __init__(self, level, parent):
        self.d, self.parent, self.tables = DISCOUNTS[level], parent, {}

    def p(self, w):
        sizes = self.tables.get(w, [])
        n, t = sum(map(sum, self.tables.values())), sum(map(len, self.tables.values()))
        return (sum(sizes) - self.d * len(sizes) + (1 + self.d * t) * self.parent.p(w)) / (1 + n)

    def add(self, w, rng):
        sizes = self.tables.setdefault(w, [])
        t = sum(map(len, self.tables.values()))
        weights = np.array([s - self.d for s in sizes] + [(1 + self.d * t) * self.parent.p(w)])
        k = rng.choice(len(weights), p=weights / weights.sum())
        if k < len(sizes):
            sizes[k] += 1
        else:
            sizes.append(1)
            self.parent.add(w, rng)

    def remove(self, w, rng):
        sizes = self.tables[w]
        k = rng.choice(len(sizes), p=np.array(sizes) / sum(sizes))
        sizes[k] -= 1
        if not sizes[k]:
            del sizes[k]
            self.parent.remove(w, rng)


class Base:
    def p(self, w):
        return 1 / 5  # four words and the unknown one

    def add(self, w, rng):
        pass

    remove = add


def test_averaged_predictions_against_seating_one_by_one():
    rng = np.random.default_rng(7)
    root = Restaurant(0, Base())
    endings = {u % 10: Restaurant(1, root) for u, _ in COUNTS}
    rooms = {u: Restaurant(2, endings[u % 10]) for u, _ in COUNTS}
    customers = [(u, w) for (u, w), c in COUNTS.items() for _ in range(c)]
    for u, w in customers:
        rooms[u].add(w, rng)
    slow, n = Counter(), 3000
    for _ in range(n):
        for u, w in customers:
            rooms[u].remove(w, rng)
            rooms[u].add(w, rng)
        for u, w in COUNTS:
            slow[u, w] += rooms[u].p(w) / n
    b, words, contexts = bucket_of(COUNTS)
    fast = Counter()
    for k in range(n):
        g = globals_of(b)
        b.sweep(g, k)
        p = b.probability(globals_of(b))
        for i in range(len(p)):
            fast[int(contexts[b.rare_at[i]]) >> 16, int(words[b.of[i]])] += p[i] / n
    assert set(fast) == set(slow)
    for key, p in slow.items():
        # sweeps reseat a whole dish given the others, one by one seating a customer: the same distribution
        assert abs(fast[key] - p) < 0.012 + 0.03 * p, (key, fast[key], p)


def test_probabilities_of_every_context_sum_to_one():
    every = {(u, w): c for u in (11, 21, 12, 32) for w in (1, 2, 3, 4) for c in [COUNTS.get((u, w), 0)]}
    b, words, contexts = bucket_of(every)
    for k in range(3):
        g = globals_of(b)
        p = b.probability(g)
        for u in range(len(contexts)):
            at = b.rare_at == u
            c, t = b.c[at].sum(), b.t[at].sum()
            ending = int(contexts[u]) & 0xFFFF
            unknown = pitman_yor.seated(2, g, 0, 0, c, t, pitman_yor.seated(1, g, 0, 0, *g.endings[:, ending], pitman_yor.seated(0, g, 0, 0, *g.root, g.base)))
            assert math.isclose(p[at].sum() + unknown, 1)
        b.sweep(g, k)


def test_probabilities_sum_to_one_over_many_buckets(spark, monkeypatch):
    """However many buckets share a context, an ending or a word: a restaurant's probabilities are those of its own
    totals, so that all dishes and what is left for the parent make one."""
    monkeypatch.setattr(pitman_yor, "FREQUENT", 4)
    rng = np.random.default_rng(3)
    texts = [" ".join(f"{x}{'ing' if x % 3 else 'ed'}" for x in rng.zipf(1.4, 40) % 60) for _ in range(300)]
    base = spark.createDataFrame([(k, k % 5 > 0, t) for k, t in enumerate(texts)], "row long, train boolean, text string").repartition(4)
    model = pitman_yor.fit(base, sweeps=3, averaged=2, bucket_tokens=1200)
    assert model.buckets > 8
    batch = model.rows("counts", last=2).toArrow().combine_chunks().to_batches()
    shared = 0
    for end, g in (("1", model.known[-2]), ("", model.known[-1])):
        left, tables, dishes, root = {}, Counter(), {}, 0.0
        for part in batch:
            for r in range(part.num_rows):
                b = pitman_yor._bucket_of(part, r, model.common, f"state{end}", f"totals{end}")
                p, middle, at_root, (customers, seats) = b.probability(g), b.middle(g), b.root(g), b.totals(g)
                names = pitman_yor.unpack(part.column("counts")[r].as_py(), *pitman_yor._COUNTS)
                for i, x in enumerate(names[2][names[3]].tolist()):
                    if b.known[i] >= 0:
                        x = ("frequent", int(b.known[i]))
                    rest = (1 + g.discounts[2] * seats[i]) / (1 + customers[i])
                    mass, was, n = left.get(x, (0.0, rest, 0))
                    assert math.isclose(was, rest)  # all buckets see the same totals
                    left[x] = mass + p[i] - rest * middle[b.mid[i]], rest, n + 1
                    tables[x] += 1
                for e, w, q in zip(b.ending.tolist(), b.mid_word.tolist(), middle.tolist()):
                    rest = (1 + g.discounts[1] * g.endings[1][e]) / (1 + g.endings[0][e])
                    dishes[e] = dishes.get(e, rest) + q - rest * at_root[w]
                rest = (1 + g.discounts[0] * g.root[1]) / (1 + g.root[0])
                new = b.own | (part.column("bucket")[r].as_py() == -1)
                root += (at_root[new] - rest * g.base).sum()
        for mass, rest, _ in left.values():
            assert math.isclose(mass + rest, 1, rel_tol=1e-9)
        assert all(math.isclose(x, 1, rel_tol=1e-9) for x in dishes.values())
        spread = pitman_yor.seated(0, g, g.words[0], g.words[1], *g.root, g.base)
        rest = (1 + g.discounts[0] * g.root[1]) / (1 + g.root[0])
        assert math.isclose(root + (spread - rest * g.base).sum() + rest, 1, rel_tol=1e-9)
        shared = max(shared, max(tables.values()))
    assert shared > 3


def test_contexts_shared_between_buckets(spark, monkeypatch):
    """Draws differ from bucket to bucket, but not in the mean of many documents."""
    rows = [(k, f"a{k} b{k} c{k}") for k in range(150)] + [(1000 + k, f"b{k} d{k}") for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    mean = lambda n: np.mean([r.score for r in lm_score(df, bucket_tokens=n).collect()])
    got = [mean(10**6), mean(150)]
    monkeypatch.setattr(pitman_yor, "FREQUENT", 4)
    got.append(mean(200))
    assert max(got) - min(got) < 0.02, got


def test_very_many_different_words_and_words_that_polynomials_confuse(spark):
    x, y = "a", "b"
    for _ in range(11):
        x, y = x + y, y + x
    check(spark, [(1, " ".join(f"w{k}" for k in range(300_000))), (3, f"{x} {x}"), (5, f"{y} w7")])


def test_perplexity(spark):
    df = spark.createDataFrame([(True, 3, -2.0), (True, 1, -1.0), (False, 2, -4.0)], "held_out boolean, n_tokens long, score double")
    got = {r.held_out: (r.n_docs, r.tokens, round(r.perplexity, 6)) for r in perplexity(df, "held_out").collect()}
    assert got == {True: (2, 4, round(10 ** 0.75, 6)), False: (1, 2, 100.0)}
    assert perplexity(df).first().tokens == 6 and perplexity(df.limit(0)).first().perplexity is None


def test_packing():
    rng = np.random.default_rng(1)
    arrays = [np.sort(rng.integers(0, 2**63, 100, dtype=np.uint64)), rng.integers(0, 9, 5).astype(np.uint16), np.zeros(0, np.uint64), np.arange(3, dtype=np.int64)]
    back = pitman_yor.unpack(pitman_yor.pack(*arrays), np.uint64, np.uint16, np.uint64, np.int64)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(arrays, back))
