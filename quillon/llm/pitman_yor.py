"""Language-model scoring with a hierarchical Pitman-Yor model.

Three levels of restaurants. A word is seated in the restaurant of the word before it. The tables
there are customers in the restaurant of that word's ending (its last three bytes and whether it is
longer), and the tables of those are customers of one root, whose base is uniform over the words and
one unknown word. There are as many restaurants as words that something follows.

Gibbs: a sweep draws for each (context, word) how many tables its customers sit at, given the
other tables of that restaurant and the parent's probability of the word; then the parent and the
root are reseated likewise, and the discounts are set anew from how many dishes have one and two
customers. The draw is exact for up to 32 customers (generalised Stirling numbers) and seats any
further ones one by one. All restaurants of a sweep see the totals of the sweep before.
Probabilities are averaged over the last sweeps.

Data flow: tasks turn documents into packed counts per bucket of (context, word) pairs, which are
shuffled and merged once; a row holds all that a batch of documents sends to a bucket, so there are
never more rows than pairs. Which documents hold which pair stays with the batch. Buckets are by word,
frequent words are spread further by ending: all that is seated below one dish of the middle level is in
one bucket. After each sweep a bucket writes its tables and tells its totals: those of frequent contexts,
endings and frequent words are bounded and go through the driver; those of other contexts that several
buckets have are summed where their names are dealt to and go back to these buckets. So every
restaurant knows its own totals, and the probabilities of each context sum to one. At the end each bucket
answers the pairs of each batch in the order they came in, and the batch adds up its documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import pack, unpack
from .shared import bounded_batches, discard, written
from .words import Words, mix, texts_of

#: Bound on the frequent words and contexts; endings.
FREQUENT, ENDINGS = 1 << 16, 1 << 16
#: Tokens in a bucket, bytes of text packed at once, and documents among them; bytes that a token takes, about.
BUCKET_TOKENS, PACK_BYTES, PACK_DOCS, TOKEN_BYTES = 1_000_000, 6 << 20, 16384, 6
#: One text in so many tells which words are frequent, which is all about where their pairs are counted.
SAMPLE = 16
#: Sweeps, and how many of the last are averaged.
SWEEPS, AVERAGED = 4, 2
#: Strength of all restaurants.
STRENGTH, SEED = 1.0, 17
EXACT = 32
_END, _START = np.uint64(0x656E64), mix(np.array([0x7374617274], dtype=np.uint64))[0] >> np.uint64(8)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ENDING = np.uint64(ENDINGS - 1)


# ---- words and contexts ---------------------------------------------------------


class Tokens:
    """Tokens of some texts: 56-bit word names with an end after each text, and the context of each: 40 bits
    of the name of the word before and 16 bits of the name of its ending."""

    def __init__(self, texts: list[bytes]):
        words = Words([t.translate(_LOWER) for t in texts])
        name = words.names()[:, 0] >> np.uint64(8)
        buf, end = words.buf, words.end
        size = end - words.start
        last = lambda k: np.where(size >= k, buf[end - k], 0).astype(np.uint32)
        code = last(1) | (last(2) << 8) | (last(3) << 16) | (np.minimum(size, 4).astype(np.uint32) << 24)
        ending = mix(code.astype(np.uint64)) >> np.uint64(48)
        many = np.diff(words.first)
        self.doc = np.repeat(np.arange(len(texts)), many + 1)
        ends = np.cumsum(many + 1) - 1
        total = len(name) + len(texts)
        is_end = np.zeros(total, dtype=bool)
        is_end[ends] = True
        self.word = np.full(total, _END, dtype=np.uint64)
        self.word[~is_end] = name
        own = np.full(total, _START, dtype=np.uint64)
        own[~is_end] = (name & ~_ENDING) | ending  # 16 of the 56 bits make room
        self.context = np.empty(total, dtype=np.uint64)
        if total:
            self.context[0], self.context[1:] = _START, own[:-1]  # after an end comes a start


def place_of(names: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Where each name is in a sorted array, -1 where it is not."""
    if not len(among):
        return np.full(len(names), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(among, names), len(among) - 1)
    return np.where(among[at] == names, at, -1)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[bytes]]]:
    """Rows and their texts, about PACK_BYTES of them at once, or one longer text."""
    held: list[pa.RecordBatch] = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        new, at = texts_of(batch.column("text")), 0
        batch = batch.drop_columns(["text"])
        for k, t in enumerate(new):
            if texts and (size + len(t) > PACK_BYTES or len(texts) >= PACK_DOCS):
                yield pa.Table.from_batches([*held, batch.slice(at, k - at)]), texts
                held, texts, size, at = [], [], 0, k
            texts.append(t)
            size += len(t)
        held.append(batch.slice(at))
    if texts:
        yield pa.Table.from_batches(held), texts


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with over 1/(2 FREQUENT) of a task's tokens, and under 0 the number of tokens."""
    seen: dict[int, int] = {}
    total = 0
    for _, texts in _parts(batches):
        word = Tokens(texts).word
        total += len(word)
        u, n = np.unique(word, return_counts=True)
        some = n > max(1, len(word) / (2 * FREQUENT))  # of a part only what is frequent there: what is frequent in all is so in some part
        for x, count in zip(u[some].tolist(), n[some].tolist()):
            seen[x] = seen.get(x, 0) + count
        seen = _bounded(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.array([*seen, 0], dtype=np.uint64).view(np.int64)), pa.array([*seen.values(), total], pa.int64())], names=["name", "n"])


def _bounded(seen: dict) -> dict:
    """Of more than 8 FREQUENT names the most frequent half, as a task cannot have more than 2 FREQUENT of the wanted ones."""
    if len(seen) <= 8 * FREQUENT:
        return seen
    return dict(sorted(seen.items(), key=lambda x: -x[1])[: 4 * FREQUENT])


# ---- packing --------------------------------------------------------------------

#: Words, pairs of each, contexts, that of each pair, its training count.
_COUNTS = (np.uint64, np.uint32, np.uint64, np.uint32, np.uint32)
#: Documents of each pair, which, how often in each.
_ENTRIES = (np.uint32, np.uint16, np.uint32)
_PACKED = "bucket int, batch long, counts binary, entries binary, ids binary"


def _pack(buckets: int, handle):
    """A row for each bucket with the counts of the batch's pairs there, and one below 0 with which documents hold
    which pair how often, in the order of those rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        common, serial = handle.value, TaskContext.get().partitionId() << 24
        for part, texts in _parts(batches):
            t = Tokens(texts)
            row = part.column("row").to_numpy()
            learn = part.column("train").to_numpy()
            word, code = np.unique(t.word, return_inverse=True)
            ctx, before = np.unique(t.context, return_inverse=True)
            pair, which = np.unique(code * len(ctx) + before, return_inverse=True)
            key, times = np.unique(which * len(texts) + t.doc, return_counts=True)
            doc, of_pair = key % len(texts), key // len(texts)
            first = np.searchsorted(of_pair, np.arange(len(pair)))
            entries = np.diff(np.append(first, len(key)))
            train = np.add.reduceat(np.where(learn[doc], times, 0), first)
            of, context = pair // len(ctx), pair % len(ctx)
            spread = (place_of(word, common.words) >= 0)[of]
            where = mix(word[of] + np.where(spread, (ctx[context] & _ENDING) + np.uint64(1), np.uint64(0)) * np.uint64(0x9E3779B97F4A7C15))
            bucket = (where % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = []
            for b in np.flatnonzero(np.diff(edge)).tolist():
                at = order[edge[b] : edge[b + 1]]
                codes, count = np.unique(of[at], return_counts=True)
                names, index = np.unique(context[at], return_inverse=True)
                rows.append((b, serial, pack(word[codes], count.astype(np.uint32), ctx[names], index.astype(np.uint32), train[at].astype(np.uint32)), None, None))
                if len(rows) >= 64:
                    yield _rows(rows)
                    rows = []
            m = entries[order]
            pos = np.repeat(first[order] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            yield _rows([*rows, (-1 - serial % buckets, serial, None, pack(m.astype(np.uint32), doc[pos].astype(np.uint16), times[pos].astype(np.uint32)), pack(row))])
            serial += 1

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64()] + [pa.binary()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in _PACKED.split(", ")])


_MERGED = "bucket int, counts binary, parts array<struct<batch:bigint,pairs:binary,entries:binary,ids:binary>>"


def _merge(table: pa.Table) -> pa.Table:
    """All rows of a bucket as one: distinct pairs with their training counts, and the pairs of each batch."""
    rows = sorted(table.to_pylist(), key=lambda r: r["batch"])
    if rows[0]["bucket"] < 0:
        return _merged(rows[0]["bucket"], None, [{"batch": r["batch"], "pairs": None, "entries": r["entries"], "ids": r["ids"]} for r in rows])
    got = [unpack(r["counts"], *_COUNTS) for r in rows]
    words, of_word = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
    contexts, of_context = np.unique(np.concatenate([g[2] for g in got]), return_inverse=True)
    a = b = 0
    keys = []
    for w, per_word, c, index, _ in got:
        keys.append(np.repeat(of_word[a : a + len(w)].astype(np.int64), per_word) << 32 | of_context[b : b + len(c)][index])
        a, b = a + len(w), b + len(c)
    pair, place = np.unique(np.concatenate(keys), return_inverse=True)
    train = np.bincount(place, weights=np.concatenate([g[4] for g in got]), minlength=len(pair))
    edge = np.cumsum([len(k) for k in keys])[:-1]
    parts = [{"batch": r["batch"], "pairs": pack(x.astype(np.uint32)), "entries": None, "ids": None} for r, x in zip(rows, np.split(place, edge))]
    counts = pack(words, np.bincount(pair >> 32, minlength=len(words)).astype(np.uint32), contexts, (pair & 0xFFFFFFFF).astype(np.uint32), train.astype(np.uint32))
    return _merged(rows[0]["bucket"], counts, parts)


def _merged(bucket: int, counts: bytes | None, parts: list[dict]) -> pa.Table:
    kind = pa.list_(pa.struct([("batch", pa.int64()), ("pairs", pa.binary()), ("entries", pa.binary()), ("ids", pa.binary())]))
    return pa.table({"bucket": pa.array([bucket], pa.int32()), "counts": pa.array([counts], pa.binary()), "parts": pa.array([parts], kind)})


# ---- seating --------------------------------------------------------------------


@lru_cache(maxsize=8)
def stirling(discount: float) -> np.ndarray:
    """log S[c, t]: weight of all ways to seat c customers at t tables, generalised by the discount."""
    log = np.full((EXACT + 1, EXACT + 2), -np.inf)
    log[1, 1] = 0.0
    for c in range(1, EXACT):
        t = np.arange(1, EXACT + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = np.where(t <= c, log[c, 1:-1] + np.log(np.maximum(c - t * discount, 1e-300)), -np.inf)
        log[c + 1, 1:-1] = np.logaddexp(log[c, :-2], stay)
    return log[:, :-1]


def draw_tables(c: np.ndarray, others: np.ndarray, p: np.ndarray, discount: float, strength: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each row's c customers, given the other tables of its restaurant and the parent's
    probability of what they eat."""
    t = np.minimum(c, 1).astype(np.int64)
    log = stirling(discount)
    start = np.minimum(c, EXACT)
    for size in range(2, EXACT + 1):
        at = np.flatnonzero(start == size)
        for a in range(0, len(at), 50_000):
            rows = at[a : a + 50_000]
            k = np.arange(size)
            step = np.log(strength + discount * (others[rows, None] + k)) + np.log(p[rows, None])
            weight = log[size, 1 : size + 1] + np.cumsum(step, axis=1)
            share = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            t[rows] = 1 + (share < rng.random(len(rows))[:, None] * share[:, -1:]).sum(axis=1)
    rows = np.flatnonzero(c > EXACT)
    have = np.full(len(rows), EXACT, dtype=np.float64)
    while len(rows):  # seated one by one, from one new table to the next
        a = (strength + discount * (others[rows] + t[rows])) * p[rows]
        x = have - discount * t[rows] + (a - 1) / 2
        with np.errstate(over="ignore"):
            far = np.minimum(x * rng.random(len(rows)) ** (-1 / a) - x, 1e18)  # customers until a new table
        have = have + np.floor(far) + 1
        new = have <= c[rows]
        rows, have = rows[new], have[new]
        t[rows] += 1
    return t


class Common:
    """Names that all tasks know, sorted: frequent words and contexts."""

    def __init__(self, words: np.ndarray):
        self.words = np.unique(words)
        self.contexts = np.unique(np.append(words, _START) >> np.uint64(16))


class Globals:
    """What all buckets share before a sweep: customers and tables (rows 0 and 1) of frequent contexts, of
    endings, of the root; the root's base; of frequent words training counts, customers and tables; the
    discounts of the three levels."""

    def __init__(self, contexts, endings, root, base, counts, words, discounts):
        self.contexts, self.endings, self.root, self.base = contexts, endings, root, base
        self.counts, self.words, self.discounts = counts, words, discounts


def seated(level: int, g: Globals, c, t, customers, tables, parent):
    """A dish's probability in a restaurant of so many customers and tables, c and t of them with this dish."""
    d = g.discounts[level]
    return (c - d * t + (STRENGTH + d * tables) * parent) / (STRENGTH + customers)


class Bucket:
    """A bucket's pairs and their seating on all three levels."""

    def __init__(self, number: int, counts: bytes, common: Common, state: bytes | None = None, totals: list[tuple[int, bytes]] | None = None):
        self.number, self.common = number, common
        self.words, per_word, contexts, index, c = unpack(counts, *_COUNTS)
        self.of = np.repeat(np.arange(len(self.words)), per_word)
        self.c = c.astype(np.int64)
        # the middle level: one dish for each word and ending
        mid, self.mid = np.unique((self.of << 16) | (contexts[index] & _ENDING).astype(np.int64), return_inverse=True)
        self.mid_word, self.ending = mid >> 16, mid & (ENDINGS - 1)
        self.slot = place_of(self.words, common.words)
        self.own = self.slot < 0
        if state is None:
            self.t = np.minimum(self.c, 1)
            self._count_tables()
            self.t1 = np.minimum(self.c1, 1)
            self._count_dishes()
            self.t0 = np.minimum(self.c0, 1)
        else:
            self.t, self.t1, self.t0 = (x.astype(np.int64) for x in unpack(state, np.uint32, np.uint32, np.uint32))
            self._count_tables()
            self._count_dishes()
        self.count = np.bincount(self.of, weights=self.c, minlength=len(self.words)).astype(np.int64)
        # contexts: frequent ones by their place, others by their number here
        self.known = place_of(contexts >> np.uint64(16), common.contexts)[index]
        rare, self.rare_at = np.unique(np.where(self.known < 0, index, len(contexts)), return_inverse=True)
        self.rare = contexts[rare[rare < len(contexts)]]
        self.elsewhere = None  # customers and tables of the rare contexts in all buckets, and which have several
        if totals is not None:
            order = self.dealt(1)[0]
            found = [unpack(data, np.uint32, np.uint32, np.uint8) for _, data in sorted(totals)]
            self.elsewhere = [np.empty(len(self.rare), dtype=np.int64) for _ in range(3)]
            for k, x in enumerate(self.elsewhere):
                x[order] = np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64)

    def _count_tables(self) -> None:
        self.c1 = np.bincount(self.mid, weights=self.t, minlength=len(self.ending)).astype(np.int64)

    def _count_dishes(self) -> None:
        self.c0 = np.bincount(self.mid_word, weights=self.t1, minlength=len(self.words)).astype(np.int64)

    def state(self) -> bytes:
        return pack(*(x.astype(np.uint32) for x in (self.t, self.t1, self.t0)))

    def dealt(self, places: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rare contexts in the order of their other names, those names, and the place that each is dealt to."""
        hashed = mix(self.rare ^ np.uint64(0xC2B2AE3D27D4EB4F))
        order = np.argsort(hashed)
        return order, hashed[order], ((hashed[order] >> np.uint64(32)) * np.uint64(places) >> np.uint64(32)).astype(np.int64)

    def rare_sums(self) -> list[np.ndarray]:
        """Customers and tables here of each context that is not frequent."""
        return [np.bincount(self.rare_at, weights=x, minlength=len(self.rare) + 1)[: len(self.rare)] for x in (self.c, self.t)]

    def totals(self, g: Globals) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of each pair's context, wherever they are."""
        sums = self.elsewhere[:2] if self.elsewhere is not None else self.rare_sums()
        frequent = self.known >= 0
        return tuple(np.where(frequent, known[np.maximum(self.known, 0)], np.append(own, 0)[self.rare_at]) for known, own in zip(g.contexts, sums))

    def root(self, g: Globals) -> np.ndarray:
        c, t = self.c0.copy(), self.t0.copy()
        c[~self.own], t[~self.own] = (x[self.slot[~self.own]] for x in g.words)
        return seated(0, g, c, t, *g.root, g.base)

    def middle(self, g: Globals) -> np.ndarray:
        customers, tables = (x[self.ending] for x in g.endings)
        return seated(1, g, self.c1, self.t1, customers, tables, self.root(g)[self.mid_word])

    def probability(self, g: Globals) -> np.ndarray:
        return seated(2, g, self.c, self.t, *self.totals(g), self.middle(g)[self.mid])

    def sweep(self, g: Globals, k: int) -> None:
        rng = np.random.default_rng([SEED, self.number, k])
        root, middle, tables = self.root(g), self.middle(g), self.totals(g)[1]
        many = np.flatnonzero(self.c > 1)
        self.t[many] = draw_tables(self.c[many], tables[many] - self.t[many], middle[self.mid[many]], g.discounts[2], STRENGTH, rng)
        self._count_tables()
        others = g.endings[1][self.ending] - self.t1
        self.t1 = np.minimum(self.c1, 1)
        many = np.flatnonzero(self.c1 > 1)
        self.t1[many] = draw_tables(self.c1[many], others[many], root[self.mid_word[many]], g.discounts[1], STRENGTH, rng)
        self._count_dishes()
        self.t0 = np.minimum(self.c0, 1)
        some = np.flatnonzero(self.own & (self.c0 > 1))
        self.t0[some] = draw_tables(self.c0[some], np.full(len(some), max(g.root[1] - 1, 0)), np.full(len(some), g.base), g.discounts[0], STRENGTH, rng)

    def report(self) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(kind, keys, a, b). Customers and tables of: 0 endings, 3 frequent contexts. 1: training count and
        customers of frequent words. 2, scalars: tokens and words; customers and tables of the other words at
        the root; per level dishes with one customer and with two."""
        out, own = [], self.own
        sums = [np.bincount(self.ending, weights=x, minlength=ENDINGS) for x in (self.c1, self.t1)]
        out.append((0, np.flatnonzero(sums[0]), *[x[sums[0] > 0] for x in sums]))
        out.append((1, self.slot[~own], self.count[~own], self.c0[~own]))
        one_two = lambda c: ((c == 1).sum(), (c == 2).sum())
        scalar = np.array([(self.c.sum(), (self.count[own] > 0).sum()), (self.c0[own].sum(), self.t0[own].sum()), one_two(self.c0[own]), one_two(self.c1), one_two(self.c)], dtype=np.float64)
        out.append((2, np.arange(5), scalar[:, 0], scalar[:, 1]))
        at = np.flatnonzero(self.known >= 0)
        sums = [np.bincount(self.known[at], weights=x[at], minlength=len(self.common.contexts)) for x in (self.c, self.t)]
        out.append((3, np.flatnonzero(sums[0]), *[x[sums[0] > 0] for x in sums]))
        return out

    def asked(self, places: int) -> Iterator[tuple[int, bytes]]:
        """(place, names, customers, tables) of the rare contexts, by the place that sums them up. Once it is
        known which of them other buckets have, only those are named with their tables; of the others all is here."""
        order, hashed, place = self.dealt(places)
        c, t = (x[order].astype(np.uint32) for x in self.rare_sums())
        some = np.ones(len(order), dtype=bool) if self.elsewhere is None else self.elsewhere[2][order] > 0
        for x, a, b in zip(*_groups(place)):
            yield x, pack(hashed[a:b][some[a:b]], c[a:b], t[a:b], some[a:b].astype(np.uint8))


def _groups(place: np.ndarray) -> tuple[list, list, list]:
    """Runs of equal numbers: the number, where it begins and ends."""
    x, first = np.unique(place, return_index=True)
    return x.tolist(), first.tolist(), [*first[1:].tolist(), len(place)]


def _summed(table: pa.Table) -> pa.Table:
    """Totals of the contexts dealt to one place, for each bucket in the order in which it asked."""
    rows = [unpack(x, np.uint64, np.uint32, np.uint32, np.uint8) for x in table.column("data").to_pylist()]
    names, which = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True)
    some = [r[3] > 0 for r in rows]
    c, t = (np.bincount(which, weights=np.concatenate([r[k][x] for r, x in zip(rows, some)]), minlength=len(names)).astype(np.uint32) for k in (1, 2))
    several = np.bincount(which, minlength=len(names)) > 1
    out, at = [], 0
    for (mine, own_c, own_t, _), x in zip(rows, some):
        own = which[at : at + len(mine)]
        at += len(mine)
        own_c, own_t, shared = own_c.copy(), own_t.copy(), np.zeros(len(x), dtype=np.uint8)
        own_c[x], own_t[x], shared[x] = c[own], t[own], several[own]
        out.append(pack(own_c, own_t, shared))
    return pa.table({"bucket": table.column("bucket"), "place": table.column("key").cast(pa.int64()), "data": pa.array(out, pa.binary())})


_REPORT = "kind int, key long, bucket int, a double, b double, data binary"
#: Kinds of a report's rows beyond those of Bucket.report.
_STATE, _ASKED = 4, 5


def _bucket_of(batch: pa.RecordBatch, r: int, common: Common, state: str | None = None, totals: str | None = None) -> Bucket:
    """The bucket of a row, in the state of the named columns."""
    back = None
    if totals and batch.column(totals)[r].is_valid:
        back = [(x["place"], x["data"]) for x in batch.column(totals)[r].as_py()]
    return Bucket(batch.column("bucket")[r].as_py(), batch.column("counts")[r].as_py(), common, batch.column(state)[r].as_py() if state else None, (back or []) if totals else None)


def _report(handle, places: int, k: int):
    """The k-th sweep (none at first) and what is to be known of it."""

    def rows(kind: int, key, bucket: int, a=None, b=None, data=None) -> pa.RecordBatch:
        n = len(key)
        number = lambda x: pa.nulls(n, pa.float64()) if x is None else pa.array(np.asarray(x, np.float64))
        columns = [pa.array(np.full(n, kind, dtype=np.int32)), pa.array(np.asarray(key, np.int64)), pa.array(np.full(n, bucket, dtype=np.int32)), number(a), number(b), pa.nulls(n, pa.binary()) if data is None else pa.array(data, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _REPORT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, g = handle.value
        for batch in batches:
            for r in range(batch.num_rows):
                b = _bucket_of(batch, r, common, *(("state", "totals") if k else ()))
                if k:
                    b.sweep(g, k)
                for kind, keys, x, y in b.report():
                    for at in range(0, len(keys), 1 << 16):
                        cut = slice(at, at + (1 << 16))
                        yield rows(kind, keys[cut], b.number, x[cut], y[cut])
                yield rows(_STATE, [0], b.number, data=[b.state()])
                for place, data in b.asked(places):
                    yield rows(_ASKED, [place], b.number, data=[data])

    return run


def _discount(one: float, two: float) -> float:
    return float(np.clip(one / (one + 2 * two), 0.05, 0.95)) if one + two else 0.5


class Model:
    """The merged buckets, their states after the sweeps that count, and the globals of each."""

    def __init__(self, merged: DataFrame, common: Common, buckets: int):
        self.merged, self.common, self.buckets = merged, common, buckets
        self.known: list[Globals] = []
        self.states: list[tuple[DataFrame, DataFrame]] = []
        self.train_tokens = 0

    def rows(self, *columns: str, last: int = 1) -> DataFrame:
        """The buckets with their last states, the latest without a number: state, totals, state1, totals1, ..."""
        out = self.merged.filter("bucket >= 0").select("bucket", *columns)
        for i, (state, totals) in enumerate(reversed(self.states[-last:])):
            end = str(i) if i else ""
            out = out.join(state.select("bucket", F.col("data").alias(f"state{end}")), "bucket").join(totals.select("bucket", F.col("data").alias(f"totals{end}")), "bucket", "left")
        return out

    def home(self) -> DataFrame:
        """For each batch which documents hold which pairs."""
        return self.merged.filter("bucket < 0").select(F.explode("parts").alias("p")).select("p.batch", "p.entries", "p.ids")

    def step(self, keep: int) -> None:
        """A sweep, and its totals: at most ENDINGS + 2 FREQUENT + 5 rows for the driver; those of other contexts
        are summed up in tasks and brought back to the buckets that have them."""
        spark, k = self.merged.sparkSession, len(self.known)
        handle = spark.sparkContext.broadcast((self.common, self.known[-1] if k else None))
        rows = written(self.rows("counts").mapInArrow(_report(handle, self.buckets, k), _REPORT), "totals")
        found = rows.filter(F.col("kind") < _STATE).groupBy("kind", "key").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toArrow()
        kind, key, a, b = (np.asarray(found.column(c)) for c in ("kind", "key", "a", "b"))
        place = lambda i, n: np.array([np.bincount(key[kind == i], weights=x[kind == i], minlength=n) for x in (a, b)])
        common, scalar = self.common, place(2, 5)
        counts, customers = place(1, len(common.words)).astype(np.int64)
        scalar[:, 2] += (customers == 1).sum(), (customers == 2).sum()
        discounts = [_discount(*scalar[:, i]) for i in (2, 3, 4)]
        tables = np.minimum(customers, 1)
        if self.known:
            last, rng = self.known[-1], np.random.default_rng([SEED, k])
            many, base = np.flatnonzero(customers > 1), last.base
            tables[many] = draw_tables(customers[many], np.full(len(many), max(last.root[1] - 1, 0)), np.full(len(many), base), last.discounts[0], STRENGTH, rng)
        else:
            base = 1 / (scalar[1, 0] + (counts > 0).sum() + 1)
            self.train_tokens = int(scalar[0, 0])
        root = (scalar[0, 1] + customers.sum(), scalar[1, 1] + tables.sum())
        self.known.append(Globals(place(3, len(common.contexts)), place(0, ENDINGS), root, base, counts, np.array([customers, tables]), discounts))
        summed = rows.filter(F.col("kind") == _ASKED).select("key", "bucket", "data").groupBy("key").applyInArrow(_summed, "bucket int, place long, data binary")
        totals = written(summed.groupBy("bucket").agg(F.collect_list(F.struct("place", "data")).alias("data")), "context-totals")  # at most the bucket's own contexts
        state = written(rows.filter(F.col("kind") == _STATE).select("bucket", "data"), "tables")
        self.states.append((state, totals))
        discard(rows)
        if len(self.states) > keep:
            for table in self.states.pop(0):
                discard(table)


_ANSWER = "bucket int, batch long, answers binary"
#: Log-probabilities travel as whole numbers of this unit.
UNIT = 1e-6


def _answer(handle, averaged: int):
    """For each bucket, in the order of its pairs: the training count of the word and the averaged log10 probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, known = handle.value
        for batch in batches:
            for r in range(batch.num_rows):
                p = 0.0
                for i, g in enumerate(reversed(known)):
                    end = str(i) if i else ""
                    b = _bucket_of(batch, r, common, f"state{end}", f"totals{end}")
                    p = p + b.probability(g)
                log = np.rint(np.log10(p / averaged) / UNIT).astype(np.int32)
                count = b.count.copy()
                count[~b.own] = known[-1].counts[b.slot[~b.own]]
                yield pa.RecordBatch.from_arrays([pa.array([b.number], pa.int32()), pa.array([pack(count[b.of], log)], pa.binary())], names=["bucket", "answers"])

    return run


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The answers of a bucket for each batch, in the order of the batch's pairs."""
    for batch in batches:
        for r in range(batch.num_rows):
            count, log = unpack(batch.column("answers")[r].as_py(), np.int64, np.int32)
            for part in batch.column("parts")[r].as_py():
                [pair] = unpack(part["pairs"], np.uint32)
                yield pa.RecordBatch.from_arrays([batch.column("bucket").slice(r, 1), pa.array([part["batch"]]), pa.array([pack(count[pair], log[pair])], pa.binary())], names=[c.split()[0] for c in _ANSWER.split(", ")])


def _total(floor: int):
    """Sums for the documents of one batch."""

    def run(home: pa.Table, answers: pa.Table) -> pa.Table:
        rows = sorted(answers.to_pylist(), key=lambda r: r["bucket"])
        count, log = (np.concatenate(x) for x in zip(*(unpack(r["answers"], np.int64, np.int32) for r in rows)))
        m, doc, times = unpack(home.column("entries")[0].as_py(), *_ENTRIES)
        [ids] = unpack(home.column("ids")[0].as_py(), np.int64)
        pair = np.repeat(np.arange(len(m)), m)
        total = lambda x: np.bincount(doc, weights=times * x[pair], minlength=len(ids))
        whole = lambda x: pa.array(x.astype(np.int64))
        return pa.table({"row": ids, "n_tokens": whole(np.bincount(doc, weights=times, minlength=len(ids))), "n_known": whole(total(count > 0)), "base_score": total(np.log10((count + 1) / floor)), "score": total(log * UNIT)})

    return run


def fit(base: DataFrame, *, sweeps: int = SWEEPS, averaged: int = AVERAGED, bucket_tokens: int = BUCKET_TOKENS) -> Model:
    """base(row, train, text): a model of the texts that train, with the states of the last sweeps and with
    which documents of all hold which pairs."""
    if not 1 <= averaged <= sweeps:
        raise ValueError("averaged must be from 1 to sweeps")
    spark = base.sparkSession
    bounded_batches(spark)
    some = base.filter(F.pmod(F.xxhash64("row"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(_frequent, "name long, n long")
    heavy = written(some.groupBy("name").agg(F.sum("n").alias("n")), "frequent")
    seen = heavy.filter("name = 0").agg(F.sum("n")).first()[0] or 0
    most = heavy.filter((F.col("name") != 0) & (F.col("n") * FREQUENT > seen)).orderBy(F.desc("n"), "name").limit(FREQUENT).toArrow()
    common = Common(np.asarray(most.column("name")).astype(np.int64).view(np.uint64))
    tokens = base.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) / TOKEN_BYTES + 1)).first()[0] or 0
    buckets = max(1, -(-int(tokens) // bucket_tokens))

    def merged() -> DataFrame:
        packed = base.mapInArrow(_pack(buckets, spark.sparkContext.broadcast(common)), _PACKED)
        return packed.repartition(max(1, -(-buckets // 2)), "bucket").groupBy("bucket").applyInArrow(_merge, _MERGED)

    model = Model(written(merged(), "buckets"), common, buckets)  # nothing else refers to the plan, so its shuffle goes once it is written
    for _ in range(sweeps + 1):
        model.step(averaged)
    return model


def lm_score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2, sweeps: int = SWEEPS, averaged: int = AVERAGED, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """Scores every text by a model of those whose crc32 of the id as text, modulo `folds`, is not `held_fold`.

    Returns one row per row of `docs`: the id, held_out, n_tokens (words `[^\\x20\\x09-\\x0D]+` after
    lower-casing A-Z, and one end), n_known (tokens seen in training), train_tokens, base_score
    (add-one unigram, log10) and score (log10 probability under the model; each pair's is rounded to a
    millionth). Null and empty texts are one end token. A null id is not held out. Repeated rows are texts
    of their own, each scored, each learned from. If there is nothing to learn from, all probability is the
    unknown word's: score and base_score are 0. Texts are read whole; other columns are not read, whatever
    their names. An empty table gives none. Equal runs give equal scores.
    """
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == held_fold, F.lit(False))
    base = docs.select(F.col(id_col).alias("id"), held.alias("held"), F.col(text_col).alias("text"))
    # a row's name: equal rows share it and, having equal results, are told apart by how many they are
    base = base.withColumn("row", F.xxhash64("id", "text"))
    model = fit(base.select("row", (~F.col("held")).alias("train"), "text"), sweeps=sweeps, averaged=averaged, bucket_tokens=bucket_tokens)
    spark, common = docs.sparkSession, model.common
    known = model.known[-averaged:]
    floor = model.train_tokens + round(1 / known[0].base)
    answers = written(model.rows("counts", last=averaged).mapInArrow(_answer(spark.sparkContext.broadcast((common, known)), averaged), "bucket int, answers binary"), "answers")
    for table in [x for both in model.states for x in both]:
        discard(table)
    answers = model.merged.filter("bucket >= 0").select("bucket", "parts").join(answers, "bucket").mapInArrow(_dealt, _ANSWER)
    sums = model.home().groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_total(floor), "row long, n_tokens long, n_known long, base_score double, score double")
    sums = sums.groupBy("row").agg(F.count("*").alias("copies"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    sums = written(sums, "scores")
    each = lambda c: (F.col(c) / F.col("copies")).cast(sums.schema[c].dataType)
    return base.select("id", "held", "row").join(sums, "row").select(F.col("id").alias(id_col), F.col("held").alias("held_out"), each("n_tokens").alias("n_tokens"), each("n_known").alias("n_known"), F.lit(model.train_tokens).cast("long").alias("train_tokens"), each("base_score").alias("base_score"), each("score").alias("score"))


def perplexity(scores: DataFrame, *by: str, score: str = "score", n_tokens: str = "n_tokens") -> DataFrame:
    """From lm_score, for all rows or for each value of `by`: n_docs, tokens and perplexity, ten to the
    power of minus the mean log10 probability of a token. No rows: no tokens and a null perplexity."""
    sums = (F.count("*").alias("n_docs"), F.coalesce(F.sum(n_tokens), F.lit(0)).cast("long").alias("tokens"), F.sum(score).alias("_log"))
    per = F.when(F.col("tokens") > 0, F.pow(F.lit(10.0), -F.col("_log") / F.col("tokens"))).alias("perplexity")
    return (scores.groupBy(*by) if by else scores).agg(*sums).select(*by, "n_docs", "tokens", per)
