"""The trie against one built node by node."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from quillon.llm.prefix_trie import extents, minima, prefix_trie, turn_sequences, with_shared_starts

FOLDER = "/root/testdata/sf0.001"


def brute(rows, every=5, most=9):
    """rows: (conv_id, turn, role, text)."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    convs = {c: [(r, t) for _, r, t in sorted(x, key=lambda y: y[0])] for c, x in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % most
        built[c] = convs.get(c - c % every, [])[:h] + own[h:]
    nodes = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    children, saved, leaves = {}, dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)
    for p, who in nodes.items():
        worth = (len(who) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += worth
            leaves[p[:d]] += p not in children
    return sorted(
        (min(who), len(p), -1 if not p else min(nodes[p[:-1]]), len(who), len(children.get(p, [])), leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(c for c in who if len(built[c]) == len(p)))).encode()).hexdigest())
        for p, who in nodes.items())


def rows_of(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def trie(spark, rows, **kw):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return rows_of(prefix_trie(with_shared_starts(turn_sequences(df)), **kw))


@pytest.mark.parametrize("range_nodes", [3, 17, 50_000])
def test_random_conversations(spark, range_nodes):
    draw = random.Random(range_nodes)
    rows = []
    for c in draw.sample(range(0, 9000), 120):
        for turn in range(draw.choice([1, 2, 3, 5, 12])):
            rows.append((c, turn, draw.choice(["user", "assistant"]), draw.choice(["a", "b", "ça va", ""])))
    rows += [(c, turn, "user", "same") for c in range(20_000, 20_060) for turn in range(4)]  # one conversation many times
    draw.shuffle(rows)
    assert trie(spark, rows, range_nodes=range_nodes) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (None, 1, "user", "nobody's"), (5, None, "user", "first"), (5, 0, None, None), (5, 1, "user", ""), (6, 3, "us", "erx"), (6, 2, "user", "x"),
        (7, 1, "user", "x"), (8, 1, "user", "x"), (8, 2, "user", "y" * 200_000), (9, 1, "user", "x"), (12, 1, "user", "x"), (10**12, 1, "user", "x")]
    assert trie(spark, rows) == brute(rows)
    assert trie(spark, rows, range_nodes=1) == brute(rows)


def test_repeated_turns_and_extra_columns(spark):
    df = spark.createDataFrame([(1, 1, "u", "x", 0, "n")] * 3 + [(2, 1, "u", "x", 1, "m")], "conv_id long, turn int, role string, text string, id int, key string")
    got = rows_of(prefix_trie(turn_sequences(df)))
    assert [(x[0], x[1], x[3]) for x in got] == [(1, 0, 2), (1, 1, 2), (1, 2, 1), (1, 3, 1)]


def test_no_rows(spark):
    assert trie(spark, []) == []


def test_only_root(spark):
    """A conversation that lends nothing and whose own turns are all replaced has none."""
    c = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    assert trie(spark, [(c, 0, "user", "x")]) == brute([(c, 0, "user", "x")]) == [(c, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_whole_table(spark):
    df = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    got = rows_of(prefix_trie(with_shared_starts(turn_sequences(df)), range_nodes=40))
    assert got == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_extents():
    values = np.random.default_rng(1).integers(0, 5, 70)
    values[0] = 0
    table = minima(values)
    row, depth = np.repeat(np.arange(70), 5), np.tile(np.arange(1, 6), 70)
    left, right = extents(table, row, depth)
    for r, d, a, b in zip(row, depth, left, right):
        x = r
        while x > 0 and values[x] >= d:
            x -= 1
        y = r
        while y + 1 < 70 and values[y + 1] >= d:
            y += 1
        assert (x, y) == (a, b)
