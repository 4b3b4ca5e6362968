import hashlib
from collections import Counter

import pytest
from quillon.llm.substring_dedup import substring_dedup

DATA = "/root/testdata/sf0.001"


def brute(texts, width):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def same(spark, rows, width):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_words string")
    got = substring_dedup(df, width=width).collect()
    want = [(i, *x) for (i, _), x in zip(rows, brute([t for _, t in rows], width))]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_hard_cases(spark):
    base = " ".join(f"w{k}" for k in range(200))
    rows = [
        (1, base), (2, None), (3, ""), (4, " \t\n"), (5, "word"),
        (6, "head " + " ".join(f"w{k}" for k in range(50, 120)) + " tail 中文 x"),
        (7, "la " * 300), (8, "q r " * 40 + "end"), (9, "z " * 36 + "la " * 36),
        (10, " ".join(f"w{k}" if k != 77 else "edit" for k in range(200))),
        (11, " ".join(["a"] * 34 + ["b"])), (12, " ".join(["a"] * 33 + ["b"])), (13, "m\x0bn\x0cp" * 30),
        (14, base), (14, base),
    ]
    for width in (2, 5, 35):
        same(spark, rows, width)


def thue_morse(rounds, a="a", b="b"):
    """A word and its complement that polynomials modulo a power of two cannot tell apart."""
    x, y = a, b
    for _ in range(rounds):
        x, y = x + y, y + x
    return x, y


def test_words_that_polynomials_confuse(spark):
    rest = " ".join(f"w{k}" for k in range(34))
    rows = []
    for rounds in (10, 11, 12):
        x, y = thue_morse(rounds)
        rows += [(len(rows), f"{x} {rest} r{rounds}"), (len(rows) + 1, f"{y} {rest} s{rounds}")]
    same(spark, [(k, t.replace("w0 ", f"v{k // 2} ")) for k, t in rows], 35)
    x, y = thue_morse(6, "p ", "q ")  # the same in words
    same(spark, [(1, x), (2, y), (3, x + y)], 35)


def test_one_very_long_word(spark):
    tail = " ".join(f"w{k}" for k in range(40))
    same(spark, [(1, "x" * 3_000_000 + " " + tail), (2, "x" * 3_000_001 + " " + tail)], 35)


def test_empty(spark):
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("width", [7, 35])
def test_documents(spark, width):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    same(spark, rows, width)
