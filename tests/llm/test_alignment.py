"""Alignment against a plain one of whole texts, with the libraries' own encoding of each."""

import hashlib
import json
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from quillon.llm.alignment import align, sides
from quillon.llm.bpe import byte_letters
from tokenizers import Tokenizer

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        names = {k: token for token, k in json.load(file)["model"]["vocab"].items()}
    return a, names, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def tokens(libraries, text):
    a, names, b = libraries
    if not text:
        return [], [], [], []
    byte = {letter: k for k, letter in enumerate(byte_letters())}
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    raw_a = [bytes(byte[c] for c in names[k]) for k in ids_a]
    raw_b = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids_b]
    if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
        return [], [], [], []
    return ids_a, ids_b, np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()


def brute(libraries, rows):
    done, counts = [], Counter()
    for doc, text in rows:
        a, b, ends_a, ends_b = tokens(libraries, text)
        span_a, span_b = ([(x, y, k) for x, y, k in zip([0, *ends[:-1]], ends, ids)] for ids, ends in ((a, ends_a), (b, ends_b)))
        links = []
        for x, y, k in span_a:
            links += [(k, j) for u, v, j in span_b if u < y and x < v]
        counts.update(links)
        groups, from_a, from_b = [], 0, 0
        for end in sorted({*ends_a} & {*ends_b}):
            to_a, to_b = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append(",".join(map(str, a[from_a:to_a])) + "|" + ",".join(map(str, b[from_b:to_b])))
            from_a, from_b = to_a, to_b
        done.append((doc, len(a), len(b), groups, links))
    best = Counter()
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return sorted(
        (-1 if doc is None else doc, n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for doc, n_a, n_b, groups, links in done)


def rows_of(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


ODD = [
    None, "", " ", "  ", "a", "a ", " a", "a  b", "a   b\n  c", "tab\t x\n", "line\n line", "x  y", "don't  stop", "naïve café über", "日本語 テキスト", "😀 🇩🇪 é", "▁ under ▁", "a▁b",
    "<s> </s> <unk> <|endoftext|> <0x41>", "12345 67890 3.14", "....  ,,,,", "\x00 zero", "\x1c \x85 odd", "a​ b᠎ c﻿ d  e　 f", "x" * 5000, "ab " * 3000, "long  " * 50, "\r\n\r\n  \r\n", "🏴󠁧󠁢󠁥󠁮󠁧󠁿 flag", "�", "Ā ġ Ġword"]


def test_odd_texts(spark, libraries):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "null id"), (4, "a"), (500, "a  b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as run", "1 as batch", "2 as id").repartition(5)
    assert rows_of(align(df)) == brute(libraries, rows)


@pytest.mark.parametrize("wave_bytes, bucket_pairs", [(64 << 20, 250_000), (20_000, 100)])
def test_whole_table(spark, libraries, wave_bytes, bucket_pairs):
    df = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in df.collect() if len(r.text or "") < 30_000]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    assert rows_of(align(df, wave_bytes=wave_bytes, bucket_pairs=bucket_pairs)) == brute(libraries, rows)


def test_one_word_everywhere(spark, libraries):
    rows = [(k, "the " * (k % 5)) for k in range(300)] + [(k, "") for k in range(300, 320)]
    assert rows_of(align(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), wave_bytes=100)) == brute(libraries, rows)


def test_groups_and_no_rows(spark, libraries):
    df = spark.createDataFrame([("x", "naïve cafés")], "name string, text string")
    row = align(df, id_col="name", with_groups=True).first()
    assert hashlib.sha256(row.groups.encode()).hexdigest() == row.groups_sha256 and row.groups.count(";") == row.n_groups - 1 and row.name == "x"
    assert align(df.limit(0), id_col="name").count() == 0


def test_sides_merge_runs_in_order():
    draw = np.random.default_rng(5)
    runs, want = [], Counter()
    for _ in range(9):
        pairs = np.unique(draw.integers(0, 6, 30).astype(np.uint64) << np.uint64(32) | draw.integers(0, 9, 30).astype(np.uint64))
        times = draw.integers(1, 5, len(pairs))
        runs.append((pairs, times))
        want.update(dict(zip(pairs.tolist(), times.tolist())))
    got = [(p, s) for pairs, sums, _, _ in sides(runs) for p, s in zip(pairs.tolist(), sums.tolist())]
    assert got == sorted(want.items())
