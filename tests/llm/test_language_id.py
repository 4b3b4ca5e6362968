import math
import zlib

import numpy as np
from quillon.llm.language_id import counts, fit, known_language, language_id, train

DATA = "/root/testdata/sf0.01"


def test_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = [(10**6 + k, t, None, "z") for k, t in enumerate([None, "", "123 !?", "퟿1", "x", "wort " * 100_000])]
    df = docs.select("doc_id", "text", "lang", "source").union(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string")).withColumnRenamed("source", "score")
    got = {r.doc_id: r for r in language_id(df).collect()}
    assert len(got) == df.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in got.items())
    assert [got[10**6 + k].lang_pred for k in range(3)] == ["und"] * 3 and got[10**6 + 5].lang_pred in {"en", "fr", "de", "es"}
    real = [(r.lang, got[r.doc_id]) for r in docs.collect() if r.lang and counts(r.text)]
    held = [lang == p.lang_pred for lang, p in real if p.held_out]
    assert np.mean(held) > 0.95
    left = known_language(docs)
    assert left.columns == docs.columns and left.count() > 0.95 * docs.count()


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in language_id(df).collect()] == [("und", 0.0)]
    assert language_id(df.limit(0)).count() == known_language(df).count() == 0


def test_weights_are_sparse_and_calibrated():
    rng = np.random.default_rng(1)
    rows = []
    for k in range(400):
        y = k % 2
        at = np.sort(rng.choice(200, 20, replace=False))
        flip = rng.random() < 0.1  # a tenth of the labels are wrong
        rows.append(("ab"[y ^ flip], np.append(at, 300 + y), np.append(np.full(20, 0.1), 0.9)))
    model = fit(rows, l1=0.5)
    assert (model["weights"] == 0).mean() > 0.9
    p = 1 / (1 + np.exp(-abs(model["weights"][300, 1] - model["weights"][300, 0]) * 0.9 / model["temperature"]))
    assert 0.75 < p < 0.99


def test_every_label_takes_part_however_often_its_texts_are_copied(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(f"l{k:03}", f"{letters[k % 26]}{letters[k // 26]} " * 5) for k in range(210)]
    docs = spark.createDataFrame([r for r in rows for _ in range(100)], "lang string, text string")
    assert train(docs, per_lang=2)["langs"] == sorted(lang for lang, _ in rows)


# ---- the whole of it once more, in plain Python --------------------------------


def plain_features(text):
    """Hashed 1- to 3-grams of lower-cased letters, a blank for what lies between them."""
    code = [32]
    for a, b in zip(" " + text.lower(), text.lower()):
        if b.isalpha() or a.isalpha():
            code.append(ord(b) if b.isalpha() else 32)
    if not any(c.isalpha() for c in text.lower()):
        return None
    code.append(32)
    m, out = 0xFFFFFFFF, {}

    def add(h):
        h = (h ^ h >> 15) * 0x2C1B3C6D & m
        out[h >> 17] = out.get(h >> 17, 0) + 1

    for k, c in enumerate(code):
        h = c * 0x9E3779B1 & m
        add(h)
        if k + 1 < len(code):
            h ^= code[k + 1] * 0x85EBCA6B + 0x27220A95 & m
            add(h)
        if k + 2 < len(code):
            add(h * 0xC2B2AE35 & m ^ (code[k + 2] * 0x165667B1 + 0x9E3779B9 & m))
    return out


def plain_scores(w, x, langs):
    return [sum(v * w.get((f, k), 0.0) for f, v in x.items()) for k in range(len(langs))]


def plain_softmax(z):
    top = max(z)
    e = [math.exp(v - top) for v in z]
    return [v / sum(e) for v in e]


def plain_predictions(rows, order, alpha=1.0, beta=1.0, l1=1e-3, l2=1e-3):
    """rows: (id, text, lang); order: a number for each text, by which the sample is sorted."""
    learn = [(t, lang) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 5 and t is not None and lang is not None]
    df = {}
    for t, _ in learn:
        for f in plain_features(t) or ():
            df[f] = df.get(f, 0) + 1

    def vector(t):
        found = plain_features(t)
        x = {f: math.sqrt(n) * (math.log((1 + len(learn)) / (1 + df.get(f, 0))) + 1) for f, n in found.items()}
        size = math.sqrt(sum(v * v for v in x.values()))
        return {f: v / size for f, v in x.items()} | {-1: 1.0}

    sample = sorted({(order[t], lang, t) for t, lang in learn if plain_features(t)})
    langs = sorted({lang for _, lang, _ in sample})
    data = [(langs.index(lang), vector(t)) for _, lang, t in sample]
    train = [d for k, d in enumerate(data) if k % 5 or len(data) < 10]
    z, n, w = {}, {}, {}
    for epoch in range(4):
        for k in np.random.default_rng(epoch).permutation(len(train)):
            y, x = train[k]
            p = plain_softmax(plain_scores(w, x, langs))
            for f, v in x.items():
                for c in range(len(langs)):
                    g, at = v * (p[c] - (c == y)), (f, c)
                    was = n.get(at, 0.0)
                    n[at] = was + g * g
                    z[at] = z.get(at, 0.0) + g - (math.sqrt(n[at]) - math.sqrt(was)) / alpha * w.get(at, 0.0)
            for f in x:
                for c in range(len(langs)):
                    at = (f, c)
                    w[at] = 0.0 if abs(z[at]) <= l1 else -(z[at] - math.copysign(l1, z[at])) / ((beta + math.sqrt(n[at])) / alpha + l2)
    check = [(y, plain_scores(w, x, langs)) for y, x in data[::5]]
    loss = lambda t: -sum(math.log(max(plain_softmax([v / math.exp(t) for v in s])[y], 1e-300)) for y, s in check)
    best = min(np.linspace(-2.5, 2.5, 2001), key=loss)
    out = {}
    for i, t, _ in rows:
        if not t or not plain_features(t):
            out[i] = ("und", 0.0)
            continue
        p = plain_softmax([v / math.exp(best) for v in plain_scores(w, vector(t), langs)])
        out[i] = (langs[p.index(max(p))], max(p))
    return out


def test_predictions_by_brute_force(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) < 900").orderBy("doc_id").limit(90).select("doc_id", "text", "lang")
    docs = docs.union(spark.createDataFrame([(10**6, None, "en"), (10**6 + 1, "12 3", "en"), (10**6 + 2, "ÄÖÜ straße İx", None), (10**6 + 3, "", None)], docs.schema))
    rows = [tuple(r) for r in docs.collect()]
    order = {r.text: r.h for r in docs.select("text", F.xxhash64("text", F.lit("sample")).alias("h")).collect()}
    want = plain_predictions(rows, order)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id(docs).collect()}
    assert {i: x for i, (x, _) in got.items()} == {i: x for i, (x, _) in want.items()}
    assert max(abs(got[i][1] - want[i][1]) for i in got) < 0.01


def test_the_sample_is_bounded_for_each_label(spark):
    """Many texts of one label, copies of few of another: both learn, and no label has more than per_lang texts."""
    rows = [("a", f"alpha beta {k} gamma " * 3 + "abcdefghij"[k % 10] * (k // 10 + 1)) for k in range(900)] + [("b", f"uno dos tres {'xyz'[k % 3]} ") for k in range(900)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "lang string, text string, score int")
    sizes = []
    import quillon.llm.language_id as module

    was = module.written
    module.written = lambda df, label: was(df, label) if label != "sample-hashes" else (sizes.append({r.lang: r["count"] for r in df.groupBy("lang").count().collect()}), was(df, label))[1]
    try:
        assert train(docs, per_lang=50)["langs"] == ["a", "b"]
    finally:
        module.written = was
    assert sizes == [{"a": 50, "b": 3}]
