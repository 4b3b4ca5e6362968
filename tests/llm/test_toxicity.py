"""Features against a plain list, the fit against one place by place, and held-out accuracy."""

import math
import random
import zlib

import numpy as np
import pytest
from quillon.llm import toxicity as T

FOLDER = "/root/testdata/sf0.1"


def fold(i, n=5):
    return zlib.crc32(str(i).encode()) % n


def test_features_are_those_of_words_and_their_neighbours():
    same = [("You idiot, go", "you IDIOT go"), ("a-b c", "a b\nc"), ("é 1 è", "é è")]
    for a, b in same:
        assert np.array_equal(T.features(a), T.features(b))
    assert len(T.features("one two six ten")) == 4 + 3 + 2 + 1  # words, neighbours, one and two between
    assert len(T.features("abcdefg")) == 1 + len(T.STARTS) and len(T.features("one one one")) == 1 + 1 + 1
    for text in (None, "", "12 34 ,."):
        assert len(T.features(text)) == 0
    assert not set(T.features("alpha beta").tolist()) & set(T.features("beta alpha").tolist()) - set(T.features("alpha").tolist()) - set(T.features("beta").tolist())


def plain_fit(rows, weights, epochs, alpha, beta, l1, l2):
    z, n = {}, {}

    def weight(f):
        zz, pen = z.get(f, 0.0), 0.0 if f == "bias" else l1
        return 0.0 if abs(zz) <= pen else (math.copysign(pen, zz) - zz) / ((beta + math.sqrt(n.get(f, 0.0))) / alpha + l2)

    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            y, at = rows[k]
            w = {f: weight(f) for f in [*at, "bias"]}
            g = (1 / (1 + math.exp(-sum(w.values()))) - y) * weights[y]
            for f in w:
                was = n.get(f, 0.0)
                n[f] = was + g * g
                z[f] = z.get(f, 0.0) + g - (math.sqrt(n[f]) - math.sqrt(was)) / alpha * w[f]
    return {f: weight(f) for f in z if weight(f)}


def test_fit_equals_one_place_by_place():
    draw = random.Random(3)
    rows = [(k % 2, sorted(draw.sample(range(40), 6) + [100 + k % 2])) for k in range(80)]
    options = dict(epochs=3, alpha=0.7, beta=1.0, l1=0.5, l2=0.1)
    got = T.fit([(y, np.array(at, dtype=np.uint32)) for y, at in rows], (0.5, 2.0), **options)
    want = plain_fit(rows, (0.5, 2.0), **options)
    assert got["bias"] == pytest.approx(want.pop("bias"), rel=1e-9)
    assert dict(zip(got["places"].tolist(), got["weights"].tolist())) == pytest.approx(want, rel=1e-9)


def test_held_out_accuracy_and_small_model(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in T.toxicity(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (fold(i) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [(got[r.doc_id], r.toxic) for r in labels.collect() if r.toxic is not None and fold(r.doc_id) == 0]
    right = np.mean([r.predicted == y for r, y in held])
    better = np.mean([a.score > b.score for a, y in held if y for b, z in held if not z])
    assert right > 0.97 and better > 0.9 and 0.5 > np.mean([y for _, y in held])
    model = T.train(docs, labels)
    assert len(model["places"]) < 20_000
    for r in docs.limit(200).collect():  # predictions are those of the model on the whole text
        at = set(T.features(r.text).tolist())
        z = model["bias"] + sum(w for p, w in zip(model["places"].tolist(), model["weights"].tolist()) if p in at)
        assert T.score(model, r.text) == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-12)


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(k, "you idiot" if k % 3 == 0 else "good day", "x", 1.0) for k in range(300)] + [(300, None, "y", 2.0), (301, "", None, None), (302, "1 2 3", "", 0.0), (303, "idiot " * 300_000, "", 0.0), (None, "you idiot", "", 0.0), (0, "you idiot", "", 0.0)],
        "doc_id long, text string, held_out string, score double")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(300)] + [(1, 0), (7, None), (None, 1), (5, 7), (999, 1)], "doc_id long, toxic int")
    got = T.toxicity(docs, labels).collect()
    assert len(got) == 306 and sum(r.doc_id == 0 for r in got) == 2
    by = {r.doc_id: r for r in got}
    assert by[303].predicted == 1 and by[None].predicted == 1 and not by[None].held_out and by[1].predicted == 0
    assert by[300].score == by[301].score == by[302].score < 0.5
    again = {r.doc_id: r for r in T.toxicity(docs.repartition(7), labels.repartition(3)).collect()}
    assert again == by


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r.score, r.predicted) for r in T.toxicity(docs, none).collect()] == [(0.5, 1)] * 2
    assert T.toxicity(docs.limit(0), none).count() == 0


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(k, f"word{k % 7} " + ("idiot" if k % 2 else "fine")) for k in range(400)] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(400)], "doc_id long, toxic int")
    model = T.train(docs, labels, per_label=20)
    assert T.score(model, "idiot") > 0.5 > T.score(model, "fine")
