"""Toxicity: logistic regression on hashed word n-grams and skip-grams, fitted by FTRL-proximal.

A text's features are its words, pairs of neighbours, pairs with one or two words between them and,
since words are inflected, the starts of longer words: each once, hashed to 2**BITS places. FTRL keeps
a learning rate for each place; the L1 penalty leaves zero all places that labels do not need, so what
is sent to the tasks is a short list of places and weights, never more than 2**BITS.

The model is fitted on a bounded sample, at most `per_label` labelled documents of each label, and
weighted as the labels are in all. Label, language, source and id never enter a score.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language_id import crc_fold, letters
from .shared import bounded_batches, written
from .words import mix, spans

#: log2 of the number of places.
BITS = 20
#: Labelled documents of each label in the sample.
PER_LABEL = 4000
#: Step size, its smoothing, L1 and L2 penalties, passes over the sample.
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 3.0, 0.1, 4
#: Letters of the starts of words that are features beside the whole words.
STARTS = (4, 5, 6)
_BASE = 0x9E3779B97F4A7C15
_KIND = [np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)]


def features(text: str | None) -> np.ndarray:
    """Places of a text's features, in order, each once. Words are runs of letters, lower-cased."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    real = np.zeros(len(code) + 2, dtype=np.int8)
    real[1:-1] = letters()[code]
    turn = np.diff(real)
    start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    if not len(start):
        return np.zeros(0, dtype=np.uint32)
    letter = mix(code.astype(np.uint64))
    word = spans(letter, _BASE, start, end)
    found = [word]
    for gap in (1, 2, 3):  # neighbours, and with one and two words between them
        found.append(mix(word[:-gap] * _KIND[gap] + word[gap:]))
    for k in STARTS:
        long = start[end - start > k]
        found.append(mix(spans(letter, _BASE, long, long + k) ^ _KIND[0]))
    return np.unique((np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.uint32))


def fit(rows: list[tuple[int, np.ndarray]], weights: tuple[float, float] = (1.0, 1.0), *, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> dict:
    """rows: (label, places) in a fixed order; `weights` of a row with label 0 and 1. Places whose weight is
    zero are left out of the model; the bias is not penalised by L1."""
    size = (1 << BITS) + 1  # the last place is the bias
    z, n = np.zeros(size), np.zeros(size)
    penalty = np.full(size, l1)
    penalty[-1] = 0.0

    def at_places(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) <= penalty[at], 0.0, (np.sign(zz) * penalty[at] - zz) / ((beta + np.sqrt(n[at])) / alpha + l2))

    data = [(y, np.append(at.astype(np.int64), size - 1)) for y, at in rows]
    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(data)):
            y, at = data[k]
            w = at_places(at)
            g = (sigmoid(w.sum()) - y) * weights[y]
            was = n[at]
            now = was + g * g
            z[at] += g - (np.sqrt(now) - np.sqrt(was)) / alpha * w
            n[at] = now
    w = at_places(np.arange(size))
    used = np.flatnonzero(w[:-1])
    return {"places": used.astype(np.uint32), "weights": w[used], "bias": float(w[-1])}


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -60, 60))))


def score(model: dict | None, text: str | None) -> float:
    """Probability of label 1. Without a model, 0.5: nothing is known."""
    if model is None:
        return 0.5
    at = features(text)
    places = model["places"]
    if not len(places) or not len(at):
        return sigmoid(model["bias"])
    where = np.minimum(np.searchsorted(places, at), len(places) - 1)
    return sigmoid(model["bias"] + float(model["weights"][where][places[where] == at].sum()))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, text in enumerate(batch.column("text")):
            one = batch.slice(k, 1)
            yield pa.RecordBatch.from_arrays([one.column("label"), one.column("h"), one.column("rank"), pa.array([features(text.as_py()).tobytes()], pa.binary())], names=["label", "h", "rank", "at"])


def _fit_all(weights: tuple[float, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            rows += zip(batch.column("h").to_pylist(), batch.column("label").to_pylist(), batch.column("at").to_pylist())
        rows.sort()
        if rows:
            model = fit([(y, np.frombuffer(at, np.uint32)) for _, y, at in rows], weights)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    return run


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = PER_LABEL) -> dict | None:
    """A model of the labels 0 and 1 of those documents; None if no labelled document is there.

    Labels that are neither, or whose id is null, are not used. A document with both labels is an
    example of both. Of rows with one id a single text is learned from, so the sample stays bounded.
    """
    bounded_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)").distinct()
    known = written(known.withColumn("h", F.xxhash64("id", F.lit("sample"))), "labels")
    n = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows at most
    if not n:
        return None
    share = F.col("h") / F.lit(2.0**64) + 0.5
    # about twice as many as wanted by their hash alone, then exactly those with the smallest hashes
    chosen = [known.filter((F.col("label") == y) & (share * n[y] < 2 * per_label)).orderBy("h", "id").limit(per_label) for y in sorted(n)]
    chosen = written(chosen[0].unionByName(chosen[1]) if len(chosen) == 2 else chosen[0], "sample")
    weights = [n.get(y, 0) / min(max(n.get(y, 0), 1), per_label) for y in (0, 1)]
    mean = sum(n.values()) / sum(min(x, per_label) for x in n.values())
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = base.join(F.broadcast(chosen), "id").select("label", "h", F.xxhash64("text").alias("rank"), "text")  # chosen: 2 * per_label rows at most
    sample = sample.mapInArrow(_vectors, "label int, h long, rank long, at binary").groupBy("label", "h").agg(F.min_by("at", "rank").alias("at"))
    fitted = sample.coalesce(1).mapInArrow(_fit_all((weights[0] / mean, weights[1] / mean)), "model binary").collect()
    return pickle.loads(fitted[0].model) if fitted else None


def _score(handle):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = handle.value
        for batch in batches:
            got = [score(model, text.as_py()) for text in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_held"), pa.array(got, pa.float64()), pa.array([int(x >= 0.5) for x in got], pa.int32())], names=["_id", "_held", "score", "predicted"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, per_label: int = PER_LABEL) -> DataFrame:
    """Scores every text, learning from the labels of documents whose crc32 of the id as text, modulo `folds`, is not 0.

    Returns one row per row of `docs`: the id, held_out (that remainder is 0; a null id counts as not
    held out, and has no label), score (probability of label 1) and predicted (1 if the score is 0.5 or
    more). Null and empty texts and those without a letter have no feature and get the share that the
    bias stands for; if there is nothing to learn from, all scores are 0.5. Texts are read whole;
    repeated rows get equal scores; other columns are not read, whatever their names. An empty table
    gives none.
    """
    held = F.coalesce(crc_fold(id_col, folds) == 0, F.lit(False))
    model = train(docs.filter(~held), labels.filter(~held), id_col=id_col, text_col=text_col, label_col=label_col, per_label=per_label)
    handle = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS places and weights at most
    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).alias("_id"), held.alias("_held"), F.col(text_col).alias("_text"))
    return chosen.mapInArrow(_score(handle), f"_id {kind}, _held boolean, score double, predicted int").select(F.col("_id").alias(id_col), F.col("_held").alias("held_out"), "score", "predicted")
