"""Language identification: sparse multinomial logistic regression on TF-IDF of character
n-grams, trained by follow-the-regularised-leader with elastic-net penalties, then calibrated
by a temperature.

Document frequencies count all training documents. The classifier is fitted on a bounded sample
of them, at most `per_lang` different texts for each language that occurs, whole texts, drawn by a
hash of the text. Language, source and id never enter a prediction.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_batches, written

#: log2 of the number of features; n-grams are hashed to them.
BITS = 15
PER_LANG = 1000
#: Step size, its smoothing, L1 and L2 penalties, passes over the sample.
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 1e-3, 1e-3, 4
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(features, counts) of the 1- to 3-grams of a text's lower-cased letters, with one blank for
    anything else between them; None if there is no letter."""
    if not text:
        return None
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    real = letters()[code]
    if not real.any():
        return None
    keep = real.copy()
    keep[1:] |= real[:-1]  # one blank after each word
    code = np.concatenate(([32], np.where(real, code, 32)[keep], [32])).astype(np.uint32)
    one = code * np.uint32(0x9E3779B1)
    two = one[:-1] ^ (code[1:] * np.uint32(0x85EBCA6B) + np.uint32(0x27220A95))
    three = (two[:-1] * np.uint32(0xC2B2AE35)) ^ (code[2:] * np.uint32(0x165667B1) + np.uint32(0x9E3779B9))
    h = np.concatenate((one, two, three))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    full = np.bincount(h >> np.uint32(32 - BITS), minlength=1 << BITS)
    at = np.flatnonzero(full)
    return at, full[at]


def tf_idf(found: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = found
    x = np.sqrt(n) * idf[at]
    return at, x / np.sqrt(x @ x)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros((1 << BITS) + 1, dtype=np.int64)  # the last counts documents
    for batch in batches:
        for text in batch.column(0):
            found = counts(text.as_py())
            seen[-1] += 1
            if found:
                seen[found[0]] += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["feature", "df"])


def _vectors(idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, h, text in zip(batch.column("lang").to_pylist(), batch.column("h").to_pylist(), batch.column("text")):
                found = counts(text.as_py())
                if found:
                    at, x = tf_idf(found, idf)
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([h]), pa.array([at.astype(np.int32).tobytes()]), pa.array([x.tobytes()])], names=["lang", "h", "at", "x"])

    return run


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], *, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> dict:
    """rows: (language, features, values) in a fixed order. One in five calibrates and does not train."""
    langs = sorted({r[0] for r in rows})
    place = {x: k for k, x in enumerate(langs)}
    size = (1 << BITS) + 1  # the last feature is the bias
    z, n = np.zeros((size, len(langs))), np.zeros((size, len(langs)))

    def weights(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    data = [(place[lang], np.append(at, size - 1), np.append(x, 1.0)) for lang, at, x in rows]
    train = [d for k, d in enumerate(data) if k % 5 or len(data) < 10]
    check = data[::5]
    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(train)):
            y, at, x = train[k]
            w = weights(at)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            was = n[at]
            now = was + g * g
            z[at] += g - (np.sqrt(now) - np.sqrt(was)) / alpha * w
            n[at] = now
    w = weights(np.arange(size))
    scores = [(y, x @ w[at]) for y, at, x in check]

    def loss(log_t: float) -> float:
        return -sum(np.log(max(softmax(s / np.exp(log_t))[y], 1e-300)) for y, s in scores)

    low, high = -2.5, 2.5
    for _ in range(40):
        a, b = low + (high - low) * 0.382, low + (high - low) * 0.618
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return {"langs": langs, "weights": w, "temperature": float(np.exp((low + high) / 2))}


def _fit_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        rows += zip(batch.column("lang").to_pylist(), batch.column("h").to_pylist(), batch.column("at").to_pylist(), batch.column("x").to_pylist())
    rows.sort()
    if rows:
        # in turns, so that every fifth row has every language
        rows.sort(key=lambda r: r[1])
        model = fit([(lang, np.frombuffer(at, np.int32), np.frombuffer(x)) for lang, _, at, x in rows])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> dict | None:
    """A model from the rows whose language is known; None if there is no row to learn from."""
    bounded_batches(docs.sparkSession)
    base = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    frequencies = {r.feature: r.df for r in base.select("text").mapInArrow(_frequencies, "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df")).collect()}
    total = frequencies.pop(1 << BITS, 0)  # at most 2**BITS + 1 rows
    df = np.zeros(1 << BITS)
    df[list(frequencies)] = list(frequencies.values())
    idf = np.log((1 + total) / (1 + df)) + 1
    keyed = base.withColumn("h", F.xxhash64("text", F.lit("sample")))
    # copies count once, so that the smallest hashes of a language are as many as there are texts, up to per_lang
    texts = written(keyed.select("lang", "h").distinct(), "text-hashes")
    # written, so that Spark sees how small it is and thins the texts out before it brings those of a language together
    counted = written(texts.groupBy("lang").agg(F.count("*").alias("n")), "text-counts")
    # about four times as many as wanted, by their hash alone, before the window; a language of few texts sends all
    share = (F.col("h") / F.lit(2.0**64)) + 0.5
    likely = texts.join(counted, "lang").filter(share * F.col("n") < 4 * per_lang).select("lang", "h")
    order = Window.partitionBy("lang").orderBy("h")
    chosen = likely.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= per_lang).select("lang", "h")
    chosen = written(chosen, "sample-hashes")  # per_lang rows a label at most
    sample = keyed.join(chosen, ["lang", "h"], "left_semi").select("lang", "h", "text")
    sample = sample.mapInArrow(_vectors(idf), "lang string, h long, at binary, x binary").dropDuplicates(["lang", "h"])
    fitted = sample.coalesce(1).mapInArrow(_fit_group, "model binary").collect()
    return pickle.loads(fitted[0].model) | {"idf": idf} if fitted else None


def told(model: dict | None, text: str | None) -> tuple[str, float]:
    """(language, calibrated probability) of one text."""
    found = counts(text) if model else None
    if not found:
        return UNKNOWN, 0.0
    at, x = tf_idf(found, model["idf"])
    w = model["weights"]
    p = softmax((x @ w[at] + w[-1]) / model["temperature"])
    best = int(p.argmax())
    return model["langs"][best], float(p[best])


def _predict(handle):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = handle.value
        for batch in batches:
            got = [told(model, text.as_py()) for text in batch.column("_text")]
            rest = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in rest] + [pa.array([x for x, _ in got], pa.string()), pa.array([p for _, p in got], pa.float64())], names=rest + ["lang_pred", "score"])

    return run


def _keep(handle, text_col: str, min_score: float, rows: int = 512):
    """Whole rows, those that are kept; a few at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = handle.value
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                got = [told(model, text.as_py()) for text in part.column(text_col)]
                yield part.filter(pa.array([x != UNKNOWN and p >= min_score for x, p in got], pa.bool_()))

    return run


def predict(docs: DataFrame, model: dict | None, keep: list[Column], *, text_col: str = "text") -> DataFrame:
    """The columns `keep` and lang_pred, score for every row."""
    chosen = docs.select(*keep, F.col(text_col).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "_text")
    handle = docs.sparkSession.sparkContext.broadcast(model)  # (2**BITS + 1) * languages numbers
    return chosen.mapInArrow(_predict(handle), schema + ", lang_pred string, score double")


def crc_fold(id_col: str, folds: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def language_id(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, per_lang: int = PER_LANG) -> DataFrame:
    """Predicts the language of every text, learning from those whose fold is not 0.

    Returns one row per row of `docs`: the id, held_out (crc32 of the id as text, modulo `folds`,
    is 0; a null id counts as not held out), lang_pred (a learned language, or `und` with score 0
    if the text is null, empty or has no letter, or nothing could be learned) and score, the
    calibrated probability. Of equally likely languages the first by name wins. Texts are read
    whole. Repeated rows get equal results; equal texts enter the sample once per language. Other
    columns are not read. An empty table gives none.
    """
    held = F.coalesce(crc_fold(id_col, folds) == 0, F.lit(False))
    model = train(docs.filter(~held), text_col=text_col, lang_col=lang_col, per_lang=per_lang)
    return predict(docs, model, [F.col(id_col), held.alias("held_out")], text_col=text_col)


def known_language(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_score: float = 0.5) -> DataFrame:
    """The rows whose language is told with at least `min_score`, with all their columns.

    Rows with a null or empty text, or without a letter, have no language and go; so do all rows if no
    label and text is there to learn from. Null labels are not learned from, null ids are rows like
    others, repeated rows stay or go alike, texts are read whole, and columns may have any names. An
    empty table gives none. The model is learned from all labelled rows: what is asked here is whether
    a language can be told, not how well."""
    model = train(docs, text_col=text_col, lang_col=lang_col)
    handle = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_keep(handle, text_col, min_score), docs.schema)
