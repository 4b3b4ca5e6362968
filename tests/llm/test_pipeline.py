"""Each stage of the pipeline against a plain version of it, on what the stage before it kept."""

import hashlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql.functions import monotonically_increasing_id
from quillon.llm.bpe import default_path
from tokenizers import Tokenizer

FOLDER = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}


def exact(docs):
    best = {}
    for d in docs:
        key = (d.text or "").translate(LOWER)
        best[key] = max(best.get(key, d.doc_id), d.doc_id)
    return sorted(best.values())


def near(docs):
    """One of each group of documents that share 0.8 or more of their five-word shingles, by comparing all pairs."""
    sets = []
    for d in docs:
        w = (d.text or "").translate(LOWER).encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    head = {d.doc_id: d.doc_id for d in docs}

    def top(x):
        while head[x] != x:
            x = head[x]
        return x

    for k, d in enumerate(docs):
        for j in range(k):
            if 5 * len(sets[k] & sets[j]) >= 4 * len(sets[k] | sets[j]):
                p, q = top(d.doc_id), top(docs[j].doc_id)
                head[max(p, q)] = min(p, q)
    return sorted({top(d.doc_id) for d in docs})


def mixed(docs):
    """Copies of each document: whole turns for its source, and one more in seeded order up to the target."""
    size = {d.doc_id: len((d.text or "").split()) for d in docs}
    own = Counter()
    for d in docs:
        own[d.source] += size[d.doc_id]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(own))}
    full, total = set(), 1.5 * sum(own.values())
    while True:
        level = (total - sum(2 * own[s] for s in full)) / sum(weight[s] for s in own if s not in full)
        above = {s for s in own if s not in full and weight[s] * level > 2 * own[s]}
        if not above:
            break
        full |= above
    out = Counter()
    for s in own:
        target = round(2 * own[s] if s in full else weight[s] * level, 6)
        times = int(target // own[s])
        left = round(target - times * own[s])
        for d in sorted((d for d in docs if d.source == s), key=lambda d: (hashlib.md5(f"7:{d.doc_id}".encode()).hexdigest(), d.doc_id)):
            more = max(0, min(size[d.doc_id], left))
            left -= more
            if size[d.doc_id]:
                out[d.doc_id] = int((times * size[d.doc_id] + more) / size[d.doc_id] + 0.5)
    return sorted(out.elements())


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows of documents and of every stage, each written and read again."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    out.append((docs.columns, docs.collect()))
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        f(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((docs.columns, docs.collect()))
    return out


def test_stages(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_dedup", "mixing", "bpe"]
    (names, docs), (_, told), (_, single), (_, apart), (_, mix), (_, coded) = stages
    assert all(s[0] == names for s in stages[:-1])
    ids = lambda rows: sorted(r.doc_id for r in rows)
    letters = {d.doc_id for d in docs if any(c.isalpha() for c in d.text or "")}
    assert set(ids(told)) <= letters and len(told) >= 0.97 * len(letters)
    assert ids(single) == exact(told)
    assert ids(apart) == near(single)
    assert ids(mix) == mixed(apart)
    library = Tokenizer.from_file(default_path())
    text = {d.doc_id: d.text for d in docs}
    want = []
    for i in ids(mix):
        tokens = library.encode(text[i], add_special_tokens=False).ids
        want.append((i, len(tokens), hashlib.sha256(np.array(tokens, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(tokens, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in coded) == sorted(want)


def test_run_is_the_stages_in_turn(spark, stages):
    got = corpus_pipeline.run(spark, FOLDER)
    assert sorted(r.ids_sha256 for r in got.collect()) == sorted(r.ids_sha256 for r in stages[-1][1])


def test_names_that_clash(spark):
    """Columns called like those that the stages make themselves come through, and no row is lost to an id it shares."""
    names = ("_id", "_sha", "_digest", "_words", "_size", "_copy", "_copies", "_times", "_key", "key", "id", "draw", "d", "t", "h", "score", "lang_pred")
    spoken = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").filter("lang = 'en'").orderBy("doc_id").limit(40).collect()}
    texts = sorted(set(spoken.values()), key=len)[10:22]
    rows = [(None if k < 4 else 7, t, "en", "s", 1, *map(str, range(len(names)))) for k, t in enumerate(texts)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    want = docs.columns
    for name, f in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, f(spark, docs, FOLDER)
        assert docs.columns == want
        kept = {r.text for r in docs.collect()}
        if name != "mixing":
            assert kept <= {r.text for r in before.collect()}
        if name == "exact_dedup":
            assert len(kept) == docs.count() == len({(t or "").translate(LOWER) for t in kept})
            single = docs.count()
        if name == "simhash_dedup":
            assert docs.count() == len(near([r for r in (before.withColumn("doc_id", monotonically_increasing_id()).collect())])) <= single
    corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count()


def test_odd_rows(spark):
    rows = [(1, None, "en", None, 0), (2, "", None, "s", 0), (3, "Word and word again", "en", "s", 3), (3, "Word and word again", "en", "s", 3), (4, "123", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    empty = docs.limit(0)
    for _, f in corpus_pipeline.STAGES:
        docs, empty = f(spark, docs, FOLDER), f(spark, empty, FOLDER)
    assert {r.doc_id for r in docs.collect()} <= {3} and empty.count() == 0
