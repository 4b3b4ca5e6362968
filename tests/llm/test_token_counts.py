import random

from quillon.llm.token_counts import default_path, default_pattern, encoding, length_histogram, length_quantile, lengths, token_counts, truncated_total, with_suffix_sums


def brute(lengths):
    n, total = len(lengths), sum(lengths)
    return [(L, lengths.count(L), sum(x >= L for x in lengths), sum(x for x in lengths if x >= L), n, total, sum(min(x, L) for x in lengths), sum(x <= L for x in lengths) / n) for L in sorted(set(lengths))]


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    df = df.union(spark.createDataFrame([(1, None), (2, ""), (3, "x" * 20000), (3, "<|endoftext|>")], "doc_id long, text string"))
    encode = encoding(default_path(), default_pattern()).encode_ordinary
    lengths = [len(encode(r.text or "")) for r in df.collect()]
    got = token_counts(df.withColumnRenamed("doc_id", "length"))
    assert sorted(map(tuple, got.collect())) == brute(lengths)
    limits = spark.createDataFrame([(0,), (17,), (512,), (10**9,)], "limit_tokens long")
    assert {r[0]: r[1] for r in truncated_total(got, limits).collect()} == {L: sum(min(x, L) for x in lengths) for L in (0, 17, 512, 10**9)}
    assert length_quantile(got, 0.5).first()[0] == sorted(lengths)[(len(lengths) + 1) // 2 - 1]


def test_stretches():
    rng = random.Random(5)
    pool = [chr(c) for r in (range(1, 0x250), range(0x300, 0x600), range(0x2000, 0x2100), range(0x4E00, 0x4E40)) for c in r] + list(" \t\n'ss  ") * 60 + [chr(0x1C89)]
    count, encode = lengths(default_path(), default_pattern()), encoding(default_path(), default_pattern()).encode_ordinary
    for _ in range(1500):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(80)))
        assert count(text) == len(encode(text)), text


def test_far_lengths(spark):
    rows = [(0, 2), (5, 1), (1023, 1), (1024, 3), (5_000_000, 2), (3_000_000_000, 1)]
    got = {r.length: (r.docs_at_least, r.tokens_at_least) for r in with_suffix_sums(spark.createDataFrame(rows, "length long, n_docs long")).collect()}
    assert got == {L: (sum(n for x, n in rows if x >= L), sum(x * n for x, n in rows if x >= L)) for L, _ in rows}


def test_empty(spark):
    assert token_counts(spark.createDataFrame([], "text string")).count() == length_histogram(spark.createDataFrame([], "text string")).count() == 0


def test_the_corpus_is_encoded_once(spark, monkeypatch):
    """Of all plans, those written on the way and that of the result, one encodes, and once."""
    import quillon.llm.token_counts as module

    plans, write = [], module.written
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(module, "written", lambda df, label: plans.append(plan(df)) or write(df, label))
    plans.append(plan(token_counts(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))))
    assert sum(p.count("MapInArrow") for p in plans) == 1
