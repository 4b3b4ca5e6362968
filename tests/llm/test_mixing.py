import duckdb
from quillon.llm.mixing import mix, repeated
from quillon.llm.queries import ORACLE_SQL


def fill(sizes, weights, total, epochs):
    """Excess over the caps is reshared by weight until none is above."""
    full = set()
    while True:
        left = [s for s in sizes if s not in full]
        level = (total - sum(epochs * sizes[s] for s in full)) / sum(weights[s] for s in left) if left else 0
        above = {s for s in left if weights[s] * level > epochs * sizes[s]}
        if not above:
            return {s: epochs * sizes[s] if s in full else weights[s] * level for s in sizes}
        full |= above


def test_targets_and_takes(spark):
    rows = [(k, "w " * (k % 37), f"s{k % 5}") for k in range(400)] + [(900 + k, "a b\tc\x0bd", None) for k in range(30)] + [(1000, None, "s1"), (1001, "", "empty"), (1002, "x y", "tiny"), (1003, "long " * 30000, "one"), (7, "w w", "s2"), (7, "w w", "s2")]
    df = spark.createDataFrame([(i, t, s, "z") for i, t, s in rows], "doc_id long, text string, source string, size string")
    got = mix(df).collect()
    assert len(got) == len(rows) and sorted(map(tuple, mix(df.repartition(5)).collect())) == sorted(map(tuple, got))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted([s for s in sizes if s is not None]) + [None]
    target = fill(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2)
    source = {i: s for i, _, s in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-5 and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)


def test_infeasible_and_empty(spark):
    df = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, source string")
    assert [tuple(r) for r in mix(df, share=9.0).collect()] == [(1, 2, 2, 4.0, 4)]
    assert mix(df.limit(0)).count() == 0


def test_sql(spark):
    folder = "/root/testdata/sf0.01"
    got = sorted(map(tuple, mix(spark.read.parquet(f"{folder}/documents.parquet")).collect()))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    assert got == sorted(db.sql(ORACLE_SQL["op7_mixing"]).fetchall())


def test_repeated(spark):
    rows = [(k, "w " * (20 + k % 7), f"s{k % 3}", "z") for k in range(300)] + [(1000, None, "s0", "z"), (5, "w " * 25, "s2", "z"), (5, "w " * 25, "s2", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    out = repeated(df)
    assert out.columns == df.columns
    target = {}
    source = {i: s for i, _, s, _ in rows}
    for r in mix(df).collect():
        target[source[r.doc_id]] = r.target
    taken = dict.fromkeys(target, 0)
    for r in out.collect():
        taken[r.source] += len(r.text.split())
    assert all(abs(taken[s] - target[s]) <= 30 for s in target)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, repeated(df.repartition(3)).collect()))


def test_order_is_total(spark):
    """Equal and null ids with unlike texts, repeated rows, clashing names: the same words however the rows lie."""
    names = ("_id", "_size", "_words", "_copy", "draw", "bucket", "n", "part")
    rows = [(1, "w " * (3 + k % 9) + str(k), "a") for k in range(40)] + [(None, "x " * (1 + k % 5) + str(k % 12), "a") for k in range(60)] + [(2, "y " * 50, "b")] * 7 + [(None, None, None)] * 3
    df = spark.createDataFrame([(*r, *map(str, range(8))) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    for f in (mix, repeated):
        got = [sorted(map(repr, f(df.repartition(n)).collect())) for n in (1, 3, 7)]
        assert got[0] == got[1] == got[2]
    assert repeated(df).columns == df.columns and mix(df).count() == len(rows)
    taken, size = sum(r.taken for r in mix(df).collect()), sum(len((t or "").split()) for _, t, _ in rows)
    assert abs(taken - 1.5 * size) <= 2
    assert abs(sum(len(r.text.split()) for r in repeated(df).collect()) - 1.5 * size) <= 60


def test_a_hot_source_and_a_hot_row_are_dealt(spark):
    """No task of the sums holds more than its share of a source with all rows; equal rows are one."""
    import quillon.llm.mixing as module

    df = spark.range(40_000).selectExpr("id AS doc_id", "'a b c' AS text", "'s' AS source").unionAll(spark.range(20_000).selectExpr("CAST(NULL AS LONG)", "'a b c'", "'s'"))
    was, module.BUCKET_ROWS = module.BUCKET_ROWS, 1000
    try:
        got = mix(df)
        assert got.count() == 60_000 and abs(got.agg({"taken": "sum"}).first()[0] - 1.5 * 180_000) <= 1
    finally:
        module.BUCKET_ROWS = was
