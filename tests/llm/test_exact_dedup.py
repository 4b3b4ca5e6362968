import hashlib
from collections import defaultdict

from quillon.llm.exact_dedup import exact_dedup, one_of_each

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for i, t in rows:
        x = (t or "").translate(LOWER)
        ids = [y for y in groups[x] if y is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[x]), i == keep, hashlib.sha256(x.encode()).hexdigest()))
    return out


def test_cases(spark):
    rows = [(1, "A b"), (2, "a B"), (3, None), (4, ""), (5, "Äb"), (6, "äb"), (7, "Äb"), (8, "İI"), (8, "İI"), (None, "n"), (9, "N"), (None, "q"), (10, "x" * 100_000)]
    rows += [(1000 + k, "Hot") for k in range(500)]
    df = spark.createDataFrame([(i, t, "k", "z") for i, t in rows], "doc_id long, text string, digest string, kept string")
    got = sorted(map(tuple, exact_dedup(df).collect()), key=str)
    assert got == sorted(brute(rows), key=str)
    left = one_of_each(df)
    assert left.columns == df.columns
    assert sorted(left.select("doc_id").collect(), key=str) == sorted([(2,), (4,), (6,), (7,), (8,), (9,), (None,), (10,), (1499,)], key=str)


def test_no_rows(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_native(spark):
    df = exact_dedup(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_ids_and_names_that_clash(spark):
    """Equal ids of unlike texts all stay, a repeated row stays once, ties go to the smallest whole row however rows lie."""
    names = ("_id", "_sha", "_digest", "_key", "key", "id", "c0")
    rows = [(7, "one text"), (7, "another text"), (None, "third"), (None, "fourth"), (5, "Tie"), (5, "tie"), (8, "again"), (8, "again"), (None, None), (3, "")]
    df = spark.createDataFrame([(*r, *map(str, range(7))) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = [sorted(map(repr, one_of_each(df.repartition(n)).collect())) for n in (1, 4)]
    left = one_of_each(df)
    assert got[0] == got[1] and left.columns == df.columns
    assert sorted(((r.doc_id, (r.text or "").lower()) for r in left.collect()), key=str) == sorted([(7, "one text"), (7, "another text"), (None, "third"), (None, "fourth"), (5, "tie"), (8, "again"), (3, "")], key=str)
    assert one_of_each(df.limit(0)).count() == 0
