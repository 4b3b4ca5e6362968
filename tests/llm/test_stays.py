"""Which rows the near-dedup lets stay where ids are null or repeated."""

from quillon.llm.simhash_similar import one_of_each

TEXTS = ["alpha beta gamma delta epsilon zeta", "one two three four five six", "rot gelb grün blau weiß schwarz", "un deux trois quatre cinq six"]


def test_null_and_repeated_ids(spark):
    rows = [(None, t, "a") for t in TEXTS] + [(7, "some words that stand in no other text", "a"), (7, "and quite another text under this id", "a")]
    again = [(None, TEXTS[0], "a"), (9, TEXTS[1], "b"), (3, TEXTS[2], "b"), (3, TEXTS[2], "a"), (3, TEXTS[2], "a")]
    df = spark.createDataFrame(rows + again, "doc_id long, text string, source string")
    got = [tuple(r) for r in one_of_each(df, shingle=5).collect()]
    assert sorted(t for _, t, _ in got) == sorted({t for _, t, _ in rows})
    assert {t: i for i, t, _ in got if t in TEXTS} == {TEXTS[0]: None, TEXTS[1]: 9, TEXTS[2]: 3, TEXTS[3]: None}
    for n in (1, 3):  # however the rows are dealt
        assert sorted(map(repr, got)) == sorted(repr(tuple(r)) for r in one_of_each(df.orderBy("source", "text").repartition(n), shingle=5).collect())
