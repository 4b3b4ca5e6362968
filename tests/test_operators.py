"""Hand-worked cases, errors and properties that the queries do not show."""

import math
import pytest
from pyspark.sql import functions as F
from quillon.functions import answers as an
from quillon.functions import scoring as sc
from quillon.operators import advantages as adv
from quillon.operators import evaluation as ev
from quillon.operators import joins as jo
from quillon.operators import quality as qu
from quillon.operators import sampling as sa
from quillon.operators import sequences as se
from quillon.sources import files as fi
from quillon.streaming import operators as st


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_interval_cases(spark):
    iou = lambda a, b, **o: value(spark, an.interval_iou(*[F.lit(float(x)) for x in (*a, *b)], **o))
    assert iou((80, 94), (82, 95)) > 0.7 and iou((0, 1), (2, 3)) == 0 and iou((5, 5), (5, 5), zero=1.0) == 1
    assert iou((10, 10), (9, 11), min_length=2.0) == 1.0
    got = lambda t, m="last": value(spark, an.interval(F.lit(t), m))
    assert tuple(got("The interval is [80, 94].")) == (80, 94) and got("94 to 80") is None and got("one 7") is None
    assert tuple(got("1 2 3 4", "first")) == (1, 2) and tuple(got("<think>[1, 2]</think> [3, 4.5]", "bracket")) == (3, 4.5)
    with pytest.raises(ValueError):
        an.interval(F.lit(""), "middle")


def test_sequences_and_choices(spark):
    assert value(spark, an.sequence_key(F.lit("Order: 3 -> 5 -> 4 -> 2 -> 1"))) == "3->5->4->2->1"
    options = F.array(F.lit("open the drawer"), F.lit("close the drawer"))
    assert [value(spark, an.choice_key(F.lit(t), options)) for t in ("Option B", "close  the drawer", "B", "Straße")] == ["B", "B", "B", "strasse"]
    points = F.array(*map(F.lit, ("the red door", "opens slowly", "nothing alike xyz")))
    assert value(spark, an.point_coverage(F.lit("A red door opens"), points)) >= 2 / 3 - 1e-9


def test_boxed_and_calls(spark):
    assert value(spark, sc.last_boxed(F.lit("\\boxed{1} \\boxed{a{b}c} x"))) == "a{b}c" and value(spark, sc.last_boxed(F.lit("none"))) is None
    assert value(spark, sc.boxed_score(F.lit("\\boxed{\\dfrac12}"), F.lit("1/2"))) == 1.0
    text = 'so {"action": "look", "thought": "t", "x": 1} and {"a": "}"} {"action": "answer", "params": {"final_answer": "b"}}'
    assert value(spark, sc.tool_answer_score(F.lit(text), F.lit(" B "))) == 1.0
    parsed = value(spark, sc.tool_calls(F.lit(text), F.lit("object")))
    assert [(c.name, c.arguments) for c in parsed.calls] == [("look", '{"x": 1}'), ("answer", '{"final_answer": "b"}')] and '{"a": "}"}' in parsed.rest
    channel = "<|channel|>analysis<|message|>hm<|end|><|channel|>commentary to=functions.f <|constrain|>json<|message|>{\"a\": 1}<|call|>"
    assert [c.name for c in value(spark, sc.tool_calls(F.lit(channel), F.lit("channel"))).calls] == ["f"]


def test_registries_and_errors(spark):
    with pytest.raises(ValueError):
        adv.advantage("none")
    with pytest.raises(ValueError):
        adv.register_advantage("grpo")(lambda df: df)
    with pytest.raises(ValueError):
        sc.manager("none")
    with pytest.raises(ValueError):
        sc.dispatch(F.lit("a"), F.lit(""), F.lit(""), {"a": "none"})
    with pytest.raises(Exception, match="no scorer"):
        value(spark, sc.dispatch(F.lit("b"), F.lit(""), F.lit(""), {"a": "qa"}))
    one = spark.createDataFrame([(1, 2.0, 3)], "g int, s double, k int")
    with pytest.raises(Exception, match="single row"):
        adv.pass_at_k(one, group="g", score="s", tie=["k"]).collect()
    with pytest.raises(Exception, match="fewer than two"):
        adv.masked_stats(one.withColumn("m", F.lit(True)), value="s", mask="m").collect()
    with pytest.raises(Exception, match="aborted"):
        t = one.withColumn("m", F.lit(False))
        ev.step_metrics(t, seq="g", mask="m", score="s", reward="s", advantage="s", returns="s", value="s", limit=3).collect()
    other = spark.createDataFrame([(1, 9.0)], "g int, s double")
    with pytest.raises(Exception, match="differ"):
        jo.union_columns(one, other, key="g").collect()
    with pytest.raises(ValueError):
        sa.token_budget_shards(spark.createDataFrame([(1, 99)], "k long, n long"), key="k", length="n", budget=10)


def test_advantages_sum_to_zero(spark):
    df = spark.range(200).select((F.col("id") % 17).alias("g"), F.rand(3).alias("s"))
    for name in ("grpo", "rloo"):
        sums = adv.advantage(name)(df, group="g", score="s").groupBy("g").agg(F.abs(F.sum("advantage")).alias("x"))
        assert sums.agg(F.max("x")).first()[0] < 1e-9


def test_empty_summary(spark):
    none = spark.createDataFrame([], "score double, ok boolean, error string, f long")
    r = ev.evaluation_summary(none, score="score", correct="ok", error="error", usage={"frames": "f"}).first()
    assert r.attempted == r.correct == 0 and r.accuracy == r.average_score == r.frames == 0.0


def test_islands_and_apportionment(spark):
    rows = spark.createDataFrame([(1, x) for x in (0, 1, 3)] + [(2, 1), (2, 2), (2, 2)], "k long, n long")
    assert sorted(map(tuple, se.islands(rows, keys=["k"], number="n").collect())) == [(1, 0, 1), (1, 3, 3), (2, 1, 2)]
    df = spark.range(1, 30).select((F.col("id") % 4).alias("g"), "id")
    out = se.apportion(df, keys=["g"], share="id", total=F.lit(13.0), order=["id"])
    assert {r[0] for r in out.groupBy("g").agg(F.sum("allotted")).select("sum(allotted)").collect()} == {13}


def test_nearest_prefers_the_earlier(spark):
    left = spark.createDataFrame([(1, 5), (1, 0), (2, 3)], "k long, t long")
    right = spark.createDataFrame([(1, 3, "a"), (1, 7, "b")], "k long, u long, v string")
    got = {(r.k, r.t): r.nearest for r in jo.nearest(left, right, by=["k"], left_at="t", right_at="u", value="v").collect()}
    assert got == {(1, 5): "a", (1, 0): "a", (2, 3): None}


def test_order_gates(spark):
    rows = spark.createDataFrame([(1, x, o, n) for x, o, n in (("a", 1, 2), ("b", 2, 1), ("c", 3, 3))], "s long, i string, o long, n long")
    flips = jo.flipped_pairs(rows, sample="s", item="i", old="o", new="n")
    assert [tuple(r) for r in flips.collect()] == [(1, "b", "a")]
    assert jo.uncovered(flips, spark.createDataFrame([(1, "a", "b")], "s long, first string, second string"), sample="s").count() == 0
    order, added = qu.fill_order(F.array(*map(F.lit, ("c", "x", "c"))), F.array(*map(F.lit, ("a", "b", "c"))))
    assert value(spark, order) == ["c", "a", "b"] and value(spark, added) == ["a", "b"]


def test_strip_corrections_by_brute_force(spark):
    from itertools import product

    def slow(roles):
        out = []
        for k, r in enumerate(roles):
            if r == "marker":
                while out and roles[out[-1]] == "assistant":
                    out.pop()
            else:
                out.append(k)
        return out

    cases = list(product(("assistant", "user", "marker"), repeat=5))
    rows = [(c, k, "user" if r == "marker" else r, "[DIAGNOSIS]" if r == "marker" else "x") for c, roles in enumerate(cases) for k, r in enumerate(roles)]
    got = qu.strip_corrections(spark.createDataFrame(rows, "c long, t long, role string, text string"), conv="c", turn="t", role="role", text="text").collect()
    kept = {c: [] for c in range(len(cases))}
    for r in sorted(got):
        kept[r.c].append(r.t)
    assert kept == {c: slow(roles) for c, roles in enumerate(cases)}


def test_sources(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"doc_id": 1}')
    with pytest.raises(Exception, match="not a list"):
        fi.read_json_array(spark, f"file://{tmp_path}/bad.json", fi.MESSAGE).collect()
    with pytest.raises(ValueError):
        fi.read_files(spark, ["x.csv"])
    with pytest.raises(ValueError):
        fi.map_fields(spark.range(1), {"nonsense": "id"}, file=F.lit(""), index=F.lit(0))
    assert "answer" not in qu.inference_payload(spark.createDataFrame([("a", "b")], "question string, answer string")).columns


def test_splits_and_pads(spark):
    rows = sa.split_by_task(spark.range(50).withColumn("t", F.col("id") % 3), task="t", key="id")
    assert {tuple(r) for r in rows.filter("split = 'train'").groupBy("t").count().collect()} == {(0, 11), (1, 11), (2, 11)}
    padded = sa.pad_to_divisor(spark.range(3), index="id", divisor=8)
    assert padded.count() == 8 and sorted(r.id for r in padded.filter("not is_pad").collect()) == [0, 1, 2]
    assert value(spark, se.chunk_count(F.lit(130), 64, 16)) == 3
    assert st.staleness_limit(10, 0.5, 4) == 60


def test_metric_tables(spark):
    from pyspark.sql import functions as F
    from quillon.operators import evaluation as ev

    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "name string, v double")
    assert sorted(map(tuple, ev.merged_metrics(a, a.filter("name = 'x'"), name="name", value="v").collect())) == [("x", 1.0), ("y", 2.0)]
    with pytest.raises(Exception, match="unlike values for x"):
        ev.merged_metrics(a, spark.createDataFrame([("x", 3.0)], a.schema), name="name", value="v").collect()
    lists = spark.createDataFrame([("p/a", 2, [3]), ("a", 1, [1, 2]), ("b", 1, [])], "name string, n int, v array<int>")
    assert {r.name: r["values"] for r in ev.appended(lists, name="name", value="v", order=["n"], prefix="p/").collect()} == {"p/a": [1, 2, 3], "p/b": []}
    rows = spark.createDataFrame([("t", True), ("t", None), ("t", False), ("t", True)], "task string, ok boolean")
    assert ev.task_accuracy(rows, by=["task"], correct=F.col("ok")).first().asDict() == {"task": "t", "attempted": 4, "correct": 2, "accuracy": 50.0}


def test_maths_answers_and_counting_questions(spark):
    from pyspark.sql import functions as F
    from quillon.functions import answers as an

    said = {"x = 12 square\\;units": "12", "$3,000$ dollars": "3000", "so $\\frac12$ and $7$": "\\frac{1}{2}", "\\text{yes}": "yes", "\\boxed{\\sqrt2}": "\\sqrt{2}", "45^{\\circ}": "45", '"5"\\ldots': "5"}
    df = spark.createDataFrame([(k,) for k in said], "x string").select("x", an.maths_normal(F.col("x")).alias("y"))
    assert {r.x: r.y for r in df.collect()} == said
    asked = {
        "When {A3} stops, how many yellow cars does {A1} overtake?": ("yellow cars", "yellow", "overtake", "A1", ["A1"]),
        "How many people in total?": ("people", None, "?", None, []),
        "Where is it?": ("the target category in the question", None, "?", None, []),
        "how many trucks parked in front of {B2} are behind {A4}": ("trucks", None, "same-direction-behind", "A4", ["B2", "A4"])}
    df = spark.createDataFrame([(k,) for k in asked], "q string").select("q", an.count_clause(F.col("q")).alias("c"))
    assert {r.q: tuple(r.c) for r in df.collect()} == asked


def test_leaks_in_marks(spark):
    from quillon.operators import quality as qu

    items = ["one two three four", "yes", "two words", "a b c d e f g h i j k", "  ", None, "x  y z"]
    docs = ['he said "one two three four", twice', "oh yes!", "(two words)", "q:a b c d e f g h i j k.", "one two three", None, "", "x y z", "one two three four yes"]
    d = spark.createDataFrame(list(enumerate(docs)), "doc int, text string")
    i = spark.createDataFrame(list(enumerate(items)), "item int, words string")
    got = qu.leaked_answers(d, i, doc_id="doc", doc_text="text", item_id="item", item_text="words").collect()
    want = {(a, b) for a, t in enumerate(docs) for b, w in enumerate(items) if t is not None and w and w.strip() and w.strip() in t}
    assert set(map(tuple, got)) == want and len(got) == len(want)
