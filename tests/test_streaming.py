"""State that lives across micro-batches: one file a batch."""

import pytest
from pyspark.sql import functions as F
from quillon.streaming import operators as st


@pytest.fixture(scope="module")
def streamed(spark, tmp_path_factory):
    """Runs a stream of lists of rows, one list a micro-batch, and returns what each batch gave."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def run(batches, schema, f, mode="update"):
        folder = tmp_path_factory.mktemp("stream")
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
            out = []
            stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(str(folder / "in"))
            st.run_to_end(f(stream), "", str(folder / "check"), mode=mode, each=lambda b, _, out=out: out.extend(b.collect()))
            yield out

    return run


def test_buffer_keeps_arrival_and_counts(streamed):
    batches = [[("a", "x3", "put"), ("a", "x1", "put")], [("a", "x2", "put"), ("a", "x9", "put"), ("a", None, "get"), ("b", "y", "get")], [("b", "z", "put")]]
    got = list(streamed(batches, "k string, item string, op string", lambda s: st.bounded_buffer(s, key="k", item="item", n=3, op="op")))
    last = {r.k: (list(r["items"]), r.produced, r.consumed, r.dropped) for b in got for r in b}
    assert last == {"a": (["x2", "x9"], 4, 1, 1), "b": (["z"], 1, 0, 0)}
    assert [sorted(r.k for r in b) for b in got] == [["a"], ["a", "b"], ["b"]]


def test_staleness_resets_with_the_version(streamed):
    batches = [[("r", 1, 1, 0), ("r", 1, 2, 0), ("r", 1, 3, 0)], [("r", 1, 4, 0), ("r", 2, 5, 1)], [("r", 2, 6, 0)]]
    got = [b[0] for b in streamed(batches, "k string, version long, n long, waiting long", lambda s: st.staleness_gate(s, key="k", version="version", limit=2, order="n", waiting="waiting"))]
    assert [(r.current_version, r.in_flight, r.resets, r.refused, r.pause) for r in got] == [(1, 2, 0, 1, True), (2, 2, 1, 2, True), (2, 2, 1, 3, True)]


def test_batches_fill_across_micro_batches(streamed):
    rows = [("t", i, float(i), 0.5, i % 2, 1) for i in range(11)]
    names = {"key": "k", "item": "i", "seconds": "s", "tool_seconds": "ts", "version_start": "a", "version_end": "b", "order": "i"}
    got = list(streamed([rows[:3], rows[3:4], rows[4:]], "k string, i long, s double, ts double, a long, b long", lambda s: st.assembled_batches(s, size=4, **names), mode="append"))
    made = [[(r.batch, list(r["items"]), r.processing_time_tp50, r.partial_num, r.version_diversity) for r in b] for b in got]
    assert made == [[], [(0, [0, 1, 2, 3], 1.5, 2, 1)], [(1, [4, 5, 6, 7], 5.5, 2, 1)]]


def test_object_memory(spark):
    rows = [("q", 1, " car ", "v1", "red"), ("q", 2, "car", " v1", "blue"), ("q", 3, "car", None, "seen"), ("q", 4, "", "v2", "x"), ("p", 1, "car", "v1", "old"), ("p", 2, None, None, "reset"), ("p", 3, "bus", "v2", None)]
    df = spark.createDataFrame(rows, "k string, n int, object string, view string, state string")
    got = st.object_memory(df, key="k", order=["n"], obj="object", view="view", state="state", reset=F.col("state") == "reset")
    assert {(r.k, r.object): r.views for r in got.collect()} == {("q", "car"): {"v1": "blue", "note": "seen"}, ("p", "bus"): {"v2": None}}


def test_object_memory_over_batches_and_restarts(spark, streamed):
    """Each batch is a query of its own that goes on from the checkpoint."""
    rows = [("q", 1, " car ", "v1", "red"), ("q", 2, "car", " v1", "blue"), ("q", 3, "car", None, "seen"), ("p", 4, "car", "v1", "old"), ("q", 5, "", "v2", "x"), ("p", 6, None, None, "reset"),
            ("p", 7, "bus", "v2", None), ("q", 8, "car", "v2", "green"), ("q", 9, None, None, "reset"), ("q", 10, "car", "v2", "black"), ("p", 11, "bus", "v2", "late"), ("r", 12, "x", "v", "y"), ("r", 13, None, None, "reset")]
    schema = "k string, n int, object string, view string, state string"
    names = dict(key="k", obj="object", view="view", state="state", reset=F.col("state") == "reset")
    got = list(streamed([rows[:4], rows[4:7], rows[7:9], rows[9:]], schema, lambda s: st.object_memory_stream(s, order="n", **names)))
    assert sum(map(len, got)) < len(rows)  # what a batch sets, and no more
    changes = spark.createDataFrame([r for b in got for r in b], "k string, epoch long, at long, object string, view string, state string")
    want = st.object_memory(spark.createDataFrame(rows, schema), order=["n"], **names)
    as_dict = lambda df: {(r.k, r.object): r.views for r in df.collect()}
    assert as_dict(st.memory_of_changes(changes, key="k")) == as_dict(want) == {("q", "car"): {"v2": "black"}, ("p", "bus"): {"v2": "late"}}
