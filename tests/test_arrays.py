"""JSON arrays cut into ranges of any size against the whole file parsed at once."""

import json
import random

import pytest
from pyspark.sql import types as T
from quillon.sources import arrays, files


def strange(draw, deep=0):
    kind = draw.randint(0, 7 if deep < 4 else 4)
    if kind > 5:
        return {strange_text(draw): strange(draw, deep + 1) for _ in range(draw.randint(0, 3))}
    if kind == 5:
        return [strange(draw, deep + 1) for _ in range(draw.randint(0, 4))]
    return [None, True, draw.randint(-9, 9**9), draw.random(), strange_text(draw)][kind]


def strange_text(draw):
    return "".join(draw.choice(['"', "\\", "[", "]", "{", "}", ",", ":", " ", "a", "é", "\n", "\\\\", "日"]) for _ in range(draw.randint(0, 12)))


@pytest.mark.parametrize("range_bytes", [3, 17, 64, 10_000])
def test_ranges(spark, tmp_path, monkeypatch, range_bytes):
    draw = random.Random(range_bytes)
    lists = [[], [{}], [strange(draw) for _ in range(40 if range_bytes > 3 else 6)], [{"x": "y" * 300}, [[]], "]", "\\"]]
    for k, rows in enumerate(lists):
        text = json.dumps(rows, ensure_ascii=k % 2 == 0, indent=k if k > 1 else None)
        (tmp_path / f"f{k}.json").write_text(f" \n{text}\n" if k else text, encoding="utf-8")
    got = arrays.array_elements(spark, f"file://{tmp_path}", range_bytes=range_bytes).collect()
    for k, rows in enumerate(lists):
        found = sorted((r.source_index, json.loads(r.raw)) for r in got if r.file.endswith(f"f{k}.json")) if k != 2 else [(r.source_index, json.loads(r.raw)) for r in sorted((r for r in got if r.file.endswith("f2.json")), key=lambda r: r.source_index)]
        assert [i for i, _ in found] == list(range(len(rows))) and [x for _, x in found] == rows


def test_chunks_end_anywhere(spark, tmp_path, monkeypatch):
    rows = [{"a": '\\" ,]' * n, "b": [n]} for n in range(30)]
    (tmp_path / "x.json").write_text(json.dumps(rows))
    path = f"file:{tmp_path}/x.json"
    size = (tmp_path / "x.json").stat().st_size
    for chunk in (1, 2, 5, 64):
        monkeypatch.setattr(arrays, "CHUNK_BYTES", chunk)
        with arrays.opened(path) as file:
            whole = {"start": 0, "stop": size, "size": size, "inside": False, "depth": 0, "before": 0}
            assert [(i, json.loads(t)) for i, t in arrays.elements(file, whole)] == list(enumerate(rows))


def test_one_file_is_many_tasks_and_only_the_wanted_ranges_are_read(spark, tmp_path):
    rows = [{"id": n, "text": "x" * 90} for n in range(20_000)]
    (tmp_path / "big.json").write_text(json.dumps(rows))
    schema = T.StructType([T.StructField("id", T.LongType())])
    df = files.read_json_array(spark, f"file://{tmp_path}", schema, range_bytes=50_000)
    assert {(r.source_index, r.id) for r in df.collect()} == {(n, n) for n in range(20_000)}
    assert len({r.p for r in df.selectExpr("spark_partition_id() as p").distinct().collect()}) > 4
    part = files.read_json_array(spark, f"file://{tmp_path}", schema, start=7_500, limit=20, range_bytes=50_000)
    assert sorted((r.source_index, r.id) for r in part.collect()) == [(n, n) for n in range(7_500, 7_520)]


@pytest.mark.parametrize("text, says", [('{"a": [1]}', "root is not a list"), ('[{"a": 1}', "does not end"), ('[{"a": "1}]', "does not end"), ("[1]", "not an object"), ('[{"a": 1},]', "not an object")])
def test_faults(spark, tmp_path, text, says):
    (tmp_path / "f.json").write_text(text)
    schema = T.StructType([T.StructField("a", T.LongType())])
    with pytest.raises(Exception, match=says):
        files.read_json_array(spark, f"file://{tmp_path}", schema, range_bytes=4).collect()


def test_logs_that_are_no_lists_give_none(spark, tmp_path):
    for name, text in (("12_a", '[{"turn": 1, "tool_name": "t"}, 5, {"turn": 2}]'), ("x", "{}"), ("13", "[{"), ("14", ""), ("15_b", '[{"turn": 3}]')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "tools_execution.json").write_text(text)
    got = sorted((r.task_id, r.turn) for r in files.read_tool_logs(spark, f"file://{tmp_path}").collect())
    assert got == [(12, 1), (12, 2), (15, 3)]
