from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sampling import indexed
from ..sources import files as fi
from .tables import Area, shared_place

area = Area()


@area.query("SELECT * FROM (SELECT r_regionkey AS key, r_name AS name, NULL::INT AS up FROM region UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation)")
def s1_read_files(t):
    rows = [fi.read_files(t.spark, [f"{t.folder}/{n}.parquet"]) for n in ("region", "nation")]
    a = rows[0].select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    return a.unionByName(rows[1].select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("up")), allowMissingColumns=True)


@area.query("""SELECT doc_id::VARCHAR AS sample_id, [lang, source] AS video_paths, 'which?' AS question, lang || ',' || source AS answer FROM documents""")
def s3_map_fields(t):
    raw = t.documents.select(F.col("doc_id").alias("id"), F.array("lang", "source").alias("videos"), F.lit("which?").alias("q"), F.array("lang", "source").alias("a"))
    out = fi.map_fields(raw, {"sample_id": "id", "video_paths": "videos", "question": "q", "answer": "a"}, file=F.lit("documents"), index=F.col("id"))
    return out.drop("task_metadata")


UNIFY = """WITH u AS (SELECT source, CASE WHEN doc_id % 3 = 0 THEN 'skipped' WHEN doc_id % 3 = 1 THEN 'modified' ELSE 'error' END AS status FROM documents)"""


@area.query("""SELECT source, count(*) FILTER (status = 'modified') AS modified, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'error') AS error FROM u GROUP BY 1""", with_=UNIFY)
def s4_unify_video_fields(t):
    k, none = F.col("doc_id") % 3, F.lit(None).cast("array<string>")
    raw = t.documents.select("source", F.when(k == 0, F.array("lang")).otherwise(none).alias("videos"), F.when(k == 1, F.array("lang")).otherwise(none).alias("scripts"))
    return fi.status_report(fi.unify_video_fields(raw), task="source")


@area.query("""SELECT user_id AS id, arg_max(event_id, event_id) AS seq, arg_max(json_extract_string(props, '$.k')::BIGINT, event_id) AS k FROM events WHERE event_id % 5 > 0 GROUP BY 1""")
def s6_jsonl_by_id(t):
    whole = F.to_json(F.struct(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.get_json_object("props", "$.k").cast("long").alias("k")))
    line = F.when(F.col("event_id") % 5 > 0, whole).when(F.col("event_id") % 10 == 0, " ").otherwise("{broken")
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("id", "seq", "k")])
    return fi.read_jsonl_by_id(t.events.select("event_id", line.alias("line")), line="line", order="event_id", schema=schema)


@area.query("""SELECT source AS data_source, doc_id::VARCHAR AS task_id, 'Is it ' || lang || '?' || chr(10) || 'A. yes' || chr(10) || 'B. no' AS content, CASE WHEN quality = 1 THEN 'A' ELSE 'B' END AS ground_truth FROM documents JOIN labels USING (doc_id) QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5""")
def s7_training_rows(t):
    rows = t.documents.join(t.labels, "doc_id").select("doc_id", "source", F.concat(F.lit("Is it "), "lang", F.lit("?")).alias("q"), F.when(F.col("quality") == 1, "A").otherwise("B").alias("a"))
    out = fi.training_rows(rows, source="source", key="doc_id", question="q", options=F.array(F.lit("A. yes"), F.lit("B. no")), answer="a", videos=F.array("source"), first=5)
    return out.select("data_source", F.col("extra_info.task_id").alias("task_id"), F.col("prompt")[0]["content"].alias("content"), F.col("reward_model.ground_truth").alias("ground_truth"))


@area.query("""SELECT conv_id, string_agg(role || '=' || text, '|' ORDER BY turn) AS messages FROM conversations GROUP BY 1 HAVING conv_id % 2 = 0 AND bool_or(role = 'assistant')""")
def s8_sft_export(t):
    rows = fi.training_messages(t.conversations, conv="conv_id", turn="turn", role="role", text="text").withColumn("ok", F.col("conv_id") % 2 == 0)
    out, _ = fi.sft_export(rows, messages="messages", correct="ok", metadata=["conv_id"])
    return out.select("metadata.conv_id", F.array_join(F.transform("messages", lambda m: F.concat_ws("=", m["role"], m["content"])), "|").alias("messages"))


@area.query("""SELECT count(*) FILTER (conv_id % 2 = 0 AND a) AS exported, count(*) FILTER (conv_id % 2 <> 0) AS skipped_incorrect, count(*) FILTER (conv_id % 2 = 0 AND NOT a) AS skipped_empty FROM (SELECT conv_id, bool_or(role = 'assistant') AS a FROM conversations GROUP BY 1)""")
def s8_sft_counts(t):
    rows = fi.training_messages(t.conversations, conv="conv_id", turn="turn", role="role", text="text").withColumn("ok", F.col("conv_id") % 2 == 0)
    return fi.sft_export(rows, messages="messages", correct="ok", metadata=["conv_id"])[1]


@area.query("""SELECT task, count(*) AS total, count(*) FILTER (n > 2) AS correct, count(*) FILTER (n <= 2) AS incorrect, count(*) FILTER (d) AS with_diagnosis FROM (SELECT conv_id, 'task' || conv_id % 4 AS task, count(*) AS n, bool_or(turn > 5) AS d FROM conversations GROUP BY 1) GROUP BY ROLLUP (task)""")
def s9_trajectory_summary(t):
    rows = t.conversations.groupBy("conv_id").agg((F.count("*") > 2).alias("ok"), F.bool_or(F.col("turn") > 5).alias("d")).withColumn("task", F.concat(F.lit("task"), (F.col("conv_id") % 4).cast("string")))
    return fi.trajectory_summary(rows, task="task", correct="ok", diagnosed="d")


@area.query("""SELECT conv_id, string_agg(coalesce(text, ''), '|' ORDER BY turn) AS responses FROM conversations GROUP BY 1""")
def s13_response_arrays(t):
    rows = fi.response_arrays(t.conversations, prompt="conv_id", order="turn", text="text")
    return rows.select("conv_id", F.array_join("responses", "|").alias("responses"))


ROW = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType())])


@area.query("""SELECT source AS source_file, i AS source_index, doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents) WHERE i >= 2 AND i < 12""")
def s2_json_array(t):
    path = shared_place(t.spark, "s2")
    rows = indexed(t.documents.select(F.struct("source", "doc_id").alias("at"), "source", "doc_id", "lang"), key="at")
    rows = rows.join(rows.groupBy("source").agg(F.min("i").alias("first")), "source").withColumn("part", F.floor((F.col("i") - F.col("first")) / 1000))
    # task files of a thousand rows, each one JSON array; a file's name says which rows of its source it has
    files = rows.groupBy("source", "part").agg(F.array_sort(F.collect_list(F.struct("doc_id", "lang"))).alias("rows"))
    files.select("source", "part", F.to_json("rows").alias("value")).write.partitionBy("source", "part").text(path)
    got = fi.read_json_array(t.spark, path, ROW).select(F.col("source").alias("source_file"), (F.col("part") * 1000 + F.col("source_index")).cast("long").alias("source_index"), "doc_id", "lang")
    return got.filter("source_index >= 2 and source_index < 12")


@area.query("""SELECT conv_id AS task_id, turn, role AS tool_name, CASE WHEN turn % 2 = 0 THEN 1 ELSE 2 END AS n_targets FROM conversations""")
def s5_tool_logs(t):
    path = shared_place(t.spark, "s5")
    entry = F.struct("turn", F.col("role").alias("tool_name"), F.struct(F.when(F.col("turn") % 2 == 0, F.array(F.lit("v1"))).otherwise(F.array(F.lit("v1"), F.lit("v2"))).alias("observation_targets")).alias("inputs"))
    logs = t.conversations.groupBy(F.concat(F.col("conv_id").cast("string"), F.lit("_log")).alias("dir")).agg(F.to_json(F.collect_list(entry)).alias("value"))
    # a folder for each log: as many writers as there are cores, and each task moves its own files to their place, not the driver all
    writer = logs.repartition(t.spark.sparkContext.defaultParallelism, "dir").write.partitionBy("dir")
    writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)
    out = fi.read_tool_logs(t.spark, path, "*.txt")
    return out.select(F.regexp_extract("dir", r"dir=(\d+)", 1).cast("long").alias("task_id"), "turn", "tool_name", F.size("inputs.observation_targets").alias("n_targets"))


@area.query("SELECT doc_id % 5 AS step, doc_id, lang AS output, quality::BIGINT AS score FROM documents JOIN labels USING (doc_id)")
def s10_rollout_dump(t):
    path = shared_place(t.spark, "s10")
    rows = t.documents.join(t.labels, "doc_id").select((F.col("doc_id") % 5).alias("step"), "doc_id", F.col("lang").alias("output"), F.col("quality").cast("long").alias("score"))
    fi.dump_rollouts(rows, path, step="step")
    return t.spark.read.schema(rows.schema).json(path).select(*rows.columns)


@area.query("""SELECT step, event_type AS name, v AS "value~" FROM (SELECT event_id % 7 AS step, event_type, avg(value) AS v FROM events GROUP BY 1, 2)""")
def s11_metric_log(t):
    path = shared_place(t.spark, "s11")
    m = t.events.groupBy((F.col("event_id") % 7).alias("step"), "event_type").agg(F.avg("value").alias("v"))
    fi.append_metrics(m.filter("step < 3"), path, step="step", name="event_type", value="v")
    fi.append_metrics(m.filter("step >= 3"), path, step="step", name="event_type", value="v")
    return t.spark.read.schema("step long, data map<string,double>").json(path).select("step", F.explode("data").alias("name", "value"))


@area.query("SELECT doc_id, length(lang) AS score FROM documents")
def s12_append_records(t):
    path = shared_place(t.spark, "s12")
    score = lambda df: df.select("doc_id", F.length("lang").cast("long").alias("score"))
    docs = t.documents.select("doc_id", "lang")
    fi.append_records(docs.filter("doc_id % 3 = 0"), path, key="doc_id", evaluate=score)
    return fi.append_records(docs, path, key="doc_id", evaluate=score)


QUERIES, ORACLE_SQL = area.queries, area.sql
