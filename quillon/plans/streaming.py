"""Streams over `events`, read as a file stream of the given table and worked off to the end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tables as tf
from ..operators.sampling import indexed
from ..streaming import operators as st
from .tables import Area, Tables, shared_place

area = Area()


def _events(t: Tables) -> DataFrame:
    """The table's own file as a stream."""
    return t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/event[s].parquet")


@area.query("""SELECT event_id, user_id, event_type FROM events""")
def t3_resume_by_id(t):
    out, check = shared_place(t.spark, "t3"), shared_place(t.spark, "t3-check")
    twice = _events(t)
    once = st.new_by_id(twice.unionByName(twice), key="event_id").select("event_id", "user_id", "event_type")
    for _ in range(2):  # the second run finds nothing new
        st.run_to_end(once, out, check)
    return t.spark.read.parquet(out)


@area.query("""SELECT day, event_type, CASE WHEN event_type LIKE '%max%' THEN max(value) ELSE avg(value) END AS "value~", count(*) AS n FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, * FROM events) WHERE day < (SELECT strftime(max(ts) - INTERVAL 1 HOUR, '%Y-%m-%d') FROM events) GROUP BY 1, 2""")
def t6_windowed_metrics(t):
    out, check = shared_place(t.spark, "t6"), shared_place(t.spark, "t6-check")
    timed = _events(t).withColumn("ts", F.col("ts").cast("timestamp"))
    st.run_to_end(st.windowed_metrics(timed, time="ts", name="event_type", value="value", width="1 day", watermark="1 hour"), out, check)
    return t.spark.read.parquet(out).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "value", "n")


@area.query("""SELECT avg(value) AS "avg~", max(value) AS "max~", min(value) AS "min~", quantile_cont(value, 0.5) AS "tp50~", quantile_cont(value, 0.95) AS "tp95~", quantile_cont(value, 0.99) AS "tp99~" FROM events""", digits=5)
def t7_batch_statistics(t):
    out, check = shared_place(t.spark, "t7"), shared_place(t.spark, "t7-check")
    st.run_to_end(_events(t), out, check, each=st.batch_statistics(out, value="value"))
    return t.spark.read.parquet(out).drop("batch")


@area.query("""SELECT event_type, batch, n, first, "processing_time_avg~", "processing_time_max~", "processing_time_min~", "processing_time_tp95~", "tool_calls_mean~", partial_num, "partial_ratio~", max_partial_span, version_diversity FROM (SELECT event_type, batch, count(*) AS n, min(event_id) AS first, avg(value) AS "processing_time_avg~", max(value) AS "processing_time_max~",
    min(value) AS "processing_time_min~", quantile_cont(value, 0.95) AS "processing_time_tp95~", avg(event_id % 4)::DOUBLE AS "tool_calls_mean~", count(*) FILTER (event_id % 3 > 0) AS partial_num, count(*) FILTER (event_id % 3 > 0) / 32 AS "partial_ratio~", max(event_id % 3) AS max_partial_span, count(DISTINCT event_id % 5 + event_id % 3) AS version_diversity
  FROM (SELECT *, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 32 AS batch, count(*) OVER (PARTITION BY event_type) AS size FROM events) WHERE (batch + 1) * 32 <= size GROUP BY 1, 2)""", digits=7)
def t7_batch_assembly(t):
    out, check = shared_place(t.spark, "t7b"), shared_place(t.spark, "t7b-check")
    rocks(t)
    rows = _events(t).select("event_type", "event_id", "value", (F.col("event_id") % 4).alias("tools"), (F.col("event_id") % 5).alias("v1"), (F.col("event_id") % 5 + F.col("event_id") % 3).alias("v2"))
    made = st.assembled_batches(rows, key="event_type", size=32, item="event_id", seconds="value", tool_seconds="tools", version_start="v1", version_end="v2", order="event_id")
    st.run_to_end(made, out, check)
    shown = ["event_type", "batch", F.size("items").cast("long").alias("n"), F.array_min("items").alias("first")]
    return t.spark.read.parquet(out).select(*shown, "processing_time_avg", "processing_time_max", "processing_time_min", "processing_time_tp95", "tool_calls_mean", "partial_num", "partial_ratio", "max_partial_span", "version_diversity")


@area.query("SELECT doc_id + 1000000 AS doc_id, n_chars + 50 AS n_chars FROM documents WHERE n_chars + 50 <= 500")
def t8_generated_append(t):
    out, check = shared_place(t.spark, "t8"), shared_place(t.spark, "t8-check")
    docs = t.spark.readStream.schema(t.documents.schema).parquet(f"{t.folder}/document[s].parquet")
    grow = lambda b: b.select((F.col("doc_id") + 1_000_000).alias("doc_id"), (F.col("n_chars") + 50).alias("n_chars"))
    st.run_to_end(docs, out, check, each=st.append_generated(out, grow, length=F.col("n_chars"), limit=500))
    return t.spark.read.parquet(out).drop("batch")


def rocks(t: Tables) -> None:
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@area.query("""SELECT event_type, count(*) AS produced, 0::BIGINT AS consumed, count(*) - least(count(*), 10) AS dropped, array_to_string(list(name ORDER BY event_id DESC)[:10], ',') AS kept FROM (SELECT *, 'e' || event_id AS name FROM events) GROUP BY 1""")
def t1_bounded_buffer(t):
    out, check = shared_place(t.spark, "t1"), shared_place(t.spark, "t1-check")
    rocks(t)
    named = _events(t).select("event_type", "event_id", F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("name"))
    buffers = st.bounded_buffer(named, key="event_type", item="name", n=10, order="event_id")
    st.run_to_end(buffers, out, check, mode="update", each=lambda b, k: b.write.mode("overwrite").parquet(f"{out}/batch={k}"))
    return t.spark.read.parquet(out).select("event_type", "produced", "consumed", "dropped", F.array_join(F.reverse("items"), ",").alias("kept"))


@area.query("""SELECT event_type, max(day) AS current_version, least(6, count(*) FILTER (day = last)) AS in_flight, count(DISTINCT day) - 1 AS resets, sum(over)::BIGINT AS refused, count(*) FILTER (day = last) >= 6 AS pause
  FROM (SELECT *, max(day) OVER (PARTITION BY event_type) AS last, (row_number() OVER (PARTITION BY event_type, day ORDER BY event_id) > 6)::INT AS over FROM (SELECT *, event_id // 40 AS day FROM events)) GROUP BY event_type""")
def t2_staleness_gate(t):
    out, check = shared_place(t.spark, "t2"), shared_place(t.spark, "t2-check")
    rocks(t)
    rows = _events(t).select("event_type", "event_id", F.floor(F.col("event_id") / 40).alias("version"))
    gate = st.staleness_gate(rows, key="event_type", version="version", order="event_id", limit=st.staleness_limit(2, 0.5, 2))
    st.run_to_end(gate, out, check, mode="update", each=lambda b, k: b.write.mode("overwrite").parquet(f"{out}/batch={k}"))
    return t.spark.read.parquet(out).select("event_type", "current_version", "in_flight", "resets", "refused", "pause")


VERSION = "WITH v AS (SELECT *, dense_rank() OVER (ORDER BY strftime(ts, '%Y-%m-%d')) AS version FROM events), c AS (SELECT max(version) AS current_version FROM v)"


@area.query("SELECT version, count(*) AS in_flight, count(*) >= 60 AS paused FROM v GROUP BY 1", with_=VERSION)
def t2_in_flight(t):
    return st.in_flight_report(_versions(t), version="version", limit=st.staleness_limit(10, 0.5, 4))


@area.query("SELECT event_id, current_version - version AS version_lag, current_version - version <= 3 AS fresh FROM v, c", with_=VERSION)
def t2_version_lag(t):
    v = _versions(t)
    current = v.agg(F.max("version").alias("current_version"))
    return st.version_lag(v.select("event_id", "version"), current, version="version", threshold=3).select("event_id", "version_lag", "fresh")


def _versions(t: Tables) -> DataFrame:
    day = F.date_format("ts", "yyyy-MM-dd")
    days = indexed(t.events.select(day.alias("day")).distinct(), key="day").select("day", (F.col("i") + 1).alias("version"))
    return t.events.withColumn("day", day).join(days, "day")


@area.query("SELECT count(*) AS done, max(event_id) AS last_id FROM events")
def t4_progress(t):
    out, check = shared_place(t.spark, "t4"), shared_place(t.spark, "t4-check")
    running = _events(t).groupBy().agg(F.count("*").alias("done"), F.max("event_id").alias("last_id"))
    st.run_to_end(running, out, check, mode="complete", each=lambda b, k: b.write.mode("overwrite").parquet(out))
    return t.spark.read.parquet(out)


@area.query("""SELECT u, CAST(count(DISTINCT event_type) AS BIGINT) AS n_fields, sum(n)::BIGINT AS n_values FROM (SELECT user_id AS u, event_type, count(DISTINCT event_id % 7) AS n FROM events e WHERE event_id > coalesce((SELECT max(event_id) FROM events r WHERE r.user_id = e.user_id AND r.event_id % 41 = 0), -1) GROUP BY 1, 2) GROUP BY 1""")
def t5_merged_state(t):
    updates = t.events.select("user_id", "event_id", F.when(F.col("event_id") % 41 == 0, "reset").otherwise("append").alias("op"), "event_type", (F.col("event_id") % 7).cast("string").alias("v"))
    state = st.merged_state(updates, key="user_id", order=["event_id"], op="op", field="event_type", value="v").filter(F.size("state") > 0)
    return state.select(F.col("user_id").alias("u"), F.size("state").cast("long").alias("n_fields"), F.aggregate(F.map_values("state"), F.lit(0).cast("long"), lambda a, x: a + F.size(x)).alias("n_values"))


@area.query("""SELECT u, object, array_to_string(list(v || '=' || s ORDER BY v), ',') AS views FROM (SELECT user_id AS u, event_type AS object, CASE event_id % 4 WHEN 3 THEN 'note' ELSE 'v' || event_id % 4 END AS v, arg_max(event_id, event_id) AS s
  FROM events e WHERE event_id > coalesce((SELECT max(event_id) FROM events r WHERE r.user_id = e.user_id AND r.event_id % 41 = 0), -1) GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def t5_object_memory(t):
    view = F.when(F.col("event_id") % 4 == 3, F.lit(None)).otherwise(F.concat(F.lit(" v"), (F.col("event_id") % 4).cast("string")))
    updates = t.events.select("user_id", "event_id", F.concat("event_type", F.lit(" ")).alias("object"), view.alias("view"), F.col("event_id").cast("string").alias("state"))
    memory = st.object_memory(updates, key="user_id", order=["event_id"], obj="object", view="view", state="state", reset=F.col("event_id") % 41 == 0)
    views = F.array_join(F.transform(F.array_sort(F.map_keys("views")), lambda v: F.concat(v, F.lit("="), F.col("views")[v])), ",")
    return memory.select(F.col("user_id").alias("u"), "object", views.alias("views"))


@area.query("""SELECT u, object, array_to_string(list(v || '=' || s ORDER BY v), ',') AS views FROM (SELECT user_id AS u, event_type AS object, CASE event_id % 4 WHEN 3 THEN 'note' ELSE 'v' || event_id % 4 END AS v, arg_max(event_id, event_id) AS s
  FROM events e WHERE event_id > coalesce((SELECT max(event_id) FROM events r WHERE r.user_id = e.user_id AND r.event_id % 41 = 0), -1) GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def t5_object_memory_stream(t):
    out, check = shared_place(t.spark, "t5m"), shared_place(t.spark, "t5m-check")
    rocks(t)
    view = F.when(F.col("event_id") % 4 == 3, F.lit(None)).otherwise(F.concat(F.lit(" v"), (F.col("event_id") % 4).cast("string")))
    updates = _events(t).select("user_id", "event_id", F.concat("event_type", F.lit(" ")).alias("object"), view.alias("view"), F.col("event_id").cast("string").alias("state"))
    changes = st.object_memory_stream(updates, key="user_id", order="event_id", obj="object", view="view", state="state", reset=F.col("event_id") % 41 == 0)
    st.run_to_end(changes, out, check, mode="update", each=lambda b, k: b.write.mode("overwrite").parquet(f"{out}/batch={k}"))
    memory = st.memory_of_changes(t.spark.read.parquet(out), key="user_id")
    views = F.array_join(F.transform(F.array_sort(F.map_keys("views")), lambda v: F.concat(v, F.lit("="), F.col("views")[v])), ",")
    return memory.select(F.col("user_id").alias("u"), "object", views.alias("views"))


@area.query("""SELECT event_type, fields, n_values FROM (SELECT event_type, array_to_string(list_sort(list(DISTINCT 'f' || event_id % 3)), ',') AS fields, count(DISTINCT (event_id % 3, event_id % 5))::BIGINT AS n_values FROM events GROUP BY 1)""")
def t5_merged_state_stream(t):
    out, check = shared_place(t.spark, "t5"), shared_place(t.spark, "t5-check")
    rocks(t)
    updates = _events(t).select("event_type", "event_id", F.lit("append").alias("op"), F.concat(F.lit("f"), (F.col("event_id") % 3).cast("string")).alias("field"), (F.col("event_id") % 5).cast("string").alias("value"))
    st.run_to_end(st.merged_state_stream(updates, key="event_type", order="event_id"), out, check, mode="update", each=lambda b, k: b.write.mode("overwrite").parquet(f"{out}/batch={k}"))
    return t.spark.read.parquet(out).select("event_type", F.array_join(F.array_sort("fields"), ",").alias("fields"), "n_values")


@area.query("""SELECT user_id, 'made ' || event_type AS text, count(*) AS n FROM events GROUP BY 1, 2""")
def x5_generator_plug(t):
    def generate(batches):
        for pdf in batches:
            yield pdf[["user_id"]].assign(text="made " + pdf["event_type"])

    made = st.generated(t.events.select("user_id", "event_type"), generate, "user_id long, text string")
    return made.groupBy("user_id", "text").agg(F.count("*").alias("n"))


@area.query("""SELECT doc_id, source, context, lang FROM (SELECT doc_id, source, lang, list(lang) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)[1 : -2] AS context FROM documents)""")
def x5_generator_table_function(t):
    tf.register_generator(t.spark, "with_neighbours", tf.Neighbours)
    t.documents.select("doc_id", "source", "lang").createOrReplaceTempView("x5_documents")
    made = t.spark.sql("SELECT * FROM with_neighbours(TABLE(SELECT * FROM x5_documents) PARTITION BY source ORDER BY doc_id, key => 'doc_id', text => 'lang', before => 2)")
    return made.join(t.documents.select("doc_id", "source"), "doc_id").select("doc_id", "source", "context", "lang")


@area.query("""SELECT conv_id, turn, CASE WHEN turn % 5 <> 0 THEN 2.0 * length(coalesce(text, '')) / turn END AS "score~" FROM conversations""")
def x1_scorer_table_function(t):
    tf.register_scorer(t.spark, "score_turns", lambda text, turn, factor: factor * len(text or "") / (turn if turn % 5 else 0), ["text", "turn"])
    t.conversations.select("conv_id", "turn", "text").createOrReplaceTempView("x1_turns")
    return t.spark.sql("SELECT conv_id, turn, score FROM score_turns(TABLE(SELECT * FROM x1_turns), factor => 2.0D)")


@area.query("""SELECT source, CASE WHEN m IS NULL THEN 1.0 ELSE 0.5 + 0.5 * (1 - m) END AS "weight~" FROM (SELECT source, avg(quality) AS m FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)""")
def x5_curriculum_weights(t):
    weights = t.documents.select("source").distinct().withColumn("weight", F.lit(1.0))
    return st.curriculum_weights(t.documents.join(t.labels, "doc_id"), weights, key="source", score="quality")


QUERIES, ORACLE_SQL = area.queries, area.sql
