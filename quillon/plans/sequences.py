from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import sampling as sa
from ..operators import sequences as se
from ..operators import setops as so
from .tables import Area

area = Area()
U = "('0x' || substr(md5({}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@area.query("""SELECT user_id, min(m) AS start, max(m) AS "end" FROM (SELECT user_id, m, m - row_number() OVER (PARTITION BY user_id ORDER BY m) AS g FROM (SELECT DISTINCT user_id % 20 AS user_id, floor(epoch(ts) / 3600)::BIGINT AS m FROM events)) GROUP BY user_id, g""")
def w12_islands(t):
    e = t.events.select((F.col("user_id") % 20).alias("user_id"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).alias("m"))
    return se.islands(e, keys=["user_id"], number="m")


@area.query("""SELECT doc_id, c AS chunk, count(*) AS n, min(i) AS first, max(i) AS last FROM (SELECT doc_id, i, n, unnest(range(greatest(ceil((i - 63) / 48.0), 0)::INT, least(i // 48, CASE WHEN n <= 64 THEN 0 ELSE ceil((n - 64) / 48.0) END)::INT + 1)) AS c
  FROM (SELECT doc_id, len(w)::BIGINT AS n, unnest(range(len(w)))::BIGINT AS i FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents))) GROUP BY 1, 2""")
def w13_chunks(t):
    words = t.documents.select("doc_id", F.split("text", " ").alias("w")).select("doc_id", F.size("w").cast("long").alias("n"), F.posexplode("w").alias("i", "word"))
    out = se.chunks(words.withColumn("i", F.col("i").cast("long")), keys=["doc_id"], index="i", count="n", size=64, overlap=16)
    return out.groupBy("doc_id", F.col("chunk").cast("int").alias("chunk")).agg(F.count("*").alias("n"), F.min("i").alias("first"), F.max("i").alias("last"))


@area.query("""SELECT doc_id, n_chars, c AS calls, n_chars + greatest(c - 1, 0) * 20 AS items_sent FROM (SELECT *, CASE WHEN n_chars <= 0 THEN 0 WHEN n_chars <= 100 THEN 1 ELSE ceil((n_chars - 100) / 80.0)::BIGINT + 1 END AS c FROM documents)""")
def w13_chunk_cost(t):
    return se.chunk_cost(t.documents.select("doc_id", "n_chars"), count="n_chars", size=100, overlap=20)


@area.query("""SELECT o_orderkey, k::INT AS point, o_totalprice * (k + 0.5) / 7 AS "tm~" FROM orders, range(7) r(k)""", digits=5)
def w14_uniform_points(t):
    return se.uniform_points(t.orders.select("o_orderkey", "o_totalprice"), start=F.lit(0.0), end=F.col("o_totalprice"), n=7, middle=True).select("o_orderkey", "point", F.col("at").alias("tm"))


@area.query("""SELECT k, point, s + (point + 0.5) / n * total - f AS "tm~" FROM (SELECT *, unnest(range(ceil(f / total * n - 0.5)::BIGINT, ceil(e / total * n - 0.5)::BIGINT)) AS point FROM (SELECT *, e - len AS f, least(greatest(ceil(total * 2), 1), 32) AS n FROM
  (SELECT user_id AS k, s, len, sum(len) OVER (PARTITION BY user_id ORDER BY s, s + len ROWS UNBOUNDED PRECEDING) AS e, sum(len) OVER (PARTITION BY user_id) AS total FROM (SELECT user_id, event_id * 100.0::DOUBLE AS s, (1 + event_id % 9) / 7 + event_id % 100 * 0.00137 AS len FROM events))))""", digits=4)
def w15_interval_points(t):
    spans = t.events.select(F.col("user_id").alias("k"), (F.col("event_id") * 100.0).alias("s"), (F.col("event_id") * 100.0 + ((1 + F.col("event_id") % 9) / 7 + F.col("event_id") % 100 * 0.00137)).alias("e"))
    return se.interval_points(spans, key="k", start="s", end="e").withColumnRenamed("at", "tm")


@area.query("""SELECT c_nationkey, c_mktsegment, n, (f + (row_number() OVER (PARTITION BY c_nationkey ORDER BY round(x - f, 9) DESC, c_mktsegment) <= 17 - sum(f) OVER (PARTITION BY c_nationkey))::INT)::BIGINT AS allotted
  FROM (SELECT *, floor(x) AS f FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n, 17.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY c_nationkey) AS x FROM customer GROUP BY 1, 2))""")
def w16_apportion(t):
    n = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return se.apportion(n, keys=["c_nationkey"], share="n", total=F.lit(17.0), order=["c_mktsegment"])


def picked(u: str, weights: dict[int, int]) -> str:
    """SQL of the value that u in [0, 1) picks by weight."""
    total, below, whens = sum(weights.values()), 0, ""
    for value, weight in weights.items():
        below += weight
        whens += f" WHEN {u} * {total} < {below} THEN {value}"
    return f"(CASE{whens} END)::BIGINT"


@area.query(f"""SELECT o, p, duration, position, e - duration AS start_s, e AS end_s, string_agg(position::VARCHAR, '->') OVER (PARTITION BY o ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS answer FROM
  (SELECT *, row_number() OVER w AS position, sum(duration) OVER (w ROWS UNBOUNDED PRECEDING)::BIGINT AS e FROM (SELECT l_orderkey AS o, l_linenumber AS p, {picked(U.format("'42:' || l_orderkey || ':' || l_linenumber || ':d'"), se.EVENT_SECONDS)} AS duration, md5('42:' || l_orderkey || ':' || l_linenumber || ':o') AS h
   FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) WINDOW w AS (PARTITION BY o ORDER BY h, p))""")
def w17_stitched_timeline(t):
    steps = t.lineitem.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("p")).distinct()
    return se.stitched_timeline(steps, task="o", phase="p").withColumnsRenamed({"start": "start_s", "end": "end_s"})


@area.query(f"""SELECT u, f, e, duration, z - duration AS start_s, z AS end_s, sum(duration) OVER (PARTITION BY u, f)::BIGINT AS total_duration FROM (SELECT *, sum(duration) OVER (PARTITION BY u, f ORDER BY e)::BIGINT AS z FROM
  (SELECT user_id AS u, event_type AS f, event_id AS e, {picked(U.format("'42:' || user_id || ':' || event_type || ':' || event_id || ':e'"), se.EVENT_SECONDS)} AS duration FROM events))""")
def w17_event_timelines(t):
    rows = t.events.select(F.col("user_id").alias("u"), F.col("event_type").alias("f"), F.col("event_id").alias("e"))
    return se.event_timelines(rows, task="u", phase="f", event="e").withColumnsRenamed({"start": "start_s", "end": "end_s"})


@area.query("""SELECT event_id, CASE WHEN k > 0 THEN s WHEN s > 100 THEN 90 ELSE greatest(s - 5, 0) END AS "a~", CASE WHEN k > 0 THEN s + k WHEN s > 100 THEN 100 ELSE least(s + 5, 100) END AS "b~" FROM (SELECT event_id, value AS s, event_id % 2 AS k FROM events)""")
def w18_expand_span(t):
    s = F.col("value")
    a, b = se.expand_span(s, s + F.col("event_id") % 2, F.lit(100.0), half=5.0)
    return t.events.select("event_id", a.alias("a"), b.alias("b"))


@area.query("""SELECT doc_id, abs(n_chars % 90 - 20) > 2 OR abs(n_chars % 90 + 19 - 40) > 2 AS repaired, CASE WHEN abs(n_chars % 90 - 20) > 2 OR abs(n_chars % 90 + 19 - 40) > 2 THEN 20 ELSE n_chars % 90 END AS "a~" FROM documents""")
def w19_repair_chunk_reference(t):
    rows = t.documents.select("doc_id", F.concat("text", F.lit("\nsee Chunk 2/5.")).alias("x"), (F.col("n_chars") % 90).cast("double").alias("a"), (F.col("n_chars") % 90 + 19.0).alias("b"), F.lit(100.0).alias("d"))
    return se.repair_chunk_reference(rows, text="x", start="a", end="b", duration="d").select("doc_id", "repaired", "a")


@area.query("""SELECT label, vec_id, ['nearest', 'farthest', 'first', 'last', 'uniform', 'fill'][r + 1] AS role FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY r, i) AS q FROM (SELECT *, CASE WHEN nr = 1 THEN 0 WHEN fr = 1 THEN 1 WHEN i = 1 THEN 2 WHEN i = n THEN 3 WHEN (i - 1) % greatest(n // 6, 1) = 0 THEN 4 ELSE 5 END AS r FROM
  (SELECT *, row_number() OVER (PARTITION BY label ORDER BY g, vec_id) AS nr, row_number() OVER (PARTITION BY label ORDER BY g DESC, vec_id) AS fr FROM
   (SELECT label, vec_id, round(sum((x - c) ** 2), 9) AS g, any_value(i) AS i, any_value(n) AS n FROM (SELECT *, avg(x) OVER (PARTITION BY label, d) AS c FROM (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings)) GROUP BY 1, 2)))) WHERE q <= 6""")
def w20_representatives(t):
    v = t.embeddings.select("label", "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return se.representatives(v, group="label", item="vec_id", vector="v", k=6)


@area.query("""SELECT event_id, CASE WHEN layer = 2 THEN least(f, coalesce(last_value(CASE WHEN layer = 1 THEN frames END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), f)) ELSE f END AS even_frames
  FROM (SELECT event_id, user_id, 1 + event_id % 2 AS layer, 4 + event_id % 7 AS frames, first_value(4 + event_id % 7) OVER (PARTITION BY user_id ORDER BY event_id) AS f FROM events)""")
def w21_equal_frames(t):
    rows = t.events.select("event_id", "user_id", (1 + F.col("event_id") % 2).alias("layer"), (4 + F.col("event_id") % 7).alias("frames"))
    return se.equal_frames(rows, group="user_id", order="event_id", layer="layer", frames="frames").select("event_id", "even_frames")


@area.query("""SELECT conv_id, array_to_string(list_append(list(role ORDER BY turn)[1:4], 'fix'), ',') AS history FROM conversations GROUP BY 1""")
def w22_resume_history(t):
    h = t.conversations.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("h"))
    return h.select("conv_id", F.array_join(se.resume_history(F.col("h"), F.lit(2), F.lit("fix")), ",").alias("history"))


@area.query(f"""SELECT k, slot, (e - l)::BIGINT AS start_s, (CASE WHEN d - (e - l) <= 20 THEN d ELSE e END)::BIGINT AS end_s FROM (SELECT *, lag(e - l) OVER (PARTITION BY k ORDER BY slot) AS before FROM (SELECT *, sum(l) OVER (PARTITION BY k ORDER BY slot) AS e FROM
  (SELECT o_orderkey AS k, 15 + o_orderkey % 150 AS d, i::INT AS slot, floor({U.format("'42:' || o_orderkey || ':' || i")} * 11) + 5 AS l FROM orders, range(1, 34) r(i) WHERE i <= ceil((15 + o_orderkey % 150) / 5.0)))) WHERE slot = 1 OR d - before > 20""")
def w23_slots(t):
    return se.slots(t.orders.select(F.col("o_orderkey").alias("k"), (15 + F.col("o_orderkey") % 150).alias("d")), task="k", duration="d").withColumnsRenamed({"start": "start_s", "end": "end_s"})


@area.query(f"""SELECT k, p.part, (CASE part WHEN 'begin' THEN 0 WHEN 'gap' THEN b ELSE b + g END)::BIGINT AS start_s, (CASE part WHEN 'begin' THEN b WHEN 'gap' THEN b + g ELSE b + g + z END)::BIGINT AS end_s, (b + g + z)::BIGINT AS total_duration
  FROM (SELECT o_orderkey AS k, {", ".join(f"floor({U.format(f"'42:' || o_orderkey || ':{part}'")} * 91) + 60 AS {c}" for part, c in (("begin", "b"), ("gap", "g"), ("end", "z")))} FROM orders), (VALUES ('begin'), ('gap'), ('end')) p(part)""")
def w23_gap_structure(t):
    return se.gap_structure(t.orders.select(F.col("o_orderkey").alias("k")), task="k").withColumnsRenamed({"start": "start_s", "end": "end_s"})


MICRO = "list_sum(list_transform(range(1, ({n}) + 1), lambda i: " + picked(U.format("'42:' || l_orderkey || ':' || l_linenumber || ':{side}:' || i"), se.MICRO_SECONDS) + "))"


@area.query(f"""SELECT o, s, (ea - a)::BIGINT AS start_a, ea::BIGINT AS end_a, (eb - b)::BIGINT AS start_b, eb::BIGINT AS end_b FROM (SELECT *, sum(a) OVER w AS ea, sum(b) OVER w AS eb FROM
  (SELECT l_orderkey AS o, l_linenumber AS s, {MICRO.format(n="l_linenumber % 3", side="a")} AS a, {MICRO.format(n="1 + l_linenumber % 2", side="b")} AS b FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) WHERE l_linenumber % 3 > 0) WINDOW w AS (PARTITION BY o ORDER BY s))""")
def w23_parallel_timelines(t):
    steps = t.lineitem.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("s")).distinct().withColumns({"na": F.col("s") % 3, "nb": 1 + F.col("s") % 2})
    return se.parallel_timelines(steps, task="o", step="s", events_a="na", events_b="nb").select("o", "s", "start_a", "end_a", "start_b", "end_b")


@area.query(f"""SELECT o_orderkey AS k, (CASE WHEN u < 0.1 THEN floor(v * 46) + 45 WHEN u < 0.65 THEN floor(v * 281) + 120 WHEN u < 0.95 THEN floor(v * 301) + 400 ELSE floor(v * 401) + 700 END)::BIGINT AS seconds FROM (SELECT o_orderkey, {U.format("'42:' || o_orderkey || ':u'")} AS u, {U.format("'42:' || o_orderkey || ':v'")} AS v FROM orders)""")
def w23_mixed_duration(t):
    k = F.col("o_orderkey")
    return t.orders.select(k.alias("k"), se.mixed_duration(se.draw(42, k, F.lit("u")), se.draw(42, k, F.lit("v"))).alias("seconds"))


@area.query("""SELECT k, array_to_string(list_transform(r[1:3], lambda x: printf('%.2f-%.2fs', x.a / 999.0 * 12, x.b / 999.0 * 12)), ', ') || CASE WHEN len(r) > 3 THEN ', ...' ELSE '' END AS proxy FROM (SELECT k, list({'a': a, 'b': b} ORDER BY a) AS r FROM
  (SELECT k, min(m) AS a, max(m) AS b FROM (SELECT k, m, m - row_number() OVER (PARTITION BY k ORDER BY m) AS g FROM (SELECT DISTINCT user_id AS k, event_id % 1000 AS m FROM events)) GROUP BY k, g) GROUP BY 1)""")
def w24_proxy_ranges(t):
    r = se.islands(t.events.select(F.col("user_id").alias("k"), (F.col("event_id") % 1000).alias("m")), keys=["k"], number="m")
    rows = r.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("r"))
    return rows.select("k", se.proxy_ranges(F.col("r"), F.lit(1000)).alias("proxy"))


# ---- sampling ---------------------------------------------------------------------------


@area.query("""SELECT doc_id, coalesce(quality, toxic, 0)::DOUBLE AS "sort_score~" FROM documents LEFT JOIN labels USING (doc_id) WHERE contains(text, 'e') ORDER BY 2 DESC, 1 LIMIT 50""")
def k1_browse(t):
    rows = t.documents.select("doc_id", "text").join(t.labels, "doc_id", "left")
    return sa.browse(rows, score=["quality", "toxic"], key="doc_id", find="e", text="text", mask="[0-9]+", limit=50).select("doc_id", "sort_score")


@area.query("SELECT doc_id, source FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100")
def k2_validation_sample(t):
    return sa.sample_n(t.documents.select("doc_id", "source"), key="doc_id", n=100)


@area.query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 64")
def k3_first_n(t):
    return sa.first_n(t.documents.select("doc_id", "lang"), key="doc_id", n=64)


@area.query("""SELECT doc_id, source, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) <= round_even(count(*) OVER (PARTITION BY source) * 0.6666666666666666, 0) THEN 'train' ELSE 'test' END AS split FROM documents""")
def k4_train_test_split(t):
    return sa.split_by_task(t.documents.select("doc_id", "source"), task="source", key="doc_id")


@area.query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem, (SELECT avg(l_quantity) AS a, avg(l_extendedprice) AS b FROM lineitem WHERE l_linestatus = 'F') WHERE l_linestatus = 'F' ORDER BY (l_quantity - a) * (l_extendedprice - b) DESC, l_orderkey, l_linenumber, l_partkey LIMIT (SELECT greatest(1, (count(*) * 0.01)::BIGINT) FROM lineitem WHERE l_linestatus = 'F')""".replace("(count(*) * 0.01)::BIGINT", "floor(count(*) * 0.01)::BIGINT"))
def k5_top_covariance(t):
    rows = t.lineitem.withColumn("m", F.col("l_linestatus") == "F")
    return sa.top_covariance(rows, a="l_quantity", b="l_extendedprice", mask="m", ratio=0.01, order=["l_orderkey", "l_linenumber", "l_partkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@area.query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, (l_quantity - avg(l_quantity) OVER ()) * (l_extendedprice - avg(l_extendedprice) OVER ()) AS c, count(*) OVER () AS n FROM lineitem WHERE l_linestatus = 'F') WHERE c > 1 AND c < 200000 AND l_returnflag <> 'R'
  QUALIFY row_number() OVER (ORDER BY md5('42:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey), l_orderkey, l_linenumber, l_partkey, l_suppkey) <= greatest(1, floor(n * 0.02))""")
def k5_clip_covariance(t):
    rows = t.lineitem.withColumns({"m": F.col("l_linestatus") == "F", "c": F.col("l_returnflag") == "R"})
    got = sa.clip_covariance(rows, a="l_quantity", b="l_extendedprice", mask="m", ratio=0.02, low=1.0, high=200_000.0, order=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], clipped="c")
    return got.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@area.query(f"""SELECT k AS draw, o_orderkey FROM (SELECT k, {U.format("'42:' || k")} AS u FROM range(500) r(k)) JOIN (SELECT o_orderkey, (e - w) / t AS a, e / t AS b FROM (SELECT o_orderkey, w, sum(w) OVER (ORDER BY o_orderkey) AS e, sum(w) OVER () AS t FROM (SELECT o_orderkey, (o_totalprice / 1000) ** 2 + 1e-8 AS w FROM orders))) ON u >= a AND u < b""")
def k6_resample(t):
    return sa.resample(t.orders.select("o_orderkey", (F.col("o_totalprice") / 1000).alias("s")), key="o_orderkey", score="s", n=500).select("draw", "o_orderkey")


ORDERS = "WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders)"


def indexed(t):
    return sa.indexed(t.orders.select("o_orderkey"), key="o_orderkey")


@area.query("SELECT o_orderkey, k::INT AS copy, k * (SELECT count(*) FROM o) + i AS position FROM o, range(3) r(k)", with_=ORDERS)
def k7_repeat_rows(t):
    return sa.repeat_rows(indexed(t), 3, index="i", interleave=False).drop("i")


@area.query("SELECT o_orderkey, i, false AS is_pad FROM o UNION ALL SELECT o_orderkey, i + (SELECT count(*) FROM o), true FROM o WHERE i < (SELECT (-count(*) % 7 + 7) % 7 FROM o)", with_=ORDERS)
def k7_pad_to_divisor(t):
    return sa.pad_to_divisor(indexed(t), index="i", divisor=7)


@area.query("SELECT o_orderkey, i // 128 AS batch FROM o", with_=ORDERS)
def k8_batches(t):
    return sa.batches(indexed(t), index="i", size=128).drop("i")


@area.query('SELECT i // 8 AS "group", o_orderkey FROM o', with_=ORDERS)
def k9_fold_unfold(t):
    return sa.unfold(sa.fold(indexed(t), group=F.floor(F.col("i") / 8), order=["i"], values=["o_orderkey"])).drop("i")


BAL = """WITH g AS (SELECT doc_id, count(*) AS n_rows, sum(n_chars)::BIGINT AS tokens, sum(n_chars * 24576 + n_chars * n_chars)::BIGINT AS workload FROM documents GROUP BY 1),
  r AS (SELECT *, row_number() OVER (ORDER BY workload DESC, doc_id) - 1 AS i FROM g),
  k AS (SELECT greatest(1, least(count(*), ceil(sum(n_chars) / 100000.0)))::BIGINT AS k FROM documents),
  s8 AS (SELECT doc_id, n_rows, tokens, workload, CASE WHEN (i // 8) % 2 = 0 THEN i % 8 ELSE 7 - i % 8 END::INT AS shard FROM r)"""


@area.query("SELECT * FROM s8", with_=BAL)
def k10_balanced_shards(t):
    return sa.balanced_shards(t.documents, group="doc_id", length="n_chars", shards=8)


@area.query("""SELECT min(s)::BIGINT AS min, max(s)::BIGINT AS max, (max(s) - min(s))::BIGINT AS diff, avg(s) AS "mean~" FROM (SELECT sum(tokens) AS s FROM s8 GROUP BY shard)""", with_=BAL)
def a26_length_imbalance(t):
    return sa.imbalance(sa.balanced_shards(t.documents, group="doc_id", length="n_chars", shards=8), load="tokens")


@area.query("SELECT doc_id, n_rows, tokens, workload, CASE WHEN (i // k) % 2 = 0 THEN i % k ELSE k - 1 - i % k END::INT AS shard FROM r, k", with_=BAL)
def k11_token_budget_shards(t):
    return sa.token_budget_shards(t.documents, key="doc_id", length="n_chars", budget=100_000, strict=False)  # texts may be longer than a shard


@area.query("SELECT doc_id, tokens FROM g ORDER BY doc_id", with_=BAL)
def k12_restore_order(t):
    return sa.restore_order(sa.balanced_shards(t.documents, group="doc_id", length="n_chars", shards=8).select("doc_id", "tokens"), index="doc_id")


@area.query("SELECT doc_id % 16 AS shard, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def k13_worker_shard(t):
    return t.documents.groupBy(sa.worker_shard(F.col("doc_id"), 16).alias("shard")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


# ---- set operations ------------------------------------------------------------------------


@area.query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM (SELECT o_orderkey, o_custkey, o_orderstatus, NULL::DOUBLE AS o_totalprice FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, NULL, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'F')")
def u1_concat(t):
    return so.concat(t.orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_orderstatus"), t.orders.filter("o_orderstatus <> 'F'").select("o_orderkey", "o_orderstatus", "o_totalprice"))


@area.query("SELECT o_custkey AS key, count(DISTINCT o_orderstatus) AS n_values FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def u1_meta_conflicts(t):
    return so.meta_conflicts(t.orders.select(F.col("o_custkey").alias("key"), "o_orderstatus"), key="key", value="o_orderstatus")


@area.query("SELECT doc_id, n_chars FROM documents UNION ALL SELECT doc_id + 1000000, n_chars + 50 FROM documents WHERE n_chars + 50 <= 500")
def u2_append_filtered(t):
    d = t.documents.select("doc_id", "n_chars")
    return so.append_filtered(d, d.select((F.col("doc_id") + 1_000_000).alias("doc_id"), (F.col("n_chars") + 50).alias("n_chars")), length=F.col("n_chars"), limit=500)


@area.query("""SELECT o, array_to_string(list_filter(range(1, 6), lambda x: NOT list_contains(k, x)), ',') AS missing, array_to_string(list_sort(list_distinct(list_filter(k, lambda x: x > 5))), ',') AS unknown, len(k) <> len(list_distinct(k)) AS repeated FROM (SELECT l_orderkey AS o, list(l_linenumber) AS k FROM lineitem GROUP BY 1)""")
def u3_membership(t):
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("o")).agg(F.collect_list("l_linenumber").alias("k"))
    out = so.membership(rows, answer=F.col("k"), ids=F.sequence(F.lit(1), F.lit(5)))
    return out.select("o", F.array_join("missing", ",").alias("missing"), F.array_join(F.array_sort("unknown"), ",").alias("unknown"), "repeated")


@area.query("""SELECT doc_id, (quality = 1 AND toxic = 0) OR (quality = 0 AND toxic = 1) AS same FROM labels""")
def u4_set_equality(t):
    from ..functions.answers import same_set

    pred = F.when(F.col("quality") == 1, F.array(F.lit("B"), F.lit("A"), F.lit("B"))).otherwise(F.array(F.lit("C")))
    truth = F.when(F.col("toxic") == 0, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array(F.lit("C"), F.lit("C")))
    return t.labels.select("doc_id", same_set(pred, truth).alias("same"))


@area.query("SELECT source, doc_id, lang, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1")
def u5_first_seen(t):
    return so.first_seen(t.documents.select("source", "doc_id", "lang", "n_chars"), keys=["source"], order="doc_id")


@area.query("SELECT l_orderkey, count(*) = count(DISTINCT l_partkey) AS is_distinct FROM lineitem GROUP BY 1")
def u6_distinct_files(t):
    rows = t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("p"))
    return rows.select("l_orderkey", so.all_distinct(F.col("p")).alias("is_distinct"))


@area.query("""SELECT user_id, count(DISTINCT v) FILTER (layer = 2) AS covered, coalesce(array_to_string(list_sort(list(DISTINCT v) FILTER (layer = 2)), ','), '') AS entities, bool_or(layer = 1) AS has_layer1, bool_or(layer = 2) AS has_layer2, bool_or(layer = 3) AS has_focus FROM (SELECT user_id, event_type AS v, 1 + event_id % 3 AS layer FROM events) GROUP BY 1""")
def a27_stage_coverage(t):
    e = t.events.withColumn("layer", 1 + F.col("event_id") % 3)
    return ev.stage_coverage(e, key="user_id", entity="event_type", stage="layer", covered_by=2, flags={"has_layer1": 1, "has_layer2": 2, "has_focus": 3}).withColumn("entities", F.array_join("entities", ","))


QUERIES, ORACLE_SQL = area.queries, area.sql
