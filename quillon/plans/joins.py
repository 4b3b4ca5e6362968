from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins as jo
from .tables import Area

area = Area()


@area.query("""SELECT conv_id AS doc_id, turn, role, lang, source FROM conversations c LEFT JOIN documents d ON c.conv_id = d.doc_id""")
def j1_lookup(t):
    logs = t.conversations.select(F.col("conv_id").alias("doc_id"), "turn", "role")
    return jo.lookup(logs, t.documents.select("doc_id", "lang", "source"), "doc_id")


@area.query("SELECT doc_id, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j2_resume(t):
    return jo.not_done(t.documents.select("doc_id", "source", "n_chars"), t.labels, key="doc_id")


@area.query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)")
def j3_only_listed(t):
    ids = t.lineitem.filter("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return jo.only_listed(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), ids, key="o_orderkey")


@area.query("""SELECT d.doc_id, coalesce(CASE WHEN quality = 1 THEN 'checked' END, source) AS source, quality, lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def j4_override(t):
    audit = t.labels.select("doc_id", "quality", F.when(F.col("quality") == 1, "checked").alias("source"))
    return jo.override(t.documents.select("doc_id", "lang", "source"), audit, key="doc_id")


@area.query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def j5_union_columns(t):
    return jo.union_columns(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), key="o_orderkey")


EV = """WITH e AS (SELECT event_id, user_id, epoch(ts) AS tm, lead(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events)"""


def timed(t):
    e = t.events.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return e.withColumn("nx", F.lead("at").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))


@area.query("""SELECT p.event_id, i.event_id AS interval_id FROM e p JOIN (SELECT event_id, user_id, tm AS s, nx AS t FROM e WHERE nx IS NOT NULL) i ON p.user_id = i.user_id AND p.tm BETWEEN i.s AND i.t""", with_=EV)
def j6_range_join(t):
    e = timed(t)
    spans = e.filter("nx is not null").select(F.col("event_id").alias("interval_id"), "user_id", F.col("at").alias("s"), F.col("nx").alias("t"))
    return jo.range_join(e.select("event_id", "user_id", "at"), spans, on=["user_id"], at="at", start="s", end="t", width=86400.0).select("event_id", "interval_id")


@area.query("""SELECT c.l_orderkey, c.l_linenumber, c.l_quantity, arg_min(p.o_t, (abs(p.o_t - c.day), p.o_t)) AS nearest_at, arg_min(p.o_orderkey, (abs(p.o_t - c.day), p.o_t)) AS nearest
  FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag AS f, epoch(l_shipdate)::BIGINT AS day FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity, l_returnflag, l_shipdate FROM lineitem)) c
  JOIN (SELECT CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'N' ELSE 'R' END AS f, epoch(o_orderdate)::BIGINT AS o_t, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2) p USING (f)
  GROUP BY c.l_orderkey, c.l_linenumber, c.l_quantity, c.day, c.f""")
def j7_nearest(t):
    sec = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", F.col("l_returnflag").alias("f"), sec("l_shipdate").alias("day")).distinct()
    flag = F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "N").otherwise("R")
    other = t.orders.select(flag.alias("f"), sec("o_orderdate").alias("o_t"), "o_orderkey")
    return jo.nearest(rows, other, by=["f"], left_at="day", right_at="o_t", value="o_orderkey", width=30 * 86400.0).select("l_orderkey", "l_linenumber", "l_quantity", "nearest_at", "nearest")


RANK = """WITH r AS (SELECT l_orderkey AS o, k, row_number() OVER (PARTITION BY l_orderkey ORDER BY q, k) AS a, row_number() OVER (PARTITION BY l_orderkey ORDER BY p, k) AS b
  FROM (SELECT l_orderkey, l_partkey AS k, sum(l_quantity) AS q, sum(l_extendedprice) AS p FROM lineitem GROUP BY 1, 2)),
  f AS (SELECT x.o, x.k AS first, y.k AS second FROM r x JOIN r y ON x.o = y.o AND x.b < y.b AND x.a > y.a)"""


def ranked(t):
    s = t.lineitem.groupBy(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("k")).agg(F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("p"))
    w = Window.partitionBy("o")
    return s.select("o", "k", F.row_number().over(w.orderBy("q", "k")).alias("a"), F.row_number().over(w.orderBy("p", "k")).alias("b"))


@area.query("SELECT o, first, second FROM f", with_=RANK)
def j9_flipped_pairs(t):
    return jo.flipped_pairs(ranked(t), sample="o", item="k", old="a", new="b")


@area.query("SELECT o, first, second FROM f WHERE NOT EXISTS (SELECT 1 FROM r x JOIN r y ON x.o = y.o AND y.a = x.a + 1 WHERE x.o = f.o AND least(x.k, y.k) = least(first, second) AND greatest(x.k, y.k) = greatest(first, second))", with_=RANK)
def j9_uncovered_pairs(t):
    r = ranked(t)
    y = r.select("o", F.col("k").alias("second"), (F.col("a") - 1).alias("a"))
    return jo.uncovered(jo.flipped_pairs(r, sample="o", item="k", old="a", new="b"), r.select("o", F.col("k").alias("first"), "a").join(y, ["o", "a"]), sample="o")


@area.query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'v1' ELSE 'v2' END AS id, n_chars || 's' AS time FROM documents UNION ALL SELECT doc_id, 'v3', '9s' FROM documents""")
def j8_mention_owner(t):
    own = F.when(F.col("doc_id") % 2 == 0, "v1").otherwise("v2")
    text = F.concat("text", F.lit("\nIn "), own, F.lit(" at "), F.col("n_chars").cast("string"), F.lit("s it opens, then much later on it is v3 (9s) that shows it"))
    return jo.mention_owner(t.documents.select("doc_id", text.alias("text")), text="text", ids=r"v\d+", times=r"\d+s")


@area.query("""SELECT p_brand, view, p_partkey, price AS "price~" FROM (SELECT p_brand, p_partkey, view FROM part, (VALUES ('a'), ('b')) v(view)) x
  LEFT JOIN (SELECT p_brand, p_partkey, 'a' AS view, p_retailprice AS price FROM part WHERE p_size % 2 = 0) y USING (p_brand, p_partkey, view)""")
def j10_reference_views(t):
    views = t.spark.createDataFrame([("a",), ("b",)], "view string")
    tracks = t.part.filter("p_size % 2 = 0").select("p_brand", "p_partkey", F.lit("a").alias("view"), F.col("p_retailprice").alias("price"))
    return jo.reference_views(t.part.select("p_brand", "p_partkey"), views, tracks, scene="p_brand", obj="p_partkey", view="view")


MATRIX = """WITH m AS (SELECT s_name AS n_name, b, row_number() OVER (ORDER BY s_name, b) AS k FROM supplier, (SELECT DISTINCT p_brand AS b FROM part))"""


@area.query("SELECT n_name, b, k AS task_id FROM m", with_=MATRIX)
def j11_parameter_matrix(t):
    return jo.parameter_matrix(t.supplier.select(F.col("s_name").alias("n_name")), t.part.select(F.col("p_brand").alias("b")).distinct(), order=["n_name", "b"])


@area.query("SELECT n_name, b, i AS task_id FROM range(1, 1 + (SELECT 3 * count(*) FROM orders)) r(i) JOIN m ON m.k = (i - 1) % (SELECT count(*) FROM m) + 1", with_=MATRIX)
def j11_matrix_quota(t):
    return jo.parameter_matrix(t.supplier.select(F.col("s_name").alias("n_name")), t.part.select(F.col("p_brand").alias("b")).distinct(), order=["n_name", "b"], quota=3 * t.orders.count())


@area.query("""SELECT a.vec_id AS query_id, b.vec_id AS doc_id, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS "score~", row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS rank
  FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 QUALIFY rank <= 10""")
def j12_dense_top_k(t):
    return jo.dense_top_k(t.embeddings.filter("vec_id % 20 = 0"), t.embeddings, k=10, query_id="vec_id", doc_id="vec_id", vector="embedding")


BM = """WITH q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark),
  d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS al FROM d),
  tf AS (SELECT doc_id, l, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS l, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
  dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
  s AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * l / al))) AS score FROM q JOIN tf USING (term) JOIN dfs USING (term), st GROUP BY 1, 2),
  h AS (SELECT item_id AS query_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s QUALIFY rank <= 5)"""


@area.query('SELECT query_id, doc_id, score AS "score~", rank FROM h', with_=BM)
def j13_bm25_top_k(t):
    return jo.bm25_top_k(t.benchmark, t.documents, k=5, query_id="item_id", query="text", doc_id="doc_id", text="text")


@area.query("""SELECT query_id, string_agg('Doc ' || rank || '(Title: ' || split_part(text, chr(10), 1) || ') ' || CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END || chr(10), '' ORDER BY rank) AS passages FROM h JOIN documents USING (doc_id) GROUP BY 1""", with_=BM)
def j14_passages(t):
    return jo.passages(j13_bm25_top_k(t), t.documents, doc_id="doc_id", text="text")


QUERIES, ORACLE_SQL = area.queries, area.sql
