from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import quality as qu
from .tables import Area

area = Area()


@area.query("""SELECT CASE k WHEN 0 THEN 'CC' WHEN 1 THEN 'FSA' WHEN 2 THEN 'PEA' ELSE 'XX' END || '-' || doc_id AS sample_id, CASE WHEN k = 3 THEN 'task: unknown XX' WHEN k = 1 AND n_chars < 500 THEN 'intervals: not ordered' WHEN k = 2 AND n_chars % 2 = 0 THEN 'begin, end: lengths differ' ELSE '' END AS errors, k::BIGINT AS k
  FROM (SELECT *, doc_id % 4 AS k FROM documents)""")
def f1_canonical_samples(t):
    k = F.col("doc_id") % 4
    task = F.when(k == 0, "CC").when(k == 1, "FSA").when(k == 2, "PEA").otherwise("XX")
    clip = F.when(F.col("n_chars") % 2 == 0, F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(2.0)))
    none = lambda kind: F.lit(None).cast(kind)
    raw = t.documents.select(
        task.alias("task"), F.col("doc_id").alias("id"), F.lit("which?").alias("question"), F.array("lang", "source").alias("videos"), F.array(F.lit("A. x"), F.lit("B. y")).alias("options"), F.lit("A").alias("answer"),
        F.lit("a").alias("video_a"), F.lit("b").alias("video_b"), clip.alias("begin"), F.transform(clip, lambda x: x + 3).alias("end"), F.array(F.lit(500.0), F.col("n_chars").cast("double") + 1).alias("ref_segment"), none("array<array<double>>").alias("segments"), F.lit(1).alias("vid"))
    return qu.canonical_samples(raw).select("sample_id", F.array_join("errors", "; ").alias("errors"), F.when(F.col("task") == "CC", 0).when(F.col("task") == "FSA", 1).when(F.col("task") == "PEA", 2).otherwise(3).cast("long").alias("k"))


@area.query("""SELECT doc_id, source, array_to_string(list_filter([CASE WHEN doc_id % 7 = 0 THEN 'title: empty' END, CASE WHEN n_chars < 300 THEN 'a, b: not an interval' END, CASE WHEN lang = source THEN 'x' END], lambda x: x IS NOT NULL), '; ') AS errors
  FROM documents WHERE doc_id % 7 = 0 OR n_chars < 300""")
def f2_quarantine(t):
    rows = t.documents.withColumns({"title": F.when(F.col("doc_id") % 7 == 0, " ").otherwise(F.col("lang")), "a": F.lit(300), "b": F.col("n_chars") + 1, "list": F.array("lang", "source")})
    return qu.quarantined(qu.check(rows, qu.required_string("title"), qu.ordered_interval("a", "b"), qu.string_list("list"))).select("doc_id", "source", F.array_join("errors", "; ").alias("errors"))


@area.query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id % 7 <> 0 AND n_chars >= 300")
def f2_passed(t):
    rows = t.documents.withColumns({"title": F.when(F.col("doc_id") % 7 == 0, " ").otherwise(F.col("lang")), "a": F.lit(300), "b": F.col("n_chars") + 1})
    return qu.passed(qu.check(rows, qu.required_string("title"), qu.ordered_interval("a", "b"))).select("doc_id", "lang", "n_chars")


@area.query("SELECT l_orderkey AS uid, l_quantity AS score, l_returnflag FROM lineitem")
def f3_select_rename(t):
    return qu.select_keys(t.lineitem, ["l_orderkey", "l_quantity", "l_returnflag"], {"l_orderkey": "uid", "l_quantity": "score"})


@area.query("SELECT o_orderkey, o_totalprice FROM orders, (SELECT min(o_orderkey) AS a FROM orders) WHERE (o_orderkey - a) % 7 = 0")
def f4_select_rows(t):
    ends = t.orders.agg(F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("b")).first()
    return qu.select_rows(t.orders.select("o_orderkey", "o_totalprice"), index="o_orderkey", start=ends.a, stop=ends.b + 1, step=7)


@area.query("SELECT doc_id, source FROM documents WHERE len(string_split_regex(text, '[ \\t\\n\\r]+')) <= 300")
def f5_filter_long(t):
    return qu.filter_long(t.documents, length=F.size(F.split("text", r"[ \t\n\r]+")), limit=300).select("doc_id", "source")


@area.query("""SELECT doc_id, array_to_string(w[1:20], ' ') || repeat(' <pad>', 20 - least(len(w), 20)::INT) AS ids, least(len(w), 20)::BIGINT AS attended, greatest(least(len(w), 20) - 1 - 3, 0)::BIGINT AS trained FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)""")
def f6_fit_ids(t):
    out = qu.fit_ids(t.documents.select("doc_id", F.split("text", " ").alias("ids"), F.lit(3).alias("p")), ids="ids", limit=20, pad=F.lit("<pad>"), prompt_length="p")
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("doc_id", F.array_join("ids", " ").alias("ids"), total("attention_mask").alias("attended"), total("loss_mask").alias("trained"))


@area.query("""SELECT doc_id, coalesce(list_min(list_filter([list_position(l, 2), list_position(l, 7)], lambda x: x > 0)), len(l))::BIGINT AS kept FROM (SELECT doc_id, list_transform(string_split(text, ' '), lambda x: length(x)) AS l FROM documents)""")
def f7_response_mask(t):
    ids = F.transform(F.split("text", " "), F.length)
    return t.documents.select("doc_id", F.aggregate(qu.response_mask(ids, [2, 7]), F.lit(0).cast("long"), lambda a, x: a + x).alias("kept"))


TURNS = """WITH c AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' AND turn % 4 = 3 THEN '[DIAGNOSIS] ' ELSE '' END || text AS text FROM conversations)"""


def turns(t):
    mark = F.when((F.col("role") == "user") & (F.col("turn") % 4 == 3), "[DIAGNOSIS] ").otherwise("")
    return t.conversations.select("conv_id", "turn", "role", F.concat(mark, "text").alias("text"))


@area.query("""SELECT conv_id, turn, role, text FROM c a WHERE NOT (role = 'user' AND contains(text, '[DIAGNOSIS]')) AND NOT (role = 'assistant' AND coalesce((SELECT role = 'user' AND contains(text, '[DIAGNOSIS]') FROM c b WHERE b.conv_id = a.conv_id AND b.turn = (SELECT min(turn) FROM c d WHERE d.conv_id = a.conv_id AND d.turn > a.turn AND d.role <> 'assistant')), false))""", with_=TURNS)
def f8_strip_corrections(t):
    return qu.strip_corrections(turns(t), conv="conv_id", turn="turn", role="role", text="text")


@area.query("""SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'user' ELSE role END AS role, CASE WHEN role = 'system' THEN '[TOOL OBSERVATION]' || chr(10) ELSE '' END || coalesce(text, '') AS content FROM conversations""")
def f9_training_messages(t):
    role = F.when(F.col("role") == "system", "tool").otherwise(F.col("role"))
    return t.conversations.select("conv_id", "turn", qu.to_training_message(role, F.col("text")).alias("m")).select("conv_id", "turn", "m.*")


@area.query(r"""SELECT conv_id, turn, prompt_kind FROM (SELECT *, CASE WHEN regexp_matches(p, '\bhow many\b|\bcount\b') THEN 'count' WHEN regexp_matches(p, '\bwhen\b|\btime\b') THEN 'time' WHEN regexp_matches(p, '^(is|are|does|do|did|was|were|has|have|can)\b') THEN 'yes_no'
  WHEN regexp_matches(p, '\bwhich\b|\bwhat\b|\bwho\b|\bwhere\b') THEN 'what' END AS prompt_kind FROM (SELECT conv_id, turn, lower(['How many red cars pass?', 'Is the door open?', 'Survey: what is there?', 'Please look.', 'Please look.'][turn % 5 + 1] || chr(10) || text) AS p FROM conversations))
  WHERE prompt_kind IS NOT NULL AND turn % 2 = conv_id % 2 AND NOT regexp_matches(p, 'survey|overview|describe (all|every)|scan the whole')""")
def f10_mine_tool_questions(t):
    k = F.col("turn") % 5
    prompt = F.when(k == 0, "How many red cars pass?").when(k == 1, "Is the door open?").when(k == 2, "Survey: what is there?").otherwise("Please look.")
    targets = F.when(F.col("turn") % 2 == F.col("conv_id") % 2, F.array(F.lit("v1"))).otherwise(F.array(F.lit("v1"), F.lit("v2")))
    return qu.mine_tool_questions(t.conversations.select("conv_id", "turn", F.concat(prompt, F.lit("\n"), "text").alias("p"), targets.alias("t")), targets="t", prompt="p").select("conv_id", "turn", "prompt_kind")


@area.query("""SELECT d.doc_id, b.item_id FROM documents d, benchmark b WHERE contains(d.text, trim(b.text))""")
def f11_leaked_answers(t):
    return qu.leaked_answers(t.documents, t.benchmark, doc_id="doc_id", doc_text="text", item_id="item_id", item_text="text")


@area.query("SELECT doc_id, contains(text, trim(' ' || lang || ' ')) AS leaked FROM documents")
def f11_answer_in_prompt(t):
    return qu.answer_in_prompt(t.documents.withColumn("truth", F.concat(F.lit(" "), "lang", F.lit(" "))), prompt="text", truth="truth").select("doc_id", "leaked")


@area.query("SELECT doc_id, lang AS question FROM documents")
def f12_inference_payload(t):
    return qu.inference_payload(t.documents.select("doc_id", F.col("lang").alias("question"), F.col("source").alias("answer")))


@area.query("""SELECT event_id, CASE WHEN d > 45 + 1e-6 THEN 'OVERLONG' WHEN d < 6 - 1e-6 THEN 'UNDERSHORT' ELSE 'NORMAL' END AS band FROM (SELECT event_id, value AS d FROM events)""")
def f13_duration_band(t):
    return t.events.select("event_id", qu.duration_band(F.lit(0.0), F.col("value")).alias("band"))


@area.query("""SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN 'out of range' WHEN turn % 5 = 1 THEN 'repeated' WHEN turn % 5 = 2 THEN 'missing' WHEN turn % 5 = 3 THEN 'confidence too low' END AS issue, turn % 5 = 4 AS ok FROM conversations""")
def f14_order_check(t):
    k = F.col("turn") % 5
    rows = t.conversations.select("conv_id", "turn", F.when(k == 0, "1->2->9").when(k == 1, "1, 2, 2, 3").when(k == 2, "3 1").otherwise("3->1->2").alias("a"), "text", F.lit(3).alias("n"), F.when(k == 3, 5.0).otherwise(9.0).alias("c"))
    rows = rows.withColumn("a", F.concat("text", F.lit("\nSo: "), "a"))
    return qu.order_check(rows, answer="a", n="n", confidence="c").select("conv_id", "turn", "issue", "ok")


@area.query("""SELECT event_id, least(value, u) AS "a~", greatest(value, u) AS "b~", CASE WHEN least(value, u) < 0 THEN 'negative' WHEN value = u THEN 'empty' WHEN greatest(value, u) > 60 + 1 THEN 'beyond the end' END AS issue FROM (SELECT *, user_id % 50 - 1.0::DOUBLE AS u FROM events)""")
def f15_interval_check(t):
    rows = t.events.select("event_id", F.col("value").alias("a"), (F.col("user_id") % 50 - 1.0).alias("b"), F.lit(60.0).alias("d"))
    return qu.interval_check(rows, start="a", end="b", duration="d").select("event_id", "a", "b", "issue")


@area.query("""SELECT conv_id, CASE WHEN n > 2 THEN 'more than 2 alternatives; ' ELSE '' END || CASE WHEN n > 6 THEN 'more than 6 factors; ' ELSE '' END || CASE WHEN n > 3 THEN 'unknown video; ' ELSE '' END || 'answered with ambiguities left' AS errors FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)""")
def f16_state_errors(t):
    n = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.col("turn").cast("string"))).alias("x"))
    video = F.concat(F.lit("v"), F.least(F.size("x"), F.lit(4)).cast("string"))
    state = F.struct(F.col("x").alias("alternatives"), F.col("x").alias("factors"), F.array(F.struct(F.array(video).alias("videos"))).alias("ambiguities"), F.lit("answer").alias("decision"), F.lit("A").alias("answer"))
    return n.select("conv_id", F.array_join(qu.state_errors(state, F.array(*[F.lit(f"v{k}") for k in (1, 2, 3)])), "; ").alias("errors"))


@area.query("""SELECT o, array_to_string(list_concat(k, list_filter([1, 2, 3, 4, 5, 6, 7], lambda x: NOT list_contains(k, x))), ',') AS "order", (7 - len(k))::BIGINT AS added
  FROM (SELECT l_orderkey AS o, list(n ORDER BY p, n) AS k FROM (SELECT l_orderkey, l_linenumber AS n, min(l_extendedprice) AS p FROM lineitem GROUP BY 1, 2) GROUP BY 1)""")
def f17_fill_order(t):
    rows = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_extendedprice"), F.col("l_linenumber").cast("int").alias("n")))).alias("x"))
    order, added = qu.fill_order(F.transform("x", lambda s: s["n"]), F.sequence(F.lit(1), F.lit(7)))
    return rows.select(F.col("l_orderkey").alias("o"), F.array_join(order, ",").alias("order"), F.size(added).cast("long").alias("added"))


MARKS = "cannot determine|cannot verify|unable to determine|unable to verify|insufficient evidence|witness: undetermined"


@area.query(f"""SELECT conv_id, turn, CASE WHEN len(list_filter(e, lambda x: NOT (regexp_matches(lower(x), '{MARKS}') OR (contains(lower(x), 'not visible') AND NOT regexp_matches(lower(x), 'qualifying\\s+(instances/events\\s+in\\s+this\\s+view:\\s*|count:\\s*)[0-9]+'))))) = 0 THEN 'A' ELSE 'B' END AS answer
  FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN [text || ' Insufficient evidence.', 'Unable to VERIFY'] WHEN 1 THEN [text || ' door not visible'] WHEN 2 THEN ['not visible, qualifying count: 3 ' || text] ELSE [text, 'cannot determine'] END AS e FROM conversations)""")
def f18_choice_flip(t):
    k, text = F.col("turn") % 4, F.col("text")
    evidence = (F.when(k == 0, F.array(F.concat(text, F.lit(" Insufficient evidence.")), F.lit("Unable to VERIFY"))).when(k == 1, F.array(F.concat(text, F.lit(" door not visible"))))
                .when(k == 2, F.array(F.concat(F.lit("not visible, qualifying count: 3 "), text))).otherwise(F.array(text, F.lit("cannot determine"))))
    return t.conversations.select("conv_id", "turn", qu.gate_choice_flip(F.lit("A"), F.lit("B"), evidence).alias("answer"))


@area.query("""SELECT source, k AS kind, 'Q:' || CASE k WHEN 'chosen' THEN g ELSE b END AS sequence FROM (SELECT source, min(d.doc_id) FILTER (quality = 1)::VARCHAR AS g, min(d.doc_id) FILTER (quality = 0)::VARCHAR AS b FROM documents d JOIN labels USING (doc_id) GROUP BY 1), (VALUES ('chosen'), ('rejected')) v(k)""")
def f19_preference_pairs(t):
    d = t.documents.select("doc_id", "source").join(t.labels, "doc_id")
    pairs = d.groupBy("source").agg(*[F.min(F.when(F.col("quality") == q, F.col("doc_id"))).cast("string").alias(n) for n, q in (("good", 1), ("bad", 0))])
    return qu.preference_pairs(pairs.withColumn("p", F.lit("Q:")), prompt="p", chosen="good", rejected="bad")


@area.query("""SELECT conv_id, turn, 'text:' || text || ',image:<image>,text: and ,video:<video>' || CASE WHEN turn % 2 = 0 THEN ',text:' || text ELSE '' END AS parts, turn % 3 = 0 AS matches FROM conversations""")
def f20_message_parts(t):
    text = F.concat("text", F.lit("<image> and <video>"), F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(""))
    parts = F.transform(qu.message_parts(text), lambda p: F.concat_ws(":", p["type"], p["text"]))
    return t.conversations.select("conv_id", "turn", F.array_join(parts, ",").alias("parts"), qu.media_match(text, F.lit(1), F.when(F.col("turn") % 3 == 0, 1).otherwise(2)).alias("matches"))


QUERIES, ORACLE_SQL = area.queries, area.sql
