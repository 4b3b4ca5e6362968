"""Answers and scores on texts of documents, conversations and orders, with marks put in where the tables have none."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as an
from ..functions import scoring as sc
from ..operators import advantages as adv
from ..operators import evaluation as ev
from .tables import Area

area = Area()
OPTIONS = ["A. eins", "B. zwei", "C. drei"]


@area.query(r"""SELECT conv_id, turn, CASE WHEN len(letters) > 0 THEN array_to_string(letters, ',') WHEN lower(clean) = 'zwei' THEN 'B' ELSE replace(lower(clean), 'ß', 'ss') END AS choice FROM (SELECT *,
  list_filter(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN list_position(w, w[i]) = i THEN w[i] END), lambda x: x IS NOT NULL) AS letters FROM (SELECT *,
    list_filter(string_split(regexp_replace(upper(clean), '[^\p{L}\p{N}_]', ' ', 'g'), ' '), lambda x: regexp_matches(x, '^[A-C]$')) AS w
    FROM (SELECT conv_id, turn, trim(regexp_replace(CASE WHEN turn % 7 = 6 THEN ' ZWEI ' ELSE text END, '[ \t\n\x0b\f\r]+', ' ', 'g')) AS clean FROM conversations)))""")
def c1_choice_key(t):
    text = F.when(F.col("turn") % 7 == 6, " ZWEI ").otherwise(F.col("text"))
    return t.conversations.select("conv_id", "turn", an.choice_key(text, F.array(*map(F.lit, OPTIONS))).alias("choice"))


@area.query("SELECT doc_id, array_to_string(regexp_extract_all(text, '[0-9]+'), '->') AS sequence FROM documents")
def c2_sequence_key(t):
    return t.documents.select("doc_id", an.sequence_key(F.col("text")).alias("sequence"))


@area.query("""SELECT doc_id, CASE WHEN a >= 0 AND a < b THEN a END AS "start_s~", CASE WHEN a >= 0 AND a < b THEN b END AS "end_s~" FROM (SELECT doc_id, n[-2]::DOUBLE AS a, n[-1]::DOUBLE AS b FROM
  (SELECT doc_id, regexp_extract_all('from ' || n_chars || ' to ' || doc_id || '.5 s, ' || text, '([0-9]+(?:\\.[0-9]+)?)', 1) AS n FROM documents))""")
def c3_interval(t):
    text = F.concat(F.lit("from "), F.col("n_chars").cast("string"), F.lit(" to "), F.col("doc_id").cast("string"), F.lit(".5 s, "), F.col("text"))
    return t.documents.select("doc_id", an.interval(text).alias("i")).select("doc_id", F.col("i.start").alias("start_s"), F.col("i.end").alias("end_s"))


IOU = """WITH p AS (SELECT event_id, s, e, lead(s) OVER w AS s2, lead(e) OVER w AS e2 FROM (SELECT event_id, user_id, ts, value AS s, value + event_id % 40 AS e FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id))"""


def spans(t):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("s", "event_id")
    e = t.events.select("event_id", "user_id", F.col("value").alias("s"), (F.col("value") + F.col("event_id") % 40).alias("e"))
    return e.select("event_id", "s", "e", F.lead("s").over(w).alias("s2"), F.lead("e").over(w).alias("e2"))


@area.query("""SELECT event_id, CASE WHEN greatest(e, e2) - least(s, s2) > 0 THEN greatest(least(e, e2) - greatest(s, s2), 0) / (greatest(e, e2) - least(s, s2)) ELSE 0 END AS "iou~" FROM p WHERE s2 IS NOT NULL""", with_=IOU, digits=5)
def c4_interval_iou(t):
    return spans(t).filter("s2 is not null").select("event_id", an.interval_iou(F.col("s"), F.col("e"), F.col("s2"), F.col("e2")).alias("iou"))


@area.query("""SELECT avg(CASE WHEN greatest(e, e2) - least(s, s2) > 0 THEN greatest(least(e, e2) - greatest(s, s2), 0) / (greatest(e, e2) - least(s, s2)) ELSE 0 END) AS "mean_iou~", count(*) AS n FROM (SELECT least(s, e) AS s, greatest(s, e) AS e, s2, e2 FROM p WHERE s2 IS NOT NULL)""", with_=IOU)
def a29_mean_interval_iou(t):
    p = spans(t).filter("s2 is not null")
    return p.agg(F.avg(F.coalesce(an.interval_iou(F.least("s", "e"), F.greatest("s", "e"), F.col("s2"), F.col("e2")), F.lit(0.0))).alias("mean_iou"), F.count("*").alias("n"))


@area.query("""SELECT d.doc_id, len(list_filter(p, lambda x: len(x) > 0 AND len(list_intersect(x, w)) >= 0.3 * len(x))) / len(p) AS "coverage~" FROM
  (SELECT doc_id, doc_id % k AS g, list_distinct(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z0-9]+')) AS w FROM documents, n) d JOIN
  (SELECT item_id % k AS g, list(list_distinct(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z0-9]+'))) AS p FROM benchmark, n GROUP BY 1) USING (g)""", with_="WITH n AS (SELECT (count(*) + 9) // 10 AS k FROM benchmark)")
def c5_point_coverage(t):
    k = -(-t.benchmark.count() // 10)  # rubrics of ten points each, and each document answers one of the questions
    docs = t.documents.select("doc_id", "text", (F.col("doc_id") % k).alias("g"))
    return an.rubric_coverage(docs, t.benchmark.select((F.col("item_id") % k).alias("g"), F.col("text").alias("point")), rubric="g", text="text", point="point").select("doc_id", "coverage")


@area.query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN (n_chars % 5 = 0)::INT::DOUBLE WHEN 1 THEN 0.5 WHEN 2 THEN NULL ELSE 1 END AS "score~" FROM documents""")
def c6_task_metric(t):
    k = F.col("doc_id") % 4
    task = F.when(k == 0, "PSS").when(k == 1, "FSA").when(k == 2, "CCQA").otherwise("CC")
    pred = F.when(k == 0, F.concat(F.lit("order 1, 2, "), (F.col("n_chars") % 5).cast("string"))).when(k == 1, F.lit("from 10 to 20 s")).otherwise("Answer: B")
    truth = F.when(k == 0, "1->2->0").when(k == 1, "[10, 30]").otherwise("zwei")
    return t.documents.select("doc_id", sc.task_metric(task, pred, truth, F.array(*map(F.lit, OPTIONS))).alias("score"))


ROUTES = {f"src{k}": ("number", "number-flexible", "qa", "answer-line", "sequence")[k % 5] for k in range(20)}


@area.query("""SELECT source, avg(s) AS "test_score~", count(*) AS n_rows FROM (SELECT source, CASE k WHEN 0 THEN (doc_id % 2 = 0)::INT WHEN 1 THEN (doc_id % 3 = 0)::INT WHEN 2 THEN (doc_id % 2 = 0)::INT WHEN 3 THEN CASE WHEN doc_id % 3 = 0 THEN 1 ELSE -1 END ELSE 0 END AS s
  FROM (SELECT *, substr(source, 4)::INT % 5 AS k FROM documents)) GROUP BY 1""")
def c7_score_dispatch(t):
    return scored(t).groupBy("source").agg(F.avg("score").alias("test_score"), F.count("*").alias("n_rows"))


def scored(t):
    n = F.col("n_chars").cast("string")
    truth = F.when(F.substring("source", 4, 2).cast("int") % 5 == 2, F.lit("The Ünit!")).otherwise(n)
    number = F.concat(F.lit("so\n#### "), F.when(F.col("doc_id") % 2 == 0, n).otherwise("-1"), F.lit(" "), F.when(F.col("doc_id") % 3 == 0, n).otherwise("7.25"))
    text = (F.when(F.substring("source", 4, 2).cast("int") % 5 == 2, F.concat(F.lit("<answer>a ünit</answer>"), F.when(F.col("doc_id") % 2 == 0, F.lit("<answer> an Ünit. </answer>")).otherwise("<answer>no</answer>")))
            .when(F.substring("source", 4, 2).cast("int") % 5 == 3, F.concat(F.lit("thus\nAnswer: $"), F.when(F.col("doc_id") % 3 == 0, n).otherwise("1"), F.lit("$ km"))).otherwise(number))
    rows = t.documents.select("doc_id", "source", "n_chars", text.alias("response"), truth.alias("truth"))
    return rows.withColumn("score", sc.dispatch(F.col("source"), F.col("response"), F.col("truth"), ROUTES))


@area.query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 0.0 WHEN upper(trim(role)) = 'USER' THEN 1.0 ELSE 0.0 END AS "score~" FROM conversations""")
def c8_tool_answer(t):
    obj = F.to_json(F.struct(F.when(F.col("turn") % 3 == 0, "look").otherwise("answer").alias("action"), F.struct(F.concat(F.lit(" "), "role").alias("final_answer")).alias("params")))
    text = F.concat(F.lit('so {"a": "}"} '), F.col("text"), F.lit(" "), obj, F.lit(" end {"))
    return t.conversations.select("conv_id", "turn", sc.tool_answer_score(text, F.lit("user")).alias("score"))


@area.query("""SELECT doc_id, replace(s[-1], ',', '') AS strict, f[-1] AS flexible FROM (SELECT doc_id, regexp_extract_all(x, '#### (-?[0-9.,]+)', 1) AS s, list_filter(regexp_extract_all(x, '-?[0-9.,]+'), lambda v: v NOT IN ('', '.')) AS f
  FROM (SELECT doc_id, right(CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN text || chr(10) || '#### ' || n_chars || '.5 or more' ELSE '#### 7 ' || text END, 300) AS x FROM documents))""")
def c9_last_number(t):
    k, n = F.col("doc_id") % 3, F.col("n_chars").cast("string")
    text = F.when(k == 0, F.col("text")).when(k == 1, F.concat("text", F.lit("\n#### "), n, F.lit(".5 or more"))).otherwise(F.concat(F.lit("#### 7 "), "text"))
    return t.documents.select("doc_id", an.last_number(text).alias("strict"), an.last_number(text, "flexible").alias("flexible"))


@area.query("""SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 0.0 WHEN item_id % 3 = 1 THEN 1.0 ELSE 0.25 END AS "score~" FROM benchmark""")
def c10_qa_score(t):
    tags = F.when(F.col("item_id") % 3 == 2, F.repeat(F.lit("<answer>x</answer>"), F.lit(10))).otherwise("")
    said = F.when(F.col("item_id") % 3 == 0, F.lit("other")).otherwise(F.concat(F.lit("The "), "text", F.lit("!")))
    text = F.concat(tags, F.lit("<answer> "), said, F.lit(" </answer>"))
    return t.benchmark.select("item_id", an.qa_score(text, F.array("text")).alias("score"))


LAST = {0: ("Answer: 3\nthen answer : $x=", "$ minutes"), 1: ("Answer: x + 1", ""), 2: ("ANSWER: \\text{", "}"), 3: ("", ""), 4: ("answer: a \\ldots ", "^{\\circ}"), 5: ("Answer: \\boxed{\\frac1", "}")}


@area.query("""SELECT doc_id, CASE WHEN k IN (0, 2, 4) THEN 1.0 ELSE -1.0 END AS "score~", k IN (0, 2, 4) AS acc, CASE WHEN k IN (0, 2, 4) THEN n_chars::VARCHAR WHEN k = 1 THEN 'x+1' WHEN k = 5 THEN '\\frac{1}{' || left(n_chars::VARCHAR, 1) || '}' || substr(n_chars::VARCHAR, 2) ELSE '[INVALID]' END AS pred
  FROM (SELECT *, doc_id % 6 AS k FROM documents)""")
def c11_answer_line(t):
    n = F.col("n_chars").cast("string")
    said = F.concat("text", F.lit("\n"))  # what was thought before the answer
    text = F.coalesce(*[F.when(F.col("doc_id") % 6 == k, F.concat(said, F.lit(a), F.lit("") if k == 1 else n, F.lit(b))) for k, (a, b) in LAST.items()])
    return t.documents.select("doc_id", an.answer_line_score(text, n).alias("s")).select("doc_id", "s.*")


@area.query("""SELECT doc_id, (doc_id % 3 < 2)::INT::DOUBLE AS "score~" FROM documents""")
def c12_boxed(t):
    k = F.col("doc_id") % 3
    text = F.concat("text", F.lit(" is \\boxed{1}, no, \\boxed{"), F.when(k == 0, "\\dfrac{1}{2}").when(k == 1, "0.5").otherwise("\\frac{1}{{3}}"), F.lit("} "), F.left("lang", F.lit(2)))
    return t.documents.select("doc_id", sc.boxed_score(text, F.lit("1/2")).alias("score"))


@area.query("""SELECT doc_id, s + o AS "reward~", o AS "overlong~" FROM (SELECT doc_id, n_chars % 2 AS s, least(-(n_chars - 1500) / 500.0 * 0.7, 0) AS o FROM documents)""")
def c13_overlong_penalty(t):
    return sc.manager("dapo")(t.documents.select("doc_id", "n_chars"), score=(F.col("n_chars") % 2).cast("double"), length="n_chars", limit=2000, buffer=500, factor=0.7).select("doc_id", "reward", "overlong")


@area.query("""SELECT seq, pos, CASE WHEN pos = max(CASE WHEN mask THEN pos END) OVER (PARTITION BY seq) THEN val ELSE 0 END AS "token_reward~" FROM tok""", with_="""WITH tok AS (SELECT l_orderkey AS seq, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS pos, l_linestatus = 'F' AS mask, l_quantity AS val FROM lineitem)""")
def c14_reward_on_last_token(t):
    from .trajectory import tokens

    return sc.reward_on_last_token(tokens(t), seq="seq", pos="pos", mask="mask", reward="val").select("seq", "pos", "token_reward")


@area.query("""SELECT doc_id, coalesce(TRY_CAST(CASE WHEN doc_id % 3 = 0 THEN 'n/a' ELSE n_chars::VARCHAR END AS DOUBLE), 0) AS "reward~" FROM documents""")
def c15_failed_scores_zero(t):
    said = F.when(F.col("doc_id") % 3 == 0, "n/a").otherwise(F.col("n_chars").cast("string"))
    return sc.manager("prime")(t.documents.select("doc_id", said.alias("said")), score=F.col("said").try_cast("double")).select("doc_id", "reward")


@area.query("""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'C,A' WHEN 1 THEN 'B,D' ELSE '' END AS letters FROM conversations""")
def c16_letters(t):
    text = F.when(F.col("turn") % 3 == 0, '["c", " A", "c", "zz"]').when(F.col("turn") % 3 == 1, "I pick b, then D and B").otherwise("none of these")
    return t.conversations.select("conv_id", "turn", F.array_join(an.letters_in(text), ",").alias("letters"))


@area.query("""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN role WHEN 1 THEN 'it is ' || role ELSE trim(text) END AS answer FROM conversations""")
def c17_answer_field(t):
    text = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("ok "), F.to_json(F.struct(F.col("role").alias("answer"))))).when(F.col("turn") % 3 == 1, F.concat(F.lit("Hm.\nAnswer: it is "), "role", F.lit("\nbye"))).otherwise(F.col("text"))
    return t.conversations.select("conv_id", "turn", an.answer_field(text).alias("answer"))


@area.query("""SELECT doc_id, sha256(trim(regexp_replace(CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))) AS clean, n_chars > 1000 AND NOT contains(left(text, 100), ' ') AS is_frame FROM documents""")
def c18_clean_text(t):
    framed = F.concat(F.lit("<think>a\nb</think>"), an.redact_data_uris(F.col("text")), F.lit("<think></think>"))
    clean = an.squeeze(an.truncate(F.regexp_replace(framed, r"(?s)<think>.*?</think>", ""), 500))
    return t.documents.select("doc_id", F.sha2(clean, 256).alias("clean"), (an.hide_frames(F.col("text")) == "<frame>").alias("is_frame"))


@area.query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'UNCERTAIN: no answer was given.' ELSE 'One. Two! Three? Four. Five.' END AS text, doc_id % 5 <> 0 AS review FROM documents""")
def c19_concise_answer(t):
    text = F.when(F.col("doc_id") % 5 == 0, " ").otherwise(F.concat(F.lit("One.  Two! Three?\nFour. Five. Six "), "lang"))
    return t.documents.select("doc_id", an.concise_answer(text).alias("c")).select("doc_id", "c.*")


@area.query("""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 8.0 WHEN 1 THEN 7.0 END AS "confidence~" FROM conversations""")
def c20_confidence(t):
    said = F.when(F.col("turn") % 3 == 0, '{"a": {"confidence": 0.8}} Confidence: 3, confidence 40').when(F.col("turn") % 3 == 1, "Confidence = 7").otherwise(F.col("role"))
    return t.conversations.select("conv_id", "turn", an.confidence(F.concat("text", F.lit("\n"), said)).alias("confidence"))


@area.query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 138.3 WHEN 1 THEN doc_id END AS "start_s~", CASE doc_id % 3 WHEN 0 THEN 163.5 WHEN 1 THEN doc_id END AS "end_s~" FROM documents""")
def c21_span(t):
    text = F.when(F.col("doc_id") % 3 == 0, "138.3s-163.5s").when(F.col("doc_id") % 3 == 1, F.concat(F.lit("at "), F.col("doc_id").cast("string"))).otherwise("never")
    return t.documents.select("doc_id", an.span(text).alias("s")).select("doc_id", F.col("s.start").alias("start_s"), F.col("s.end").alias("end_s"))


@area.query("""SELECT doc_id, q.* FROM documents JOIN (VALUES (0, 'red cars', 'red', 'same-direction-behind', 'A2', 'A2'), (1, 'people', NULL, 'pass-by', 'B1', 'A1,B1'), (2, 'light blue buses', 'light blue', 'parked-front', 'A3', 'A3'), (3, 'cycles', NULL, 'overtake', 'A1', 'A1'), (4, 'white birds', 'white', '?', NULL, '')) q(k, category, colour, relation, reference, mentioned)
  ON doc_id % 5 = k""".replace("q.*", "category, colour, relation, reference, mentioned"))
def c22_count_clause(t):
    k = F.col("doc_id") % 5
    ask = (F.when(k == 0, "How many red cars are parked in the street behind {A2}?").when(k == 1, "how  many, no, how many people in total who see {A1} does {B1} pass by?").when(k == 2, "How many light blue buses parked in front of {A3}")
           .when(k == 3, "how many cycles does {A1} overtake").otherwise("How many white birds do you see ?"))
    text = F.concat(F.lit("Once {A9} appears, yellow trucks. "), "text", F.lit(" "), ask)  # what comes before the question is not part of it
    return t.documents.select("doc_id", an.count_clause(text).alias("c")).select("doc_id", "c.category", "c.colour", "c.relation", "c.reference", F.array_join("c.mentioned", ",").alias("mentioned"))


@area.query("""SELECT doc_id, text || ' left of obj_' || doc_id || ' or obj_' || n_chars || ' {A3}' AS text FROM documents""")
def c23_fill_placeholders(t):
    return t.documents.select("doc_id", an.fill_placeholders(F.concat("text", F.lit(" left of {A1} or {A2} {A3}")), F.array("doc_id", "n_chars")).alias("text"))


@area.query("""SELECT conv_id, turn, CASE turn % 4 WHEN 3 THEN NULL ELSE '{"k":' || turn || '}' END AS json FROM conversations""")
def c24_json_in(t):
    obj = F.to_json(F.struct(F.col("turn").alias("k")))
    k = F.col("turn") % 4
    text = F.when(k == 0, obj).when(k == 1, F.concat("text", F.lit(" so ```json\n"), obj, F.lit("\n``` {x}"))).when(k == 2, F.concat("text", F.lit(" see "), obj, F.lit(" there "), "text")).otherwise(F.concat("text", F.lit("{no")))
    return t.conversations.select("conv_id", "turn", an.json_in(text).alias("json"))


@area.query("""SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":"*","source":"' || source || '"}') AS signature FROM documents""")
def c25_content_signature(t):
    d = t.documents.select("doc_id", "lang", "source", "n_chars")
    return d.select("doc_id", an.content_signature(d.columns, ["n_chars"]).alias("signature"))


@area.query("""SELECT o_orderkey, printf('[%.1f, %.1f]', o_totalprice / 7.7, o_totalprice / 3.1) AS text FROM orders""")
def c26_render_interval(t):
    return t.orders.select("o_orderkey", an.render_interval(F.col("o_totalprice") / 7.7, F.col("o_totalprice") / 3.1).alias("text"))


@area.query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'v2' END AS id FROM documents""")
def c34_named_id(t):
    said = F.when(F.col("doc_id") % 3 == 0, "see v2, v2 and v9").when(F.col("doc_id") % 3 == 1, "v1 or v2").otherwise("none")
    return t.documents.select("doc_id", an.named_id(F.concat(said, F.lit(" "), "text"), F.array(F.lit("v1"), F.lit("v2")), r"\b(v\d+)\b").alias("id"))


@area.query("""SELECT name, total AS "total~", n_values, first AS "first~" FROM (SELECT 'train/' || event_type AS name, round(sum(value), 2) AS total, count(*) AS n_values, arg_min(value, event_id) AS first FROM events GROUP BY 1)""", digits=2)
def c35_prefix_metrics(t):
    e = t.events.withColumn("name", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("train/"), "event_type")).otherwise(F.col("event_type")))
    sums = e.groupBy(ev.prefixed(F.col("name"), "train/").alias("name")).agg(F.round(F.sum("value"), 2).alias("total"))
    both = ev.merged_metrics(sums, sums.filter(F.col("name") > "train/m"), name="name", value="total")  # what both have is equal
    lists = ev.appended(e, name="name", value="value", order=["event_id"], prefix="train/")
    return both.join(lists, "name").select("name", "total", F.size("values").cast("long").alias("n_values"), F.col("values")[0].alias("first"))


@area.query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 0.0 ELSE 2.0 * length(lang) END AS "score~" FROM documents""")
def x1_user_score(t):
    def count(source, text, truth, extra, factor):
        if extra % 4 == 0:
            raise ValueError("this one fails")
        return {"score": factor * len(text), "source": source}

    f = sc.user_score(lambda *a: count(*a, factor=2.0))
    return t.documents.select("doc_id", f(F.col("source"), F.col("lang"), F.lit(""), F.col("doc_id"))["score"].alias("score"))


@area.query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice - CASE WHEN count(*) OVER p > 1 THEN avg(l_extendedprice) OVER p ELSE 0 END AS "advantage~" FROM lineitem WINDOW p AS (PARTITION BY l_orderkey)""")
def x2_registered_advantage(t):
    if "centred" not in adv.ADVANTAGES:
        adv.register_advantage("centred")(lambda df, **o: adv.grpo(df, scaled=False, **o))
    return adv.advantage("centred")(t.lineitem, group="l_orderkey", score="l_extendedprice").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "advantage")


@area.query("""SELECT source, avg(n_chars % 2) AS "naive~", avg(n_chars % 2 + least(-(n_chars - 1500) / 500.0, 0)) AS "dapo~" FROM documents GROUP BY 1""")
def x3_reward_managers(t):
    rows = sc.manager("naive")(t.documents.select("source", "n_chars"), score=(F.col("n_chars") % 2).cast("double")).withColumnRenamed("reward", "first")
    rows = sc.manager("dapo")(rows, score=F.col("first"), length="n_chars", limit=2000, buffer=500, factor=1.0)
    return rows.groupBy("source").agg(F.avg("first").alias("naive"), F.avg("reward").alias("dapo"))


@area.query("""SELECT doc_id, length(text)::DOUBLE AS "reward~" FROM documents""")
def x4_batch_score(t):
    f = sc.batch_score(lambda source, text, truth, extra: [float(len(x)) for x in text])
    return sc.manager("batch")(t.documents, score=f(F.col("source"), F.col("text"), F.lit(""), F.lit(""))).select("doc_id", "reward")


@area.query("""SELECT conv_id, turn, k::INT AS position, role AS name, '{"n": ' || k || '}' AS arguments FROM conversations, range(2) r(k)""")
def x6_tool_calls(t):
    call = lambda n: F.concat(F.lit('<tool_call>{"name": "'), "role", F.lit(f'", "arguments": {{"n": {n}}}}}</tool_call>'))
    text = F.concat(F.lit("hm "), call(0), F.lit("<tool_call>{bad</tool_call> and "), call(1))
    return sc.extract_calls(t.conversations.select("conv_id", "turn", text.alias("t")), text="t", format_="hermes")


QUERIES, ORACLE_SQL = area.queries, area.sql
