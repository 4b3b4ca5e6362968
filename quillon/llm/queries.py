"""The operators of this subpackage over the whole of their tables: queries and, where DuckDB can say the same, SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import align
from .bpe import bpe_encode
from .embedding_dedup import embedding_dedup
from .exact_dedup import exact_dedup
from .language_id import language_id
from .mixing import mix
from .pitman_yor import lm_score
from .prefix_trie import prefix_trie, turn_sequences, with_shared_starts
from .simhash_dedup import simhash_dedup
from .substring_dedup import substring_dedup
from .token_counts import token_counts
from .toxicity import toxicity
from .warc import warc_round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), width=35)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op3_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents"), folds=7, held_fold=2)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"), shingle=3, radius=3)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), weights=(3.0, 1.0, 2.0), share=1.5, epochs=2.0)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"), folds=5)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"), min_bytes=0)


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"), threshold=0.98, target=1.0)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=5)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(with_shared_starts(turn_sequences(table(spark, sf_dir, "conversations")), every=5, most=9))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_substring_dedup, op2_token_counts, op3_pitman_yor, op4_exact_dedup, op5_simhash_dedup,
        op6_bpe, op7_mixing, op8_language_id, op9_warc, op10_embedding_dedup, op11_alignment, op12_toxicity, op13_prefix_trie)
}

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS p FROM docs WHERE len(w) >= 35),
windows AS (SELECT s.doc_id, s.p, array_to_string(d.w[s.p : s.p + 34], ' ') AS k FROM starts s JOIN docs d USING (doc_id)),
twice AS (SELECT k FROM windows GROUP BY k HAVING count(*) > 1),
covered AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS p FROM windows SEMI JOIN twice USING (k)),
gone AS (SELECT doc_id, list(p) AS g FROM covered GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN g IS NULL THEN array_to_string(w, ' ')
                   ELSE coalesce(array_to_string(list_filter(w, lambda x, i: NOT list_contains(g, i)), ' '), '') END) AS kept_sha256
FROM docs LEFT JOIN gone USING (doc_id)""",
    "op4_exact_dedup": """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, h AS text_sha256
FROM d WINDOW g AS (PARTITION BY h)""",
    "op7_mixing": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS turn FROM d GROUP BY source),
w AS (SELECT *, CASE turn % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0 ELSE 2.0 END AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
held AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_caps,
                sum(weight) OVER (ORDER BY cap / weight, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM w),
level AS (SELECT min_by(((SELECT sum(source_size) FROM s)::DOUBLE * 1.5 - full_caps) / open_weight, cap / weight) AS lam FROM held
          WHERE weight * (((SELECT sum(source_size) FROM s)::DOUBLE * 1.5 - full_caps) / open_weight) <= cap),
t AS (SELECT source, source_size, round(CASE WHEN lam IS NULL THEN cap ELSE least(cap, weight * lam) END, 6) AS target FROM w, level),
p AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS times FROM t),
q AS (SELECT *, CAST(round(target - times * source_size) AS BIGINT) AS part FROM p),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('7:' || CAST(doc_id AS VARCHAR)), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT doc_id, size, source_size, target, CAST(times * size + least(size, greatest(0, part - before)) AS BIGINT) AS taken
FROM o JOIN q ON o.source IS NOT DISTINCT FROM q.source""",
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
b AS (SELECT page_id, strlen(h) AS n, h,
             array_to_string(list_transform(string_split_regex(sha1(h), ''), lambda c: lpad(bin(CAST('0x' || c AS INTEGER)), 4, '0')), '') AS bits FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM b)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + list_sum(list_transform(range(5), lambda j: CAST(substr(bits, k * 5 + j + 1, 1) AS INTEGER) * (1 << (4 - j))))::INTEGER, 1)), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM r""",
    "op10_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low.b, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low.b, vec_id)) AS kept
FROM embeddings LEFT JOIN low ON vec_id = low.a LEFT JOIN n ON vec_id = n.a""",
    "op13_prefix_trie": """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(sha256(strlen(role) || ':' || role || text) || strlen(text) ORDER BY turn NULLS FIRST) AS s FROM t GROUP BY conv_id),
crc AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
          lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) AS crc FROM own),
built AS (SELECT o.conv_id, list_concat(coalesce(d.s, [])[1 : CAST(crc % 9 AS INTEGER)], o.s[CAST(crc % 9 AS INTEGER) + 1 :]) AS s
          FROM own o JOIN crc c USING (conv_id) LEFT JOIN own d ON d.conv_id = o.conv_id - o.conv_id % 5),
p AS (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM built),
named AS (SELECT conv_id, d, d = len(s) AS ends, array_to_string(s[1 : d], '/') AS name, CASE WHEN d > 0 THEN array_to_string(s[1 : d - 1], '/') END AS up,
                 CASE WHEN d > 0 THEN CAST(substr(s[d], 65) AS BIGINT) ELSE 0 END AS size, list_transform(range(0, d + 1), lambda k: array_to_string(s[1 : k], '/')) AS above FROM p),
node AS (SELECT name, d, min(conv_id) AS conv_id, any_value(up) AS up, count(*) AS n, (count(*) - 1) * any_value(size) AS worth, any_value(above) AS above,
                sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM named GROUP BY name, d),
kids AS (SELECT up AS name, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY up, d),
over AS (SELECT a.name, a.d, a.worth, k.n IS NULL AS leaf, unnest(a.above) AS top, unnest(range(0, a.d + 1)) AS top_d FROM node a LEFT JOIN kids k ON k.name = a.name AND k.d = a.d),
sums AS (SELECT top, top_d, CAST(sum(worth) AS BIGINT) AS saved, count(*) FILTER (WHERE leaf) AS leaves FROM over GROUP BY top, top_d)
SELECT x.conv_id, x.d AS depth, u.conv_id AS parent_conv_id, x.n AS n_convs, coalesce(k.n, 0) AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, x.ends_sha256
FROM node x JOIN sums s ON s.top = x.name AND s.top_d = x.d LEFT JOIN node u ON u.name = x.up AND u.d = x.d - 1 LEFT JOIN kids k ON k.name = x.name AND k.d = x.d""",
}
