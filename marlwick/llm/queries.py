"""The queries of the corpus operators, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, jaccard_join, line_quality, pii, secret_scan, suffix_dedup, token_counts, warc_fixity, wfst_tokenizer
from .common import documents


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(documents(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), wfst_tokenizer.default_model(spark))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = chat_format.conversation_records(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return chat_format.format_chats(records, "conv_id", "record")


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(documents(spark, sf_dir), spark.conf.get("spark.marlwick.pii.key", pii.KEY))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(documents(spark, sf_dir))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(documents(spark, sf_dir))


def op7_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold one copy of the pages.  The second replica is one that a faulty writer made: it cut bodies at 12,000
    characters, and lost pages whose title names no text."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    faulty = pages.where("html IS NULL OR html NOT LIKE '%<title></title>%'").withColumn("html", F.substring("html", 1, 12_000))
    return warc_fixity.audit(pages, faulty)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.line_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wfst_tokenizer.encode_decode(documents(spark, sf_dir), wfst_tokenizer.default_model(spark))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_ngram_jaccard_join, op2_token_counts, op3_chat_format, op4_pii_surrogates, op5_suffix_array_dedup, op6_secret_scan, op7_warc_fixity, op8_benchmark_decontamination, op9_line_quality, op10_sentencepiece)
}

#: The Jaccard join by brute force over n-gram lists, and the classes by following all links.
OP1_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents
  WHERE text IS NOT NULL AND doc_id IS NOT NULL
), grams AS (
  SELECT DISTINCT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s
  FROM w WHERE len(w) > 0
), sets AS (
  SELECT s, min(doc_id) AS first, count(*) AS weight, len(s) AS n FROM grams GROUP BY s
), tokens AS (
  SELECT first, n, unnest(s) AS t FROM sets
), across AS (
  SELECT a.first AS x, b.first AS y
  FROM tokens a JOIN tokens b ON a.t = b.t AND a.first < b.first
  GROUP BY a.first, a.n, b.first, b.n HAVING count(*) / (a.n + b.n - count(*)) >= 0.5 - 1e-12
), links AS (
  SELECT x, y FROM across UNION ALL SELECT y, x FROM across
), reach AS (
  SELECT DISTINCT x AS a, x AS b FROM links UNION SELECT reach.a, links.y FROM reach JOIN links ON reach.b = links.x
), classes AS (
  SELECT a, min(b) AS class_id FROM reach GROUP BY a
), counts AS (
  SELECT x, sum(weight) AS n_links FROM links JOIN sets ON first = y GROUP BY x
)
SELECT doc_id, min(coalesce(class_id, first)) AS class_id, CAST(sum(weight - 1 + coalesce(n_links, 0)) AS BIGINT) AS n_links
FROM grams JOIN sets USING (s) LEFT JOIN classes ON a = first LEFT JOIN counts ON x = first
WHERE weight > 1 OR n_links > 0 GROUP BY doc_id
"""

#: Repeated passages by brute force over all windows of 50 words.
OP5_SQL = """
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents
  WHERE text IS NOT NULL AND doc_id IS NOT NULL
), windows AS (
  SELECT doc_id, s, array_to_string(w[s + 1 : s + 50], ' ') AS passage
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS s FROM w WHERE len(w) >= 50)
), twice AS (
  SELECT passage, min(doc_id) AS first FROM windows GROUP BY passage HAVING min(doc_id) <> max(doc_id)
), hits AS (
  SELECT DISTINCT doc_id, s, first FROM windows JOIN twice USING (passage)
), marked AS (
  SELECT *, CASE WHEN s > 50 + max(s) OVER (PARTITION BY doc_id ORDER BY s, first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM hits
), islands AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s, first ROWS UNBOUNDED PRECEDING) AS island FROM marked
)
SELECT doc_id, CAST(min(s) AS INTEGER) AS start_word, CAST(max(s) + 50 AS INTEGER) AS end_word, min(first) AS first_doc_id
FROM islands GROUP BY doc_id, island
"""

#: Chats by string aggregation.
OP3_SQL = """
SELECT conv_id, ['turns', 'messages', 'conversations', 'data-messages-text', 'conversation-turns-content', 'conversation'][CAST((conv_id % 6 + 6) % 6 + 1 AS INTEGER)] AS layout, CAST(count(*) FILTER (text <> '') AS INTEGER) AS n_turns,
  coalesce(string_agg('<|im_start|>' || coalesce(role, 'user') || chr(10) || replace(text, '<|im_', '< |im_') || '<|im_end|>' || chr(10), ''
    ORDER BY turn, role, text) FILTER (text <> ''), '') AS chat
FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
"""

#: The audit by comparing all records.
OP7_SQL = """
WITH replicas AS (
  SELECT 'a' AS side, page_id, url, html FROM pages UNION ALL
  SELECT 'b', page_id, url, substring(html, 1, 12000) FROM pages WHERE html IS NULL OR html NOT LIKE '%<title></title>%'
), records AS (
  SELECT side, page_id, CAST(floor(page_id / 4096) AS BIGINT) AS file,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
    || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
    || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS r
  FROM replicas WHERE page_id IS NOT NULL
), placed AS (
  SELECT side, page_id, file, r, CAST(sum(strlen(r)) OVER (PARTITION BY side, file ORDER BY page_id, sha256(r) ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop,
    row_number() OVER (PARTITION BY side, file, page_id ORDER BY sha256(r)) AS k FROM records
), a AS (SELECT * FROM placed WHERE side = 'a'), b AS (SELECT * FROM placed WHERE side = 'b')
SELECT coalesce(a.file, b.file) AS file, coalesce(a.page_id, b.page_id) AS page_id,
  CASE WHEN b.r IS NULL THEN 'missing' WHEN a.r IS NULL THEN 'added' ELSE 'altered' END AS status,
  a.stop - strlen(a.r) AS start_a, a.stop AS stop_a, b.stop - strlen(b.r) AS start_b, b.stop AS stop_b
FROM a FULL JOIN b ON a.file = b.file AND a.page_id = b.page_id AND a.k = b.k WHERE a.r IS DISTINCT FROM b.r
"""

ORACLE: dict[str, str] = {
    "op1_ngram_jaccard_join": OP1_SQL,
    "op3_chat_format": OP3_SQL,
    "op5_suffix_array_dedup": OP5_SQL,
    "op7_warc_fixity": OP7_SQL,
}
