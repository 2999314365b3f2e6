"""Inputs of the monitoring, change and message queries, derived from the given tables by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docwatch.session import table

FETCH_OUTCOMES = """SELECT event_id AS outcome_id, ts, concat('d', user_id % 20, '.example.org') AS domain, concat('/', event_type, '/', event_id) AS path,
  CASE WHEN event_id % 4 = 0 THEN 'browser' ELSE 'http' END AS strategy, event_type <> 'error' AS success,
  CASE WHEN event_type <> 'error' THEN 200 WHEN event_id % 5 = 0 THEN 403 WHEN event_id % 5 = 1 THEN 404 WHEN event_id % 5 = 2 THEN 429 WHEN event_id % 5 = 3 THEN 500 END AS status_code,
  CASE WHEN event_type = 'error' AND event_id % 5 = 4 THEN 'connect timeout' END AS error, value * 40 AS latency_ms,
  CASE WHEN event_type <> 'error' THEN CAST(length(props) * 100 AS BIGINT) END AS content_bytes, event_type IN ('view', 'click', 'purchase') AS extraction_ok,
  CASE WHEN event_type IN ('view', 'click', 'purchase') THEN least(value / 100, CAST(1.0 AS DOUBLE)) END AS quality,
  CASE event_type WHEN 'view' THEN 'NEWS_ARTICLE' WHEN 'click' THEN 'FORUM_THREAD' WHEN 'purchase' THEN 'CLASSIFIED_LISTING' END AS page_type FROM {events}"""

SNAPSHOT_PREV = """SELECT doc_id, concat('https://', source, '.example.org/', lang, '/', doc_id) AS normalized_url,
  CASE doc_id % 3 WHEN 0 THEN 'NEWS_ARTICLE' WHEN 1 THEN 'CLASSIFIED_LISTING' ELSE 'UNKNOWN' END AS page_type,
  substring(text, 1, 60) AS title, text AS body, doc_id % 90 + 10 AS price, 'open' AS status FROM {documents}"""

SNAPSHOT_CURR = """SELECT doc_id, concat('https://', source, '.example.org/', lang, '/', doc_id) AS normalized_url,
  CASE doc_id % 3 WHEN 0 THEN 'NEWS_ARTICLE' WHEN 1 THEN 'CLASSIFIED_LISTING' ELSE 'UNKNOWN' END AS page_type,
  CASE WHEN doc_id % 7 IN (1, 4) THEN concat('Updated ', substring(text, 1, 60)) ELSE substring(text, 1, 60) END AS title,
  CASE WHEN doc_id % 7 IN (2, 4) THEN concat(text, chr(10), chr(10), 'Follow up paragraph ', doc_id) WHEN doc_id % 7 = 3 THEN concat('  ', text, chr(10), ' ') ELSE text END AS body,
  CASE WHEN doc_id % 7 = 5 THEN doc_id % 90 + 12 ELSE doc_id % 90 + 10 END AS price, CASE WHEN doc_id % 11 = 0 THEN 'closed' ELSE 'open' END AS status
  FROM {documents} WHERE doc_id % 7 <> 6"""

MESSAGES = """SELECT conv_id AS source_id, turn AS message_id, role AS sender_username, text,
  CASE WHEN conv_id % 5 = 0 THEN NULL ELSE CAST('2024-01-01 00:00:00' AS TIMESTAMP) + turn * INTERVAL '1' MINUTE + conv_id * INTERVAL '1' HOUR END AS message_date,
  CASE WHEN turn % 4 = 3 THEN 'photo' END AS media_type FROM {conversations}"""

POSTS = """SELECT CASE WHEN doc_id % 10 <> 0 THEN concat('p', doc_id % 150) END AS id, CASE WHEN doc_id % 20 <> 0 THEN concat('t3_', doc_id) END AS guid,
  CAST(NULL AS STRING) AS url, source AS subreddit, concat('u', doc_id % 25) AS author, substring(text, 1, 60) AS title, text AS content, CAST(NULL AS STRING) AS flair,
  CASE WHEN doc_id % 13 <> 0 THEN CAST('2024-01-01 00:00:00' AS TIMESTAMP) + doc_id * INTERVAL '1' HOUR END AS published_at, doc_id FROM {documents}"""

EVIDENCE = """SELECT event_id AS evidence_id, user_id % 10 AS case_id,
  CASE event_type WHEN 'view' THEN 'public_web' WHEN 'click' THEN 'maigret' WHEN 'purchase' THEN 'sherlock' WHEN 'signup' THEN 'holehe' ELSE 'phonenumbers' END AS source_name,
  'URL' AS entity_type, concat('https://www.h', event_id % 40, '.example.org/p/', event_id % 200) AS value, ts AS observed_at,
  CASE WHEN event_type = 'error' THEN 'TECHNICAL' ELSE 'PUBLIC_ASSOCIATION' END AS claim_type FROM {events}"""


def bind(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    """Run a binding over the table it reads."""
    return spark.sql(sql, **{name: table(spark, sf_dir, name)})


def duck(sql: str, name: str) -> str:
    """The same binding for DuckDB."""
    return sql.replace("{" + name + "}", name)
