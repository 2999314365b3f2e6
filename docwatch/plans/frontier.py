"""Queries of frontier expansion and of times in texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from docwatch.operators import frontier as R
from docwatch.plans.registry import query
from docwatch.session import table

_L = """l0 AS (SELECT 'https://h' || user_id % 10 || '.example.org/p' || event_id % 60 AS src, 'https://h' || user_id % 10 || '.example.org/' || CASE WHEN event_id % 50 = 0 THEN 'login/x' ELSE 'p' || (event_id * 7 + 3 + floor(value)::INT % 9) % 60 END AS dst, event_id FROM events),
l1 AS (SELECT src, dst, min(event_id) AS ord FROM l0 WHERE NOT contains(dst, '/login') GROUP BY 1, 2), l AS (SELECT src, dst, CASE WHEN ord % 6 = 0 THEN 0 ELSE 1 END AS step FROM l1 QUALIFY row_number() OVER (PARTITION BY src ORDER BY ord, dst) <= 3),
s AS (SELECT DISTINCT 'https://h' || user_id % 10 || '.example.org/p0' AS seed FROM events)"""


@query(
    "frontier",
    f"""WITH RECURSIVE {_L}, w AS (SELECT seed, seed AS url, 0 AS depth, 0 AS hops FROM s UNION SELECT w.seed, l.dst, depth + step, hops + 1 FROM w JOIN l ON l.src = w.url WHERE hops < 3 AND depth + step <= 3),
    g AS (SELECT seed, url, arg_min(depth, (hops, depth)) AS depth FROM w GROUP BY 1, 2) SELECT seed, url, depth FROM g QUALIFY row_number() OVER (PARTITION BY seed ORDER BY depth, url) <= 12""",
)
def frontier(spark, sf):
    """The links of all events; three links of a page and twelve pages a seed count, so both budgets bind."""
    e = table(spark, sf, "events")
    c = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    i, host = F.col("event_id"), c("https://h", F.col("user_id") % 10, ".example.org/")
    links = e.select(c(host, "p", i % 60).alias("src"), F.when(i % 50 == 0, c(host, "login/x")).otherwise(c(host, "p", (i * 7 + 3 + F.floor("value").cast("int") % 9) % 60)).alias("dst"), "event_id")
    links = links.groupBy("src", "dst").agg(F.min("event_id").alias("ord")).withColumn("kind", F.when(F.col("ord") % 6 == 0, "pagination").otherwise("link"))
    seeds = e.select(c(host, "p0").alias("url")).distinct()
    return R.frontier_expand(seeds, links, 3, 12, 3)


_DATES = r"(?i)\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2} (?:january|february|march|april|may|june|july|august|september|october|november|december) \d{4}\b|\b\d{1,4} (?:hour|day)s? ago\b"


@query(
    "temporal_mentions",
    rf"""WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'on 2024-01-02 and 3 March 2025. ' WHEN 1 THEN 'some ' || (doc_id % 9 + 1) || ' days ago, ' ELSE '5 March 2023; ' END || text || ' 12 hours ago' AS text FROM documents),
    m AS (SELECT doc_id, unnest(regexp_extract_all(substring(text, 1, 5000), '{_DATES}')[:10]) AS raw FROM t),
    a AS (SELECT doc_id, CASE WHEN raw ILIKE '%hour% ago' THEN TIMESTAMP '2024-06-01' - to_hours(regexp_extract(raw, '\d+')::INT) WHEN raw ILIKE '% ago' THEN TIMESTAMP '2024-06-01' - to_days(regexp_extract(raw, '\d+')::INT)
      WHEN raw LIKE '____-%' THEN try_cast(raw AS TIMESTAMP) ELSE try_strptime(raw, '%-d %B %Y') END AS seen FROM m) SELECT doc_id, min(seen) AS document_time, count(*) AS mentions FROM a GROUP BY 1""",
)
def temporal_mentions(spark, sf):
    """Whole texts, with a date put before and after; the operator looks at its first 5000 characters."""
    i = F.col("doc_id")
    said = F.when(i % 3 == 0, "on 2024-01-02 and 3 March 2025. ").when(i % 3 == 1, F.concat(F.lit("some "), (i % 9 + 1).cast("string"), F.lit(" days ago, "))).otherwise("5 March 2023; ")
    d = table(spark, sf, "documents").select("doc_id", F.concat(said, "text", F.lit(" 12 hours ago")).alias("text"))
    m = R.temporal_mentions(d, F.lit("2024-06-01").cast("timestamp")).groupBy("doc_id").agg(F.min("at").alias("at"), F.count("*").alias("mentions"))
    none = F.lit(None).cast("timestamp")
    return m.select("doc_id", R.document_time(none, none, F.col("at")).cast("timestamp_ntz").alias("document_time"), "mentions")
