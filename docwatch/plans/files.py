"""Queries of file-like inputs derived from pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from docwatch.functions.text import normalize_text
from docwatch.operators import language as LG
from docwatch.plans.pages_docs import HOST
from docwatch.plans.registry import query
from docwatch.session import table
from docwatch.sources import files as A


@query("artifact_manifest", "SELECT lang || '/' || source || '/' || doc_id || '.html' AS key, sha256(text) AS sha256, octet_length(encode(text))::BIGINT AS size, 'text/html' AS content_type FROM documents")
def artifact_manifest(spark, sf):
    return A.artifact_manifest(table(spark, sf, "documents"), "lang", "source", "doc_id", "text", F.lit("text/html"))


_ROBOTS = rf"SELECT {HOST} AS host, count(*) AS n, min(page_id) AS p FROM pages GROUP BY 1"


@query(
    "robots_rules",
    f"""WITH h AS ({_ROBOTS}) SELECT host, CASE p % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS root_disallowed, CASE WHEN p % 2 = 0 THEN ['https://' || host || '/sitemap.xml'] ELSE [] END AS sitemaps FROM h""",
)
def robots_rules(spark, sf):
    from docwatch.functions import urls as U

    h = table(spark, sf, "pages").groupBy(U.extract_domain(F.col("url")).alias("host")).agg(F.min("page_id").alias("p"))
    k = F.col("p") % 4
    rules = (
        F.when(k == 0, "User-agent: *\nDisallow: /  # all")
        .when(k == 1, "User-agent: *\r\nDisallow: /\r\nUser-Agent: Watcher\r\nDisallow: /private")
        .when(k == 2, "User-agent: *\nDisallow:\nuser-agent: WATCHER\nDisallow: /")
        .otherwise("# nothing\nUser-agent: other\nDisallow: /")
    )
    site = F.when(F.col("p") % 2 == 0, F.concat(F.lit("\nSitemap: https://"), "host", F.lit("/sitemap.xml"))).otherwise("")
    return A.robots_rules(h.select("host", F.concat(rules, site).alias("text")), "watcher")


@query(
    "discovered_urls",
    f"""WITH s AS (SELECT url, page_id AS ord FROM pages), f AS (SELECT {HOST} AS feed, CASE WHEN page_id % 2 = 0 THEN url ELSE url || '/new' END AS url, page_id AS ord FROM pages),
    g AS (SELECT url, ord FROM f QUALIFY row_number() OVER (PARTITION BY feed ORDER BY ord) <= 3), b AS (SELECT url, 0 AS r, ord, 'sitemap' AS origin FROM s UNION ALL SELECT url, 1, ord, 'feed' FROM g)
    SELECT {HOST} AS domain, url, arg_min(origin, (r, ord)) AS origin FROM b GROUP BY url""",
)
def discovered_urls(spark, sf):
    from docwatch.functions import urls as U

    p = table(spark, sf, "pages")
    said = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.concat("url", F.lit("/new")))
    feeds = p.select(U.extract_domain(F.col("url")).alias("feed"), said.alias("url"), F.col("page_id").alias("ord"))
    return A.discovery_union(p.select("url", F.col("page_id").alias("ord")), feeds, 3)


@query(
    "discovery_counts",
    f"""WITH s AS (SELECT url, page_id AS ord FROM pages), f AS (SELECT {HOST} AS feed, CASE WHEN page_id % 2 = 0 THEN url ELSE url || '/new' END AS url, page_id AS ord FROM pages),
    g AS (SELECT url, ord FROM f QUALIFY row_number() OVER (PARTITION BY feed ORDER BY ord) <= 3), b AS (SELECT url, 0 AS r, ord, 'sitemap' AS origin FROM s UNION ALL SELECT url, 1, ord, 'feed' FROM g),
    u AS (SELECT {HOST} AS domain, url, arg_min(origin, (r, ord)) AS origin FROM b GROUP BY url), c AS (SELECT domain, count(*) FILTER (origin = 'sitemap') AS sitemap, count(*) FILTER (origin = 'feed') AS feed FROM u GROUP BY 1)
    SELECT *, CASE WHEN sitemap > 0 AND feed > 0 THEN 'complete' ELSE 'partial' END AS status FROM c""",
)
def discovery_counts(spark, sf):
    return A.discovery_counts(discovered_urls(spark, sf))


@query("languages")
def languages(spark, sf):
    d = table(spark, sf, "documents")
    found = LG.detect_language(d.select("doc_id", "text"), LG.profiles(d.where("doc_id % 2 = 0"), "lang"))
    return d.join(found, "doc_id").groupBy("lang", "language", "route").agg(F.count("*").alias("n"))


@query(
    "kept_oldest",
    r"SELECT lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS body, min(doc_id) AS doc_id FROM documents GROUP BY 1",
)
def kept_oldest(spark, sf):
    from docwatch.operators.fingerprints import keep_oldest

    d = table(spark, sf, "documents").select(normalize_text(F.col("text")).alias("body"), "doc_id")
    return keep_oldest(d, ["body"], ["doc_id"])
