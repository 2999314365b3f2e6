"""Queries over the pages' nodes and over scores of pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from docwatch.operators import pages as P
from docwatch.plans.pages_docs import AUTHORITY, SCHEME
from docwatch.plans.registry import query
from docwatch.session import table


def _nodes(spark, sf):
    return P.dom_nodes(table(spark, sf, "pages"))


@query("dom_nodes")
def dom_nodes(spark, sf):
    return _nodes(spark, sf).groupBy("tag").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"), F.max("depth").alias("deepest"))


@query(
    "page_summaries",
    r"""SELECT page_id, len(regexp_extract_all(html, '<h[123][ >]'))::BIGINT AS headings, len(regexp_extract_all(html, '<script[^>]+src='))::BIGINT AS external_scripts, len(regexp_extract_all(html, '<img[ >]'))::BIGINT AS images,
    len(regexp_extract_all(html, '<iframe[ >]'))::BIGINT AS iframes, contains(html, 'application/ld+json') AS has_json_ld, contains(html, 'property="og:') AS has_open_graph FROM pages""",
)
def page_summaries(spark, sf):
    return P.page_summary(_nodes(spark, sf)).select("page_id", "headings", "external_scripts", "images", "iframes", "has_json_ld", "has_open_graph")


@query(
    "page_links",
    rf"""WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages), l AS (SELECT page_id, {SCHEME} || '://' || {AUTHORITY} || href AS link FROM a WHERE href LIKE '/%')
    SELECT page_id, count(*) AS links, count(DISTINCT link) AS targets, min(link) AS first_link FROM l GROUP BY 1""",
)
def page_links(spark, sf):
    links = P.page_links(_nodes(spark, sf)).where("internal")
    return links.groupBy("page_id").agg(F.count("*").alias("links"), F.countDistinct("link").alias("targets"), F.min("link").alias("first_link"))


@query("document_links", "SELECT page_id, count(*) AS links, 'https://files.example.org/' || page_id || '/5.pdf' AS last_link FROM pages, range(6) r(k) WHERE k <= 5 GROUP BY page_id")
def document_links(spark, sf):
    """Six files of each page, each linked twice, and more than the bound."""
    i = F.col("page_id").cast("string")
    more = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.concat(F.lit('<a href="https://files.example.org/'), i, F.lit("/"), F.floor(k / 2).cast("string"), F.lit('.pdf">f</a>'))), "")
    links = P.page_links(P.dom_nodes(table(spark, sf, "pages").select("page_id", "url", F.concat("html", more).alias("html"))), documents=6).where("document")
    return links.groupBy("page_id").agg(F.count("*").alias("links"), F.max("link").alias("last_link"))


@query("repeated_items", """SELECT page_id, 'li' AS tag, len(regexp_extract_all(html, '<li><a href='))::BIGINT AS items FROM pages WHERE len(regexp_extract_all(html, '<li><a href=')) >= 5""")
def repeated_items(spark, sf):
    return P.repeated_items(_nodes(spark, sf)).select("page_id", "tag", "items")


@query(
    "content_lists",
    "SELECT page_id, 2::BIGINT AS items, (length('First item of page ' || page_id) + length('second item'))::BIGINT AS text_length, CASE WHEN page_id % 2 = 0 THEN 'Part ' || page_id END AS own_heading FROM pages UNION ALL SELECT page_id, 3, (2 * length('See the whole long story behind the number ' || page_id) + 4)::BIGINT, 'Part ' || page_id FROM pages WHERE page_id % 2 = 0",
)
def content_lists(spark, sf):
    # the lists of the given pages are all menus; each page gets lists of items, of long and of short links, and one in a footer
    i, even = F.col("page_id").cast("string"), F.col("page_id") % 2 == 0
    c = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    links = c("<ol><li><a href=/s>See the whole long story behind the number ", i, "</a><li><a href=/t>See the whole long story behind the number ", i, "</a><li>more</ol>")
    more = c(F.when(even, c("<h3>Part ", i, "</h3>")).otherwise(""), "<ul><li>First item of page ", i, "<li>second item</ul><ul><li><a href=/a>Home</a><li><a href=/b>About</a></ul><footer><ul><li>one thing<li>another thing</ul></footer>", F.when(even, links).otherwise(""))
    found = P.page_lists(P.dom_nodes(table(spark, sf, "pages").select("page_id", "url", F.concat("html", more).alias("html"))))
    return found.select("page_id", "items", "text_length", F.when(F.col("heading").startswith("Part "), F.col("heading")).alias("own_heading"))


@query("main_texts")
def main_texts(spark, sf):
    return P.main_text(_nodes(spark, sf)).select("page_id", F.length("text").alias("n_chars"), F.substring("text", 1, 80).alias("begin"))


@query("js_dependency", r"""SELECT page_id, regexp_matches(html, 'data-reactroot|__NEXT_DATA__') AS hydrated FROM pages""")
def js_dependency(spark, sf):
    s = P.page_summary(_nodes(spark, sf)).join(table(spark, sf, "pages").select("page_id", "html"), "page_id")
    return P.js_dependency(s).select("page_id", F.array_contains("js_signals", "hydration").alias("hydrated"))


@query(
    "soft_blocks",
    rf"""WITH p AS (SELECT page_id, html AS h, page_id * 7 % 300 AS n FROM pages), q AS (SELECT page_id, n, CASE page_id % 6 WHEN 0 THEN ' Access Denied ' || h WHEN 1 THEN '<input name=x type="password">' || h WHEN 2 THEN ' Page not found ' || h WHEN 3 THEN ' cookie consent ' || h ELSE h END AS h FROM p)
    SELECT page_id, CASE WHEN regexp_matches(substring(h, 1, 20000), '(?i){P.CHALLENGE.replace("'", "''")}') THEN 'BOT_CHALLENGE' WHEN regexp_matches(substring(h, 1, 20000), '(?i)<input[^>]+type=["'']?password') THEN 'LOGIN_REQUIRED'
    WHEN regexp_matches(substring(h, 1, 20000), '(?i){P.ERROR.replace("'", "''")}') AND n < 240 THEN 'ERROR_PAGE' WHEN regexp_matches(substring(h, 1, 20000), '(?i){P.CONSENT}') AND n < 80 THEN 'CONSENT_WALL' WHEN n < 80 THEN 'THIN_SHELL' ELSE 'REAL_CONTENT' END AS verdict FROM q""",
)
def soft_blocks(spark, sf):
    p = table(spark, sf, "pages")
    k, h = F.col("page_id") % 6, F.col("html")
    more = F.when(k == 0, F.concat(F.lit(" Access Denied "), h)).when(k == 1, F.concat(F.lit('<input name=x type="password">'), h)).when(k == 2, F.concat(F.lit(" Page not found "), h)).when(k == 3, F.concat(F.lit(" cookie consent "), h)).otherwise(h)
    body = F.expr("repeat('x', cast(page_id * 7 % 300 as int))")
    return p.select("page_id", P.soft_block(more, body, F.lit(None).cast("double"))["verdict"].alias("verdict"))


_KINDS = ["thread-5", "news/", "forum", "item/ab-9", "careers/dev-x", "event/y-z", "faq/", "search?q=1", "tags/x/1", "a.pdf", "team", "plain"]
_URLS = f"SELECT doc_id, 'https://' || source || '.example.org/' || {_KINDS}[doc_id % 12 + 1] AS url, n_chars AS text_length, doc_id % 3 AS headings, CASE WHEN doc_id % 10 = 7 THEN 'Event' WHEN doc_id % 17 = 3 THEN 'BlogPosting' END AS schema_type FROM documents"


@query(
    "page_types",
    f"""WITH u AS ({_URLS}) SELECT doc_id, CASE WHEN ends_with(url, '.pdf') THEN 'DOCUMENT' WHEN schema_type = 'BlogPosting' THEN 'BLOG_POST' WHEN schema_type = 'Event' THEN 'EVENT'
    ELSE coalesce(['FORUM_THREAD', 'NEWS_INDEX', 'FORUM_INDEX', 'CLASSIFIED_LISTING', 'JOB', 'EVENT', 'FAQ_PAGE', 'SEARCH_RESULTS', 'CATEGORY', NULL, 'DIRECTORY', NULL][doc_id % 12 + 1], CASE WHEN text_length > 800 AND headings >= 1 THEN 'NEWS_ARTICLE' ELSE 'UNKNOWN' END) END AS page_type FROM u""",
)
def page_types(spark, sf):
    d = table(spark, sf, "documents")
    i = F.col("doc_id")
    url = F.concat(F.lit("https://"), "source", F.lit(".example.org/"), F.element_at(F.array(*map(F.lit, _KINDS)), (i % 12 + 1).cast("int")))
    no = F.lit(None).cast("string")
    schema = F.when(i % 17 == 3, "BlogPosting").when(i % 10 == 7, "Event")
    schema = F.when(i % 10 == 7, "Event").when(i % 17 == 3, "BlogPosting")
    d = d.select("doc_id", url.alias("url"), F.col("n_chars").alias("text_length"), (i % 3).alias("headings"), schema.alias("schema_type"), no.alias("og_type"), F.lit(False).alias("is_seed"), F.lit(0).alias("containers"), no.alias("pattern_hint"))
    return P.classify_pages(d).select("doc_id", "page_type")


@query(
    "quality_scores",
    rf"""WITH d AS (SELECT doc_id, substring(text, 1, 60) AS title, text AS body, length(text) AS n FROM documents),
    p AS (SELECT *, list_filter(string_split(body, chr(10) || chr(10)), lambda x: regexp_matches(x, '\S')) AS parts, least(1.0, len(regexp_extract_all(body, '(?i){P.CONTAMINATION}')) / 5) AS c, length(trim(title)) AS tn FROM d),
    s AS (SELECT doc_id, CASE WHEN tn = 0 THEN 0.0 WHEN tn < 5 THEN 0.2 ELSE 1.0 END AS t, c, (CASE WHEN n >= 200 THEN least(1.0, n / 1500) ELSE n / 200 * 0.5 END * 0.5
      + least(1.0, list_sum(list_transform(parts, lambda x: length(x))) / greatest(len(parts), 1) / 80) * 0.5) * (1 - c) AS b FROM p)
    SELECT doc_id, round_even(t * 0.20 + b * 0.45, 3)::DOUBLE AS overall, round_even(b, 3)::DOUBLE AS body_score, round_even(c, 3)::DOUBLE AS contamination FROM s""",
)
def quality_scores(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.substring("text", 1, 60).alias("title"), F.col("text").alias("body"))
    return P.quality_score(d).select("doc_id", "overall", "body_score", "contamination")


@query(
    "completeness_scores",
    """WITH d AS (SELECT doc_id, n_chars AS b, n_chars + doc_id % 500 AS p, doc_id % 4 * 5 AS l, 20 AS k, doc_id % 2 = 0 AS more FROM documents),
    c AS (SELECT doc_id, more, CASE WHEN l > 0 THEN 1 - greatest(0.0, (k - l) / k) WHEN p <= 0 THEN (b > 0)::INT ELSE least(1.0, b / p) END AS c FROM d)
    SELECT doc_id, round_even(CASE WHEN more THEN c * 0.85 ELSE c END, 3)::DOUBLE AS completeness FROM c""",
)
def completeness_scores(spark, sf):
    i, n = F.col("doc_id"), F.col("n_chars")
    return table(spark, sf, "documents").select("doc_id", P.completeness_score(n, n + i % 500, i % 4 * 5, F.lit(20), i % 2 == 0).alias("completeness"))


@query(
    "render_comparisons",
    """WITH d AS (SELECT doc_id AS url, doc_id % 7 / 100 AS hq, doc_id % 5 / 50 AS bq, n_chars AS hn, n_chars + doc_id % 3 - 1 AS bn FROM documents)
    SELECT url, CASE WHEN bq - hq > 0.02 THEN 'browser_superior' WHEN bq - hq < -0.02 THEN 'http_superior' WHEN bn > hn THEN 'browser_superior' WHEN bn < hn THEN 'http_superior' ELSE 'equivalent' END AS verdict FROM d""",
)
def render_comparisons(spark, sf):
    d = table(spark, sf, "documents")
    i = F.col("doc_id")
    http = d.select(i.alias("url"), F.lit("http").alias("variant"), (i % 7 / 100).alias("quality"), F.col("n_chars").alias("body_length"))
    browser = d.select(i.alias("url"), F.lit("browser").alias("variant"), (i % 5 / 50).alias("quality"), (F.col("n_chars") + i % 3 - 1).alias("body_length"))
    return P.compare_renders(http.unionByName(browser))


@query(
    "extraction_routes",
    """WITH c AS (SELECT doc_id AS url, 'article' AS extractor, false AS fb, n_chars AS n, doc_id % 10 / 10 AS q FROM documents UNION ALL SELECT doc_id, 'generic', true, n_chars, doc_id % 6 / 6 FROM documents)
    SELECT url, extractor FROM c QUALIFY row_number() OVER (PARTITION BY url ORDER BY (NOT fb AND NOT (n < 100 OR q < 0.35)) DESC, q DESC, fb DESC, extractor) = 1""",
)
def extraction_routes(spark, sf):
    d = table(spark, sf, "documents")
    i = F.col("doc_id")
    row = lambda name, fb, q: d.select(i.alias("url"), F.lit(name).alias("extractor"), F.lit(fb).alias("is_fallback"), F.col("n_chars").alias("body_length"), q.alias("quality"), F.lit(0.0).alias("contamination"))
    return P.route_extract(row("article", False, i % 10 / 10).unionByName(row("generic", True, i % 6 / 6))).select("url", "extractor")
