"""Queries of structured data, tables and pagination over the pages with a literal block added."""

from __future__ import annotations

from pyspark.sql import functions as F

from docwatch.operators import extraction as X
from docwatch.operators import pages as P
from docwatch.plans.bindings import FETCH_OUTCOMES, bind, duck
from docwatch.plans.pages_docs import AUTHORITY, HOST, SCHEME
from docwatch.plans.registry import query
from docwatch.session import table


def _nodes(spark, sf):
    """Nodes of the pages, each with a JSON-LD block that depends on its id."""
    i = F.col("page_id").cast("string")
    kind = F.when(F.col("page_id") % 3 == 0, "NewsArticle").when(F.col("page_id") % 3 == 1, "Product").otherwise("BlogPosting")
    block = F.concat(F.lit('<script type="application/ld+json">{"@graph": [{"@type": "Thing"}, {"@type": ["'), kind, F.lit('"], "headline": "H'), i, F.lit('", "author": {"name": "A'), (F.col("page_id") % 7).cast("string"), F.lit('"}, "datePublished": "2024-02-03T04:05:06Z"}]}</script>'))
    return P.dom_nodes(table(spark, sf, "pages").select("page_id", "url", F.concat("html", block).alias("html")))


@query("structured_data", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'NewsArticle' WHEN 2 THEN 'BlogPosting' END AS schema_type, CASE WHEN page_id % 3 <> 1 THEN 'H' || page_id END AS headline, CASE WHEN page_id % 3 <> 1 THEN 'A' || page_id % 7 END AS author FROM pages")
def structured_data(spark, sf):
    return X.structured_data(_nodes(spark, sf)).select("page_id", "schema_type", "headline", "author")


@query("schema_entities", "SELECT t AS schema_type, count(*) AS pages FROM (SELECT CASE page_id % 3 WHEN 0 THEN 'NewsArticle' WHEN 1 THEN 'Product' ELSE 'BlogPosting' END AS t FROM pages UNION ALL SELECT 'Thing' FROM pages) GROUP BY 1")
def schema_entities(spark, sf):
    return X.schema_types(_nodes(spark, sf)).groupBy(X.entity_type(F.col("schema_type")).alias("schema_type")).agg(F.countDistinct("page_id").alias("pages"))


#: Tables by page_id % 7: a thead with a caption; two header rows of spans; a first row of th that spans; th as row headers; a layout table; one row of data only; a table in a cell.
_TABLES = [
    "<table><caption>Report {i}</caption><thead><tr><th>Name<th>Status<th>Date</thead><tbody><tr><td>P{i}<td>Active<td>x <i>y</i><tr><td>Other<td>Idle<td></tbody><tfoot><tr><td>sum<td>2<td></tfoot></table>",
    '<table><tr><th rowspan=2>City {i}<th colspan=2>Size<th rowspan="2"><tr><th>Area<th>Area<tr><td>a<td>1<td>2<td>3<tr><td>b<td>4<td>5<tr><td>c</table>',
    "<table><tr><th>a<th colspan=2>b<tr><td>{i}<td>x <i>y</i><td>z<tr><td>1<td>2<td>3<td>4<td>5<td>6</table>",
    '<table><thead><tr><th>City<th>People</thead><tr><th scope="row">Jakarta<td>{i}<tr><th>Dhaka<td>7</table>',
    '<table><tr><td><img src="logo.png"><td>Site {i}</table>',
    "<table><tr><th>A<th>B<tr><td>1<td>{i}</table>",
    "<table><tr><th>k<th>v<tr><td>1<td><table><tr><th>m<th>n<tr><td>{i}<td>in<tr><td>q<td>r</table><tr><td>2<td>end</table>",
]


@query(
    "page_tables",
    """SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'Report ' || page_id END AS caption, t.headers, t.header_rows, t.row, t.cells FROM pages, (SELECT * FROM (VALUES
    (0, 'Name|Status|Date', 1, 0, 'P#|Active|x y'), (0, 'Name|Status|Date', 1, 1, 'Other|Idle|'),
    (1, 'City #|Size / Area|Size / Area|col_4', 2, 0, 'a|1|2|3'), (1, 'City #|Size / Area|Size / Area|col_4', 2, 1, 'b|4|5|'), (1, 'City #|Size / Area|Size / Area|col_4', 2, 2, 'c'),
    (2, 'a|b', 1, 0, '#|x y'), (2, 'a|b', 1, 1, '1|2|3|4|5|6'), (3, 'City|People', 1, 0, 'Jakarta|#'), (3, 'City|People', 1, 1, 'Dhaka|7'),
    (6, 'k|v', 1, 0, '1|'), (6, 'k|v', 1, 1, '2|end'), (6, 'm|n', 1, 0, '#|in'), (6, 'm|n', 1, 1, 'q|r')) v(kind, headers, header_rows, row, cells)) t
    WHERE page_id % 7 = t.kind""".replace("t.headers,", "replace(t.headers, '#', page_id::VARCHAR) AS headers,").replace("t.cells", "replace(t.cells, '#', page_id::VARCHAR) AS cells"),
)
def page_tables(spark, sf):
    text = F.element_at(F.array(*map(F.lit, _TABLES)), (F.col("page_id") % 7 + 1).cast("int"))
    pages = table(spark, sf, "pages").select("page_id", "url", F.concat("html", F.replace(text, F.lit("{i}"), F.col("page_id").cast("string"))).alias("html"))
    t = X.page_tables(P.dom_nodes(pages)).select("page_id", "caption", F.array_join("headers", "|").alias("headers"), "header_rows", F.posexplode("rows").alias("row", "cells"))
    return t.withColumn("cells", F.array_join("cells", "|"))


#: Addresses and links by page_id % 8.
_PAGERS = [
    ("/list?offset=25&q=a", ""), ("/list?start=0", ""), ("/list?offset=40", '<a href="/list?offset=0">a</a><a href="/list?offset=20">b</a><a href="/list?offset=40">c</a>'),
    ("/list", '<a href="/list?start=40">c</a><a href="/list?start=20">b</a>'), ("/list", '<a href="/list?page=3">3</a><a href="/list?page=1">1</a><a href="/list?page=2">2</a>'),
    ("/list", '<link rel="next" href="/r"><a href="/n">Next »</a>'), ("/list?skip=10", '<a href="?skip=30">Older posts</a>'), ("/list", '<a href="/more">Read more</a><a href="/list?page=2">2</a><a href="/x?from=9">x</a>'),
]


@query(
    "next_pages",
    f"""SELECT page_id, t.method, {SCHEME} || '://' || {AUTHORITY} || t.link AS next_url, t.size AS page_size, t.own AS current_offset FROM pages JOIN (VALUES
    (0, 'offset', '/list?offset=50&q=a', 25, 25), (2, 'offset', '/list?offset=60', 20, 40), (3, 'start', '/list?start=40', 20, 20), (4, 'numbered', '/list?page=2', NULL, NULL),
    (5, 'rel_next', '/r', NULL, NULL), (6, 'offset', '/list?skip=30', 20, 10)) t(kind, method, link, size, own) ON page_id % 8 = t.kind""",
)
def next_pages(spark, sf):
    kind = (F.col("page_id") % 8 + 1).cast("int")
    of = lambda n: F.element_at(F.array(*[F.lit(x[n]) for x in _PAGERS]), kind)
    url = F.concat(F.regexp_extract("url", r"^[a-z]+://[^/?#]+", 0), of(0))
    return X.pagination(P.dom_nodes(table(spark, sf, "pages").select("page_id", url.alias("url"), F.concat("html", of(1)).alias("html"))))


@query(
    "item_fields",
    f"""SELECT page_id, (k + 1)::INT AS n, CASE WHEN k % 3 = 2 THEN 'Head ' || k ELSE 'Offer ' || k || ' of ' || page_id END AS title, {SCHEME} || '://' || {AUTHORITY} || '/i/' || k AS url, CASE WHEN k % 2 = 0 THEN '$' || k END AS price,
    CASE WHEN k % 2 = 1 THEN '2024-01-0' || (k % 9 + 1) END AS published, CASE WHEN k % 4 = 0 THEN '/lazy.png' ELSE '/i.png' END AS image FROM pages, range(14) r(k) WHERE k < 8 + page_id % 6""",
)
def item_fields(spark, sf):
    """Eight to thirteen offers a page, more than its menu has links, some with a heading, a price, a time, a lazy image; one of them without a link."""
    i = F.col("page_id").cast("string")
    c = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])

    def offer(k):
        n = k.cast("string")
        head = F.when(k % 3 == 2, c("<h3>Head ", n, '</h3><a href="/i/', n, '"></a>')).otherwise(c('<a href="/i/', n, '">Offer ', n, " of ", i, "</a>"))
        more = F.when(k % 2 == 0, c('<span class="x item-price">$', n, "</span>")).otherwise(c('<time datetime="2024-01-0', (k % 9 + 1).cast("string"), '">then</time>'))
        return c('<div class="b a">', head, more, F.when(k % 4 == 0, '<img src="/blank.gif" data-src="/lazy.png">').otherwise('<img src="/i.png">'), "</div>")

    offers = F.array_join(F.transform(F.sequence(F.lit(0), (F.col("page_id") % 6 + 7).cast("int")), offer), "")
    nodes = P.dom_nodes(table(spark, sf, "pages").select("page_id", "url", "html").withColumn("html", c(F.col("html"), "<section>", offers, '<div class="a b">no link</div></section>'))).persist()  # read several times
    f = P.item_fields(nodes, P.repeated_items(nodes))
    return f.select("page_id", "n", "title", "url", "price", "published", "image")


@query("link_hosts", rf"SELECT page_id, {HOST} AS host, len(regexp_extract_all(html, '<a href='))::BIGINT AS links FROM pages")
def link_hosts(spark, sf):
    return X.link_hosts(P.dom_nodes(table(spark, sf, "pages")))


@query(
    "provenance",
    "SELECT doc_id, 'lang' AS field, lang AS value, 'html' AS source, 'generic' AS extractor, 0.5::DOUBLE AS confidence FROM documents WHERE lang <> '' UNION ALL SELECT doc_id, 'source', source, 'url', 'generic', 0.9 FROM documents WHERE source <> ''",
)
def provenance(spark, sf):
    return X.provenance(table(spark, sf, "documents"), "doc_id", {"lang": ("html", 0.5), "source": ("url", 0.9)}, "generic")


#: What a preflight of each domain finds, and its sample attempts, from the outcomes.
_CHECKS = """SELECT domain, count(*) AS n, count(*) % 7 > 0 AS reachable, CASE WHEN count(*) % 3 = 0 THEN 200 WHEN count(*) % 3 = 1 THEN 404 END AS status_code, max(outcome_id) % 4 > 0 AS fetch_allowed, min(outcome_id) % 2 = 0 AS sitemap,
    count(*) % 5 > 1 AS feed, count(*) % 26 AS internal_links, max(outcome_id) % 3 = 0 AS js_required, count(*) % 4 > 0 AS http_extracted, CASE WHEN max(outcome_id) % 5 > 1 THEN max(outcome_id) % 5 > 2 END AS browser_succeeded,
    max(outcome_id) % 2 = 0 AS browser_improved, CASE WHEN count(*) % 6 > 2 THEN 'text/html; charset=utf-8' WHEN count(*) % 6 > 0 THEN 'application/json' END AS content_type, CASE WHEN min(outcome_id) % 9 = 0 THEN 'reset' END AS http_error FROM o GROUP BY domain"""
_TRIED = "SELECT domain, success AS fetched, extraction_ok AS extracted, CASE WHEN outcome_id % 400 = 4 THEN 'cut off' END AS error FROM o WHERE quality > 0.9 OR error IS NOT NULL"


@query(
    "capability_scores",
    f"""WITH o AS ({duck(FETCH_OUTCOMES, 'events')}), c AS ({_CHECKS}), a AS (SELECT domain, count(*) AS samples, count(*) FILTER (fetched) AS f, count(*) FILTER (fetched AND extracted) AS x, bool_or(error IS NOT NULL) AS err FROM ({_TRIED}) GROUP BY 1),
    p AS (SELECT c.*, coalesce(samples, 0) AS samples, coalesce(err, false) OR http_error IS NOT NULL AS errors,
      round_even(CASE WHEN sitemap THEN 40 ELSE 0 END + CASE WHEN feed THEN 30 ELSE 0 END + least(30.0, internal_links / 20 * 30), 0)::INT AS discovery,
      CASE WHEN NOT reachable THEN 0 WHEN fetch_allowed THEN CASE WHEN status_code = 200 THEN 100 ELSE 40 END WHEN status_code = 200 THEN 50 ELSE 40 END AS fetched,
      round_even(CASE WHEN coalesce(f, 0) > 0 THEN x / f * 100 ELSE 0 END, 0)::INT AS extraction,
      CASE WHEN NOT js_required AND http_extracted THEN 100 WHEN browser_succeeded IS NULL THEN CASE WHEN js_required THEN 50 ELSE 80 END WHEN NOT browser_succeeded THEN 30 WHEN browser_improved THEN 90 ELSE 70 END AS rendering,
      CASE WHEN NOT reachable THEN 0 WHEN content_type LIKE 'text/html%' THEN 100 WHEN content_type IS NOT NULL THEN 60 ELSE 40 END AS kind FROM c LEFT JOIN a USING (domain))
    SELECT domain, samples, discovery, fetched AS "fetch", extraction, rendering, kind AS content_type, round_even(discovery * 0.30::DOUBLE + fetched * 0.25::DOUBLE + extraction * 0.25::DOUBLE + rendering * 0.10::DOUBLE + kind * 0.10::DOUBLE, 0)::INT AS score,
    CASE WHEN samples >= 8 AND NOT errors THEN 'high' WHEN samples >= 3 THEN 'medium' ELSE 'low' END AS confidence FROM p""",
)
def capability_scores(spark, sf):
    o = bind(spark, sf, FETCH_OUTCOMES, "events")
    of = lambda sql: spark.sql(sql.replace("FROM o", "FROM {o}"), o=o)
    return X.capability_score(of(_CHECKS), of(_TRIED))


@query(
    "source_events",
    "SELECT user_id % 60 AS source_id, event_id, ts AS seen, row_number() OVER (PARTITION BY user_id % 60 ORDER BY ts DESC, event_id) AS n FROM events QUALIFY n <= 5",
)
def source_events(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 60).alias("source_id"), "event_id", F.col("ts").alias("at"))
    return X.source_events(e, 5).select("source_id", "event_id", F.col("at").alias("seen"), F.col("n").cast("long").alias("n"))


@query(
    "source_statistics",
    "WITH s AS (SELECT DISTINCT user_id % 60 AS source_id FROM events), d AS (SELECT doc_id % 45 AS source_id, count(*) AS n FROM documents GROUP BY 1), e AS (SELECT user_id % 60 AS source_id, count(*) AS n, max(ts) AS t FROM events WHERE event_type = 'error' GROUP BY 1) SELECT source_id, coalesce(d.n, 0) AS documents, coalesce(e.n, 0) AS events, e.t AS last_event FROM s LEFT JOIN d USING (source_id) LEFT JOIN e USING (source_id)",
)
def source_statistics(spark, sf):
    e = table(spark, sf, "events").withColumn("source_id", F.col("user_id") % 60)
    d = table(spark, sf, "documents").select((F.col("doc_id") % 45).alias("source_id"))
    return X.source_statistics(e.select("source_id").distinct(), d, e.where("event_type = 'error'").select("source_id", F.col("ts").alias("at")))
