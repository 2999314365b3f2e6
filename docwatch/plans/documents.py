"""Queries of documents: the pages, each with a literal block of one shape added by its id."""

from __future__ import annotations

from pyspark.sql import functions as F

from docwatch.operators import documents as D
from docwatch.operators import pages as P
from docwatch.plans.registry import query
from docwatch.session import table

#: What is added to the page of id % 8, with # for the id. 7 gets nothing.
BLOCKS = [
    '<script type="application/ld+json">{"@type": "DiscussionForumPosting", "@id": "p#", "headline": "T#", "author": {"name": "A#"}, "datePublished": "2024-02-03T04:05:06Z", "text": "Opening text of #",'
    ' "comment": [{"@type": "Comment", "@id": "c#", "author": "B", "text": "Reply to #"}, {"@type": "Comment", "text": "Last word"}]}</script>',
    '<div class="comment" id="d1"><span class="author">U#</span><time datetime="2024-01-02T03:04:05Z">x</time><div class="comment-body">First body <b>of</b> #</div></div>'
    '<div class="comment"><div class="comment-body">abc</div></div><div class="comment" id="d3"><div class="content">Second body #</div></div><div class="post"><div class="content">Other pattern</div></div>',
    '<script type="application/ld+json">{"@type": ["Product"], "name": "Bike #", "description": "A bicycle with the number # on it", "image": ["a#.png", "b.png"], "offers": [{"price": "12#", "priceCurrency": "EUR",'
    ' "availableAtOrFrom": {"address": {"addressLocality": "Town #"}}}]}</script>',
    '<span id="titletextonly">Sofa #</span><span class="price">now $1,2#.50 only</span><div class="description">A sofa with the number <i>#</i> on its back</div><span class="location">Hill #</span><img src="x.png" data-src="lazy#.png"><img srcset="s.png 1x, t.png 2x">',
    '<script type="application/ld+json">{"@type": "Event", "name": "Fair #", "description": "The yearly fair number #", "startDate": "2024-05-01T10:00:00Z", "endDate": "2024-05-02T10:00:00Z", "location": {"name": "Hall #"}, "organizer": {"name": "Club"}}</script>',
    '<script type="application/ld+json">{"@type": "JobPosting", "title": "Cook #", "description": "Cooking for # people a day", "hiringOrganization": {"name": "Inn #"}, "datePosted": "2024-01-01T00:00:00Z", "validThrough": "2024-03-0~T00:00:00Z", "baseSalary": {"value": {"value": 4000}}}</script>',
    '<script type="application/ld+json">{"@type": "FAQPage", "mainEntity": [{"@type": "Question", "name": "Why #?", "acceptedAnswer": {"text": "Because #."}}, {"@type": "Question", "name": "How?"}]}</script>',
]
_TYPES = "FORUM_THREAD FORUM_THREAD CLASSIFIED_LISTING CLASSIFIED_LISTING EVENT JOB FAQ_PAGE".split()


def _nodes(spark, sf, by_page=False):
    """Nodes of the pages with their block; in a job's block ~ is 1 to 9 by the id. Kept for the several readings of one query; `by_page` pays where texts are read more than twice."""
    i = F.col("page_id").cast("string")
    block = F.lit("")
    for k, text in enumerate(BLOCKS):
        filled = F.replace(F.replace(F.lit(text), F.lit("#"), i), F.lit("~"), (F.col("page_id") % 9 + 1).cast("string")) if k == 5 else F.replace(F.lit(text), F.lit("#"), i)
        block = F.when(F.col("page_id") % 8 == k, filled).otherwise(block)
    nodes = P.dom_nodes(table(spark, sf, "pages").select("page_id", "url", F.concat("html", block).alias("html")))
    return P.kept_by_page(nodes) if by_page else nodes.persist()


@query(
    "forum_posts",
    """WITH p AS (SELECT page_id, page_id::VARCHAR AS i FROM pages)
    SELECT page_id, 1::BIGINT AS n, 'p' || i AS post_id, 'A' || i AS author, TIMESTAMP '2024-02-03 04:05:06' AS posted_at, 'Opening text of ' || i AS body, true AS is_op, 3::BIGINT AS posts FROM p WHERE page_id % 8 = 0
    UNION ALL SELECT page_id, 2, 'c' || i, 'B', NULL, 'Reply to ' || i, false, 3 FROM p WHERE page_id % 8 = 0 UNION ALL SELECT page_id, 3, NULL, NULL, NULL, 'Last word', false, 3 FROM p WHERE page_id % 8 = 0
    UNION ALL SELECT page_id, 1, 'd1', 'U' || i, TIMESTAMP '2024-01-02 03:04:05', 'First body ' || i || ' of', false, 2 FROM p WHERE page_id % 8 = 1
    UNION ALL SELECT page_id, 2, 'd3', NULL, NULL, 'Second body ' || i, false, 2 FROM p WHERE page_id % 8 = 1""",
)
def forum_posts(spark, sf):
    f = D.forum_posts(_nodes(spark, sf))
    return f.withColumns({"posted_at": F.col("posted_at").cast("timestamp_ntz"), "n": F.col("n").cast("long")})


@query(
    "forum_threads",
    """WITH p AS (SELECT page_id, page_id::VARCHAR AS i FROM pages)
    SELECT page_id, 'A' || i AS author, 2::BIGINT AS reply_count, 'A' || i || ': Opening text of ' || i || chr(10) || chr(10) || 'B: Reply to ' || i || chr(10) || chr(10) || 'unknown: Last word' AS body, 0.6::DOUBLE AS confidence FROM p WHERE page_id % 8 = 0
    UNION ALL SELECT page_id, 'U' || i, 1, 'U' || i || ': First body ' || i || ' of' || chr(10) || chr(10) || 'unknown: Second body ' || i, 0.6 FROM p WHERE page_id % 8 = 1""",
)
def forum_threads(spark, sf):
    return D.forum_threads(_nodes(spark, sf)).select("page_id", "author", "reply_count", "body", "confidence")


@query(
    "listings",
    """WITH p AS (SELECT page_id, page_id::VARCHAR AS i FROM pages)
    SELECT page_id, 'Bike ' || i AS title, '12' || i AS price, 'EUR' AS currency, 'Town ' || i AS location, 'A bicycle with the number ' || i || ' on it' AS description, ['a' || i || '.png', 'b.png'] AS images, 'structured' AS origin FROM p WHERE page_id % 8 = 2
    UNION ALL SELECT page_id, 'Sofa ' || i, '1,2' || i || '.50', 'USD', 'Hill ' || i, 'A sofa with the number on its back ' || i, list_concat(regexp_extract_all(html, '<img[^>]*?src="([^"]*)"', 1), ['lazy' || i || '.png', 's.png']), 'dom' FROM p JOIN pages USING (page_id) WHERE page_id % 8 = 3""",
)
def listings(spark, sf):
    return D.listings(_nodes(spark, sf))


@query(
    "schema_fields",
    """WITH p AS (SELECT page_id, page_id::VARCHAR AS i FROM pages)
    SELECT page_id, 'Event' AS schema_type, 'Fair ' || i AS name, 'Hall ' || i AS place, 'Club' AS organizer, NULL AS salary, 0::BIGINT AS questions FROM p WHERE page_id % 8 = 4
    UNION ALL SELECT page_id, 'JobPosting', 'Cook ' || i, NULL, 'Inn ' || i, '4000', 0 FROM p WHERE page_id % 8 = 5 UNION ALL SELECT page_id, 'FAQPage', NULL, NULL, NULL, NULL, 2 FROM p WHERE page_id % 8 = 6""",
)
def schema_fields(spark, sf):
    f = D.schema_fields(_nodes(spark, sf))
    v = lambda k: F.col("fields")[k].alias(k)
    return f.select("page_id", "schema_type", v("name"), v("place"), v("organizer"), v("salary"), F.coalesce(F.size("faq"), F.lit(0)).cast("long").alias("questions"))


@query(
    "assembled_documents",
    """WITH p AS (SELECT page_id, page_id::VARCHAR AS i, page_id % 8 AS k FROM pages WHERE page_id % 8 < 7)
    SELECT page_id, ['forum','forum','listing','listing','event','job','faq'][k + 1] AS extractor,
    ['A' || i || ': Opening text of ' || i || chr(10) || chr(10) || 'B: Reply to ' || i || chr(10) || chr(10) || 'unknown: Last word', 'U' || i || ': First body ' || i || ' of' || chr(10) || chr(10) || 'unknown: Second body ' || i,
     'A bicycle with the number ' || i || ' on it', 'A sofa with the number on its back ' || i, 'The yearly fair number ' || i, 'Cooking for ' || i || ' people a day', 'Q: Why ' || i || '?' || chr(10) || 'A: Because ' || i || '.' || chr(10) || chr(10) || 'Q: How?' || chr(10) || 'A: '][k + 1] AS body,
    CASE k WHEN 0 THEN 'A' || i WHEN 1 THEN 'U' || i END AS author, CASE k WHEN 4 THEN 'Club' WHEN 5 THEN 'Inn ' || i END AS publisher, ['x', 'x', 'Town ' || i, 'Hill ' || i, 'Hall ' || i, 'x', 'x'][k + 1] AS section_or_x,
    CASE WHEN k = 5 THEN CASE WHEN page_id % 9 + 1 < 6 THEN 'closed' ELSE 'open' END END AS status, [0.6, 0.6, 0.6, 0.6, 0.7, 0.7, 0.7][k + 1]::DOUBLE AS confidence FROM p""",
)
def assembled_documents(spark, sf):
    kinds = F.element_at(F.array(*[F.lit(t) for t in _TYPES]), (F.col("page_id") % 8 + 1).cast("int"))
    types = table(spark, sf, "pages").where("page_id % 8 < 7").select("page_id", kinds.alias("page_type"))
    d = D.assemble_documents(_nodes(spark, sf, by_page=True), types, F.lit("2024-03-06 00:00:00").cast("timestamp"))
    return d.select("page_id", "extractor", "body", "author", "publisher", F.coalesce("section", F.lit("x")).alias("section_or_x"), "status", "confidence")
