"""Documents of pages: forum posts, listings and shaped documents, each read from JSON-LD first and from the node table else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docwatch.operators import extraction as X
from docwatch.operators import pages as P

#: Class names by which posts and their parts are known, in order of preference.
CONTAINERS = "comtr comment post message".split()
PARTS = {
    "author": "hnuser author username user".split(),
    "time": "age time date timestamp posted".split(),
    "body": "commtext comment-body post-body message-body content".split(),
}
POST_TYPES = ["DiscussionForumPosting", "Comment", "SocialMediaPosting"]
#: What tells the parts of a listing, in order: #id, .class, [itemprop] or a tag.
LISTING_PARTS = {
    "title": ["#titletextonly", ".postingtitletext", "h1", "[name]"],
    "price": [".price", "[price]", ".listing-price"],
    "description": ["#postingbody", ".description", "[description]"],
    "location": [".location", "[addressLocality]"],
}
LAZY = ["data-src", "data-original", "data-lazy-src", "data-url"]
#: Fields of schema.org types by their paths, the first that holds a value.
SCHEMA_FIELDS = {
    "Event": {"name": ["$.name"], "description": ["$.description"], "start": ["$.startDate"], "end": ["$.endDate"], "place": ["$.location.name", "$.location"], "organizer": ["$.organizer.name", "$.organizer"], "status": ["$.eventStatus"]},
    "JobPosting": {"name": ["$.title"], "description": ["$.description"], "start": ["$.datePosted"], "end": ["$.validThrough"], "place": ["$.jobLocation.address.addressLocality"], "organizer": ["$.hiringOrganization.name", "$.hiringOrganization"], "salary": ["$.baseSalary.value.value", "$.baseSalary.value", "$.baseSalary"]},
    "Person": {"name": ["$.name"], "description": ["$.description"], "job_title": ["$.jobTitle"], "organizer": ["$.worksFor.name", "$.worksFor"]},
    "Organization": {"name": ["$.name"], "description": ["$.description"], "place": ["$.address.addressLocality", "$.address"]},
    "FAQPage": {},
}


def _get(paths: list[str], kind: str = "string", of: str = "block") -> Column:
    return F.coalesce(*[F.try_variant_get(of, p, kind) for p in paths])


def _time(value: Column) -> Column:
    return value.try_cast("timestamp")


def deep_texts(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """`roots` (page_id, root, root_end, ...) with `text`: the texts of all nodes below each, in order. An element is bounded by its page."""
    t = nodes.where("text <> ''").select(F.col("page_id").alias("t_page"), F.col("node_id").alias("t"), F.col("text").alias("t_text"))
    j = roots.join(t, (F.col("page_id") == F.col("t_page")) & F.col("t").between(F.col("root"), F.col("root_end")), "left")
    parts = F.transform(F.array_sort(F.collect_list(F.when(F.col("t").isNotNull(), F.struct("t", "t_text")))), lambda x: x["t_text"])
    return j.groupBy(*roots.columns).agg(F.array_join(parts, " ").alias("text"))


def _structured_posts(nodes: DataFrame) -> DataFrame:
    b = X.json_ld(nodes).where(F.col("schema_type").isin(POST_TYPES))

    def row(df, ord, is_op):
        return df.select(
            "page_id", ord.alias("ord"), _get(["$['@id']", "$.url", "$.identifier"]).alias("post_id"), _get(["$.author.name", "$.author"]).alias("author"),
            _time(_get(["$.datePublished"])).alias("posted_at"), F.trim(F.coalesce(_get(["$.text", "$.articleBody"]), F.lit(""))).alias("body"), is_op.alias("is_op"),
        )

    own = row(b, F.struct(F.col("ord").cast("long").alias("a"), F.lit(0).alias("b")), F.col("schema_type") != "Comment")
    below = b.select("page_id", "ord", F.posexplode(F.try_variant_get("block", "$.comment", "array<variant>")).alias("k", "block"))
    return own.unionByName(row(below, F.struct(F.col("ord").cast("long").alias("a"), (F.col("k") + 1).alias("b")), F.lit(False)))


def _dom_posts(nodes: DataFrame) -> DataFrame:
    kinds = F.array(*[F.lit(c) for c in CONTAINERS])
    box = nodes.select("page_id", F.col("node_id").alias("box"), F.col("last_desc").alias("box_end"), F.col("attrs")["id"].alias("post_id"), F.explode(F.array_intersect(kinds, "cls")).alias("kind"))
    rank = F.array_position(kinds, F.col("kind"))
    parts = None
    for name, classes in PARTS.items():
        known = F.array(*[F.lit(c) for c in classes])
        hits = F.array_intersect(known, "cls")
        is_tag = (F.col("tag") == "time") if name == "time" else (F.col("attrs")["rel"] == "author") if name == "author" else F.lit(False)
        place = F.when(F.size(hits) > 0, F.array_position(known, F.get(hits, F.lit(0)))).when(F.coalesce(is_tag, F.lit(False)), F.lit(2 if name == "time" else 9))
        rows = nodes.withColumn("place", place).where("place IS NOT NULL")
        rows = rows.select(F.col("page_id").alias("p_page"), F.col("node_id").alias("p"), F.col("last_desc").alias("p_end"), F.coalesce(F.col("attrs")["title"], F.col("attrs")["datetime"]).alias("p_time"), F.lit(name).alias("part"), "place")
        parts = rows if parts is None else parts.union(rows)
    inside = box.join(parts, (F.col("page_id") == F.col("p_page")) & (F.col("p") > F.col("box")) & (F.col("p") <= F.col("box_end")))
    best = inside.groupBy("page_id", "box", "post_id", "kind", "part").agg(F.min(F.struct("place", "p", "p_end", "p_time")).alias("b"))
    told = deep_texts(nodes, best.select("page_id", "box", "post_id", "kind", "part", F.col("b.p").alias("root"), F.col("b.p_end").alias("root_end"), F.col("b.p_time").alias("p_time")))
    of = lambda part, c: F.max(F.when(F.col("part") == part, F.col(c)))
    posts = told.groupBy("page_id", "box", "post_id", "kind").agg(of("author", "text").alias("author"), of("time", "p_time").alias("t"), F.trim(of("body", "text")).alias("body"))
    posts = posts.where(F.length("body") >= 5).withColumn("rank", rank)
    first = posts.groupBy("page_id").agg(F.min("rank").alias("rank"))
    posts = posts.join(first, ["page_id", "rank"])
    return posts.select("page_id", F.struct(F.col("box").cast("long").alias("a"), F.lit(0).alias("b")).alias("ord"), "post_id", "author", _time(F.col("t")).alias("posted_at"), "body", F.lit(False).alias("is_op"))


def forum_posts(nodes: DataFrame, most: int = 200) -> DataFrame:
    """page_id, n (from 1), post_id, author, posted_at, body, is_op, posts: the first `most` posts of each page and how many it has.

    Posts of JSON-LD and their comments win; a page without these is read by the first class name of CONTAINERS under which it holds a post with a body.
    """
    told = _structured_posts(nodes)
    dom = _dom_posts(nodes).join(told.select("page_id").distinct(), "page_id", "left_anti")
    w = Window.partitionBy("page_id")
    posts = told.unionByName(dom).withColumns({"n": F.row_number().over(w.orderBy("ord")), "posts": F.count("*").over(w)})
    return posts.where(F.col("n") <= most).drop("ord")


def forum_threads(nodes: DataFrame) -> DataFrame:
    """A document for each page with posts: headline, body (the first 50 posts as author: body), author and time of the first, reply_count, confidence."""
    first = F.min_by(F.struct("author", "posted_at"), "n")
    line = F.concat(F.coalesce("author", F.lit("unknown")), F.lit(": "), F.col("body"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= 50, F.struct("n", line.alias("line"))))), lambda x: x["line"]), "\n\n")
    g = forum_posts(nodes).groupBy("page_id").agg(joined.alias("body"), first.alias("f"), F.max("posts").alias("posts")).where(F.length("body") >= 20)
    return g.select("page_id", "body", "f.author", F.col("f.posted_at").alias("published"), (F.col("posts") - 1).alias("reply_count"), F.when(F.col("posts") > 1, 0.6).otherwise(0.3).alias("confidence"))


def _selected(nodes: DataFrame, parts: dict[str, list[str]]) -> DataFrame:
    """page_id, part, root, root_end: the first node of each part by the order of its selectors."""
    rows = None
    for name, selectors in parts.items():
        place = None
        for k, s in enumerate(selectors):
            hit = F.col("attrs")["id"] == s[1:] if s[0] == "#" else F.array_contains("cls", s[1:]) if s[0] == "." else F.col("attrs")["itemprop"] == s[1:-1] if s[0] == "[" else F.col("tag") == s
            place = F.when(hit, k) if place is None else place.when(hit, k)
        found = nodes.withColumn("place", place).where("place IS NOT NULL").groupBy("page_id").agg(F.min(F.struct("place", "node_id", "last_desc")).alias("b"))
        found = found.select("page_id", F.lit(name).alias("part"), F.col("b.node_id").alias("root"), F.col("b.last_desc").alias("root_end"))
        rows = found if rows is None else rows.union(found)
    return rows


def listings(nodes: DataFrame) -> DataFrame:
    """page_id, title, price, currency, location, description, images, origin of the pages that offer something, description of 20 characters or more.

    The first Product or Offer of JSON-LD wins; else the parts are looked for by LISTING_PARTS, images by their lazy addresses first.
    """
    b = X.json_ld(nodes).where(F.col("schema_type").isin("Product", "Offer"))
    offer = lambda p: _get([f"$.offers[0].{p}", f"$.offers.{p}", f"$.{p}"])
    images = F.coalesce(F.try_variant_get("block", "$.image", "array<string>"), F.array_compact(F.array(_get(["$.image"]))))
    told = b.groupBy("page_id").agg(F.min_by(F.struct(
        _get(["$.name"]).alias("title"), offer("price").alias("price"), offer("priceCurrency").alias("currency"), offer("availableAtOrFrom.address.addressLocality").alias("location"),
        F.trim(F.coalesce(_get(["$.description"]), F.lit(""))).alias("description"), images.alias("images"),
    ), "ord").alias("s")).select("page_id", "s.*", F.lit("structured").alias("origin"))
    t = deep_texts(nodes, _selected(nodes, LISTING_PARTS)).groupBy("page_id").agg(*[F.trim(F.max(F.when(F.col("part") == p, F.col("text")))).alias(p) for p in LISTING_PARTS])
    srcset = F.split_part(F.split_part(F.trim(F.split_part(F.col("attrs")["srcset"], F.lit(","), F.lit(1))), F.lit(" "), F.lit(1)), F.lit("\t"), F.lit(1))
    src = F.coalesce(*[F.nullif(F.col("attrs")[a], F.lit("")) for a in LAZY], F.nullif(srcset, F.lit("")), F.nullif(F.col("attrs")["src"], F.lit("")))
    img = nodes.where("tag = 'img'").select("page_id", "node_id", src.alias("src")).where("src IS NOT NULL")
    img = img.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "src"))), lambda x: x["src"]).alias("images"))
    dom = t.where("description <> ''").join(told.select("page_id"), "page_id", "left_anti").join(img, "page_id", "left")
    price = F.nullif(F.regexp_extract("price", r"[0-9,]+(?:\.[0-9]*)?", 0), F.lit(""))
    dom = dom.select("page_id", "title", price.alias("price"), F.when(F.col("price").contains("$"), "USD").alias("currency"), "location", "description", F.coalesce("images", F.array().cast("array<string>")).alias("images"), F.lit("dom").alias("origin"))
    return told.unionByName(dom).where(F.length("description") >= 20)


def schema_fields(nodes: DataFrame) -> DataFrame:
    """page_id, schema_type, fields (a map): the first block of each type of SCHEMA_FIELDS on a page, flattened."""
    fields = None
    for kind, paths in SCHEMA_FIELDS.items():
        entries = [F.struct(F.lit(name).alias("k"), F.trim(_get(p)).alias("v")) for name, p in paths.items()]
        value = F.array(*entries) if entries else F.array().cast("array<struct<k:string,v:string>>")
        fields = F.when(F.col("schema_type") == kind, value) if fields is None else fields.when(F.col("schema_type") == kind, value)
    answers = F.transform(F.try_variant_get("block", "$.mainEntity", "array<variant>"), lambda q: F.struct(F.try_variant_get(q, "$.name", "string").alias("question"), F.try_variant_get(q, "$.acceptedAnswer.text", "string").alias("answer")))
    b = X.json_ld(nodes).where(F.col("schema_type").isin(list(SCHEMA_FIELDS)))
    b = b.select("page_id", "ord", "schema_type", F.filter(fields, lambda e: e["v"].isNotNull() & (e["v"] != "")).alias("e"), F.filter(answers, lambda a: a["question"].isNotNull()).alias("faq"))
    first = b.groupBy("page_id", "schema_type").agg(F.min_by(F.struct("e", "faq"), "ord").alias("f"))
    return first.select("page_id", "schema_type", F.map_from_entries("f.e").alias("fields"), F.col("f.faq").alias("faq"))


def _shaped(f: DataFrame, as_of: Column) -> DataFrame:
    """Events, jobs, FAQs and profiles of `schema_fields`, one shape for all."""
    v = lambda k: F.col("fields")[k]
    has = lambda c, name: F.when(c.isNotNull(), name)
    out = None

    def add(kind, extractor, body, least, confidence, named, **columns):
        nonlocal out
        part = f.where(F.col("schema_type") == kind)
        base = {"headline": v("name"), "publisher": v("organizer"), "published": F.lit(None).cast("timestamp"), "updated": F.lit(None).cast("timestamp"), "section": F.lit(None).cast("string"), "status": F.lit(None).cast("string")} | columns
        part = part.select("page_id", F.lit(extractor).alias("extractor"), body.alias("body"), confidence.alias("confidence"), F.array_compact(F.array(F.lit("body"), *named)).alias("fields_detected"), *[c.alias(k) for k, c in base.items()])
        part = part.where(F.length("body") >= least)
        out = part if out is None else out.unionByName(part)

    deadline = _time(v("end"))
    add("Event", "event", F.coalesce(v("description"), v("name")), 10, F.when(v("start").isNotNull(), 0.7).otherwise(0.5),
        [has(v("name"), "headline"), has(v("start"), "published_at"), has(v("place"), "location"), has(v("organizer"), "organizer")],
        published=_time(v("start")), updated=_time(v("end")), section=v("place"), status=v("status"))
    add("JobPosting", "job", v("description"), 10, F.when(v("salary").isNotNull(), 0.7).otherwise(0.55),
        [has(v("name"), "headline"), has(v("organizer"), "publisher"), has(v("place"), "location"), has(v("salary"), "salary")],
        published=_time(v("start")), updated=deadline, section=v("place"), status=F.when(deadline < as_of, "closed").otherwise("open"))
    items = F.array_join(F.transform("faq", lambda q: F.concat(F.lit("Q: "), q["question"], F.lit("\nA: "), F.coalesce(q["answer"], F.lit("")))), "\n\n")
    add("FAQPage", "faq", items, 10, F.lit(0.7), [F.lit("faq_items")], headline=F.lit(None).cast("string"))
    add("Person", "profile", F.coalesce(v("description"), v("name")), 5, F.when(v("job_title").isNotNull(), 0.65).otherwise(0.5), [has(v("name"), "headline"), has(v("job_title"), "job_title")], section=v("job_title"))
    no_person = f.where("schema_type = 'Person'").select("page_id")
    f = f.join(no_person, "page_id", "left_anti")
    add("Organization", "profile", F.coalesce(v("description"), v("name")), 5, F.lit(0.5), [F.lit("headline")], publisher=v("name"), section=v("place"))
    return out


def assemble_documents(nodes: DataFrame, page_types: DataFrame, as_of: Column) -> DataFrame:
    """One document for each page of `page_types` (page_id, page_type) whose extractor finds a body.

    page_id, extractor, headline, body, author, publisher, published, updated, section, status, canonical, confidence, fields_detected.
    Structured fields win over what the page itself says; articles get .5 with a headline, .3 without, and .08 for each further field, .4 at most.
    A page of a special type that its own extractor can't read is read as an article.
    """
    s, p, main = X.structured_data(nodes), P.page_summary(nodes).select("page_id", "title", "canonical"), P.main_text(nodes)
    null = lambda kind="string": F.lit(None).cast(kind)
    posts = forum_threads(nodes).join(s.select("page_id", F.col("headline")), "page_id", "left").join(p, "page_id", "left")
    head = F.coalesce("headline", "title")
    forum = posts.select(
        "page_id", F.lit("forum").alias("extractor"), head.alias("headline"), "body", "author", null().alias("publisher"), "published", null("timestamp").alias("updated"), null().alias("section"),
        null().alias("status"), "confidence", F.array_compact(F.array(F.lit("body"), F.lit("posts"), F.when(head.isNotNull(), "headline"))).alias("fields_detected"),
    )
    listing = listings(nodes).select(
        "page_id", F.lit("listing").alias("extractor"), F.col("title").alias("headline"), F.col("description").alias("body"), null().alias("author"), null().alias("publisher"), null("timestamp").alias("published"),
        null("timestamp").alias("updated"), F.col("location").alias("section"), null().alias("status"), F.when(F.col("price").isNotNull(), 0.6).otherwise(0.4).alias("confidence"),
        F.array_compact(F.array(F.lit("body"), *[F.when(F.col(c).isNotNull(), n) for c, n in (("title", "headline"), ("price", "price"), ("location", "location"))])).alias("fields_detected"),
    )
    shaped = _shaped(schema_fields(nodes), as_of).withColumn("author", null())
    special = forum.unionByName(listing).unionByName(shaped)
    wanted = F.expr("CASE page_type WHEN 'FORUM_THREAD' THEN 'forum' WHEN 'CLASSIFIED_LISTING' THEN 'listing' WHEN 'EVENT' THEN 'event' WHEN 'JOB' THEN 'job' WHEN 'FAQ_PAGE' THEN 'faq' WHEN 'PROFILE' THEN 'profile' END")
    special = page_types.select("page_id", wanted.alias("extractor")).join(special, ["page_id", "extractor"])
    a = main.join(page_types, "page_id").join(special.select("page_id"), "page_id", "left_anti").join(s, "page_id", "left").join(p, "page_id", "left")
    fields = F.array_compact(F.array(F.when(head.isNotNull(), "headline"), *[F.when(F.col(c).isNotNull(), n) for c, n in (("author", "author"), ("published", "published_at"), ("publisher", "publisher"), ("section", "section"))], F.lit("body")))
    sure = F.least(F.lit(0.99), F.when(head.isNotNull(), 0.5).otherwise(0.3) + F.least(F.lit(0.4), F.lit(0.08) * F.greatest(F.lit(0), F.size(fields) - 2)))
    article = a.select(
        "page_id", F.when(F.col("page_type") == "BLOG_POST", "blog").otherwise("news").alias("extractor"), head.alias("headline"), F.col("text").alias("body"), "author", "publisher", "published",
        null("timestamp").alias("updated"), "section", null().alias("status"), F.when(F.length("text") < 100, 0.0).otherwise(F.bround(sure, 2)).alias("confidence"), fields.alias("fields_detected"),
    )
    urls = nodes.where("node_id = 0").select("page_id", "url")
    out = special.unionByName(article).join(p.select("page_id", "canonical"), "page_id", "left").join(urls, "page_id", "left")
    return out.withColumn("canonical", F.coalesce("canonical", "url")).drop("url")
