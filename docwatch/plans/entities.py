"""Queries over mentions, entities and stories derived from documents, conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from docwatch.operators import entities as H
from docwatch.plans.names import common, words_in_order
from docwatch.plans.registry import query
from docwatch.session import settled, table

_LIT = "text || ' mail Team@Example.org, see https://x.example.org/a?b=1 pay $1,250.50 or 300 dollars, call +1 555 123 4567 on 2024-01-02'"


def _with_literals(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.concat("text", F.lit(_LIT[len("text || '") : -1])).alias("text"))


@query(
    "mentions",
    rf"""WITH d AS (SELECT doc_id, {_LIT} AS t FROM documents), m AS (SELECT doc_id, 'EMAIL' AS entity_type, unnest(regexp_extract_all(t, '{H.EMAIL}')) AS raw_text FROM d
    UNION ALL SELECT doc_id, 'URL', unnest(regexp_extract_all(t, '{H.URL.replace("'", "''").replace(chr(92) + '"', '"')}')) FROM d UNION ALL SELECT doc_id, 'MONEY', unnest(regexp_extract_all(t, '{H.MONEY}')) FROM d)
    SELECT entity_type, trim(raw_text) AS raw_text, count(*) AS n, count(DISTINCT doc_id) AS documents FROM m GROUP BY ALL""",
)
def mentions(spark, sf):
    m = H.extract_mentions(_with_literals(spark, sf)).where("entity_type <> 'PHONE'")
    return m.groupBy("entity_type", "raw_text").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))


_SPANS = lambda pattern: f"list_transform(range(1, len(f) + 1), lambda i: {{'s': (list_sum(list_transform(r[1:i], lambda v: length(v))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda v: length(v))), 0))::INT, 'm': f[i]}}) FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS f, regexp_split_to_array(t, '{pattern}') AS r FROM d)"


@query(
    "mention_spans",
    rf"""WITH d AS (SELECT doc_id, {_LIT} AS t FROM documents WHERE text IS NOT NULL), m AS (SELECT doc_id, 'EMAIL' AS entity_type, unnest({_SPANS(H.EMAIL).replace(" FROM ", ") AS x FROM ", 1)}
    UNION ALL SELECT doc_id, 'MONEY', unnest({_SPANS(H.MONEY).replace(" FROM ", ") AS x FROM ", 1)})
    SELECT doc_id, entity_type, trim(x.m) AS raw_text, (x.s + length(x.m) - length(ltrim(x.m)))::INT AS start, true AS there FROM m""",
)
def mention_spans(spark, sf):
    """Where each address and sum stands; there: the text has it at that place."""
    d = _with_literals(spark, sf)
    m = H.extract_mentions(d).where("entity_type IN ('EMAIL', 'MONEY')").join(d, "doc_id")
    return m.select("doc_id", "entity_type", "raw_text", "start", F.expr("substring(text, start + 1, end - start) = raw_text").alias("there"))


@query("phone_mentions")
def phone_mentions(spark, sf):
    return H.extract_mentions(_with_literals(spark, sf), types=("PHONE",)).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"))


_FORMS = ["Inc.", "  LTD", "Holding", "co"]
_NAMES = f"SELECT doc_id, lower(source) || ' ' || lang || ' ' || trim(lower({_FORMS}[doc_id % 4 + 1])) AS n FROM documents"


def _names(spark, sf):
    form = F.element_at(F.array(*map(F.lit, _FORMS)), (F.col("doc_id") % 4 + 1).cast("int"))
    return H.normalize_name(table(spark, sf, "documents").select("doc_id", F.concat_ws(" ", F.upper("source"), "lang", form).alias("name")), "name")


@query("alias_keys", f"SELECT n AS normalized_name, CASE WHEN ends_with(n, ' holding') THEN n ELSE trim(regexp_replace(n, '\\b(?:inc|ltd|co)\\.?$', '')) END AS alias_key, count(*) AS n FROM ({_NAMES}) GROUP BY ALL".replace("count(*) AS n", "count(*) AS seen"))
def alias_keys(spark, sf):
    return _names(spark, sf).groupBy("normalized_name", H.alias_key(F.col("normalized_name")).alias("alias_key")).agg(F.count("*").alias("seen"))


_MEN = "SELECT user_id, event_id, CASE WHEN user_id % 2 = 0 THEN 'PERSON' ELSE 'ORGANIZATION' END AS entity_type, 'n' || user_id AS name, event_id // 7 AS doc FROM events"


@query(
    "resolved_mentions",
    f"""WITH m AS ({_MEN}), c AS (SELECT doc, list(DISTINCT name) AS ctx FROM m GROUP BY doc), r AS (SELECT m.entity_type, name, user_id, list_contains(ctx, 'n' || (user_id + 1) % 150) AS shared FROM m JOIN c USING (doc))
    SELECT entity_type, CASE WHEN user_id % 3 = 2 THEN 'NEW_ENTITY' WHEN entity_type = 'PERSON' AND NOT shared THEN 'NEW_ENTITY' ELSE 'MERGE' END AS action,
    (CASE WHEN user_id % 3 = 2 THEN 0.6 WHEN entity_type = 'PERSON' AND NOT shared THEN 0.5 WHEN entity_type = 'PERSON' THEN 0.85 ELSE 0.9 END)::DOUBLE AS confidence, count(*) AS n FROM r GROUP BY ALL""",
)
def resolved_mentions(spark, sf):
    e = table(spark, sf, "events")
    name = lambda c: F.concat(F.lit("n"), c.cast("string"))
    kind = F.when(F.col("user_id") % 2 == 0, "PERSON").otherwise("ORGANIZATION")
    m = e.select(kind.alias("entity_type"), name(F.col("user_id")).alias("normalized_name"), F.floor(F.col("event_id") / 7).alias("doc"))
    ctx = m.groupBy("doc").agg(F.collect_set("normalized_name").alias("context"))  # seven events a document
    users = e.select("user_id").distinct()
    known = users.where("user_id % 3 = 0").select(F.col("user_id").alias("entity_id"), kind.alias("entity_type"), name(F.col("user_id")).alias("normalized_name"), F.array(name((F.col("user_id") + 1) % 150)).alias("context"))
    aliased = users.where("user_id % 3 = 1").select(F.col("user_id").alias("entity_id"), kind.alias("entity_type"), F.concat(F.lit("main "), name(F.col("user_id"))).alias("normalized_name"), F.array(name((F.col("user_id") + 1) % 150)).alias("context"))
    aliases = aliased.select("entity_id", F.substring("normalized_name", 6, 20).alias("alias"))
    r = H.resolve_exact(m.join(ctx, "doc"), known.unionByName(aliased), aliases)
    return r.groupBy("entity_type", "action", "confidence").agg(F.count("*").alias("n"))


#: Names are three words of a text; a mention has a letter less, a legal form, a letter more, its words in another order, or is an alias.
_PEOPLE = """t AS (SELECT doc_id, source, CASE WHEN lang = 'en' THEN 'PERSON' ELSE lang END AS entity_type, regexp_extract(lower(text), '[a-z]+ [a-z]+ [a-z]+', 0) AS n FROM {documents}),
b AS (SELECT *, CASE doc_id % 6 WHEN 0 THEN n WHEN 1 THEN concat(substring(n, 1, 3), substring(n, 5, 400)) WHEN 2 THEN concat(n, ' inc') WHEN 3 THEN concat(substring(n, 1, 5), 'x', substring(n, 6, 400))
  WHEN 4 THEN concat('also ', n) ELSE concat(substring(n, length(n) - 2, 3), ' ', substring(n, 1, length(n) - 3)) END AS m FROM t WHERE n <> '' AND length(n) <= 80)"""
_KNOWN = "SELECT entity_type, n AS normalized_name, min(doc_id) AS entity_id FROM b WHERE doc_id % 3 < 2 GROUP BY 1, 2"
_SHORT = lambda c: f"coalesce(nullif(trim(regexp_replace({c}, '\\b(?:{'|'.join(H.SUFFIXES)})\\.?\\s*$', '')), ''), {c})"
_FUZZY = f"""{_PEOPLE.replace('{documents}', 'documents')}, known AS ({_KNOWN}), kf AS (SELECT *, {words_in_order(_SHORT('normalized_name'))} AS g FROM known),
    al AS (SELECT DISTINCT entity_type, 'also ' || n AS alias, k.entity_id FROM b JOIN known k USING (entity_type) WHERE k.normalized_name = n AND doc_id % 7 < 3),
    asked AS (SELECT DISTINCT entity_type, m, {words_in_order(_SHORT('m'))} AS f FROM b),
    near AS (SELECT entity_type, m, entity_id, f, g FROM asked JOIN kf USING (entity_type) WHERE levenshtein(f, g) <= 15 * (length(f) + length(g)) / 100.0 AND (entity_type, m) NOT IN (SELECT (entity_type, normalized_name) FROM known)),
    sc AS (SELECT entity_type, m, entity_id, 200.0::DOUBLE * {common('f', 'g')} / (length(f) + length(g)) AS score FROM near),
    best AS (SELECT entity_type, m, arg_min(entity_id, (-score, entity_id)) AS entity_id, max(score) AS score FROM sc WHERE score >= 85 GROUP BY 1, 2)"""


def _people(spark, sf):
    """(doc_id, source, entity_type, n, m): names and their mentions; settled, so that texts are read once."""
    return settled(spark.sql(f"WITH {_PEOPLE} SELECT * FROM b", documents=table(spark, sf, "documents")))


def _known(b):
    return b.where("doc_id % 3 < 2").groupBy("entity_type", F.col("n").alias("normalized_name")).agg(F.min("doc_id").alias("entity_id"), F.array_sort(F.collect_set("source")).alias("context"))


@query("fuzzy_aliases", f"WITH {_FUZZY} SELECT entity_type, m AS normalized_name, entity_id, round(score, 9) AS score FROM best")
def fuzzy_aliases(spark, sf):
    b = _people(spark, sf)
    found = H.fuzzy_aliases(b.select("entity_type", F.col("m").alias("normalized_name")), _known(b))
    return found.withColumn("score", F.round("score", 9))


@query(
    "resolved_entities",
    f"""WITH {_FUZZY}, ctx AS (SELECT entity_type, n AS normalized_name, list(DISTINCT source) AS context FROM b WHERE doc_id % 3 < 2 GROUP BY 1, 2),
    one AS (SELECT entity_type, alias, min(entity_id) AS entity_id FROM al GROUP BY 1, 2),
    h AS (SELECT b.doc_id, b.entity_type, b.m, CASE WHEN b.doc_id % 4 > 0 THEN b.source END AS src, coalesce(k.entity_id, o.entity_id, x.entity_id) AS hit,
      CASE WHEN k.entity_id IS NOT NULL THEN 'exact name' WHEN o.entity_id IS NOT NULL THEN 'known alias' WHEN x.entity_id IS NOT NULL THEN 'fuzzy match' END AS matched
      FROM b LEFT JOIN known k ON k.entity_type = b.entity_type AND k.normalized_name = b.m LEFT JOIN one o ON o.entity_type = b.entity_type AND o.alias = b.m LEFT JOIN best x ON x.entity_type = b.entity_type AND x.m = b.m),
    g AS (SELECT h.*, coalesce(list_contains(c.context, src), false) AS met FROM h LEFT JOIN known k ON k.entity_id = h.hit LEFT JOIN ctx c ON c.entity_type = k.entity_type AND c.normalized_name = k.normalized_name)
    SELECT doc_id, m AS normalized_name, CASE WHEN hit IS NULL OR (entity_type = 'PERSON' AND NOT met) THEN 'NEW_ENTITY' WHEN matched = 'fuzzy match' THEN 'NEW_ALIAS' ELSE 'MERGE' END AS action,
      CASE WHEN hit IS NULL OR (entity_type = 'PERSON' AND NOT met) THEN NULL ELSE hit END AS entity_id, matched,
      CASE WHEN hit IS NULL THEN 0.6 WHEN entity_type <> 'PERSON' THEN 0.9 WHEN met THEN 0.85 ELSE 0.5 END::DOUBLE AS confidence FROM g""",
)
def resolved_entities(spark, sf):
    b = _people(spark, sf)
    known = _known(b)
    aliases = b.where("doc_id % 7 < 3").select("entity_type", F.col("n").alias("normalized_name")).join(known, ["entity_type", "normalized_name"]).select("entity_id", F.concat(F.lit("also "), "normalized_name").alias("alias")).distinct()
    asked = b.select("doc_id", "entity_type", F.col("m").alias("normalized_name"), F.when(F.col("doc_id") % 4 > 0, F.array("source")).alias("context"))
    return H.resolve_mentions(asked, known, aliases).select("doc_id", "normalized_name", "action", "entity_id", "matched", "confidence")


@query(
    "context_names",
    f"""WITH m AS (SELECT DISTINCT doc, name FROM ({_MEN})), p AS (SELECT DISTINCT a.name, b.name AS other FROM m a JOIN m b ON a.doc = b.doc AND a.name <> b.name),
    r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY other) AS n FROM p) SELECT name, list(other ORDER BY other) AS context FROM r WHERE n <= 50 GROUP BY name""",
)
def context_names(spark, sf):
    e = table(spark, sf, "events")
    return H.context_names(e.select(F.floor(F.col("event_id") / 7).alias("doc_id"), F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("name")))


@query("upserted_entities", "SELECT event_type AS entity_type, 'n' || user_id AS normalized_name, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS mentions FROM events GROUP BY ALL")
def upserted_entities(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("entity_type"), F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("normalized_name"), F.col("ts").alias("at"), "event_id")
    none = spark.createDataFrame([], "entity_type string, normalized_name string, first_seen timestamp_ntz, last_seen timestamp_ntz, mentions long")
    return H.upsert_entities(H.upsert_entities(none, e.where("event_id % 2 = 0").drop("event_id")), e.where("event_id % 2 = 1").drop("event_id"))


_STORY = """d AS (SELECT event_id AS doc_id, ts AS seen_at, event_type, 'e' || user_id AS entity_id FROM events), s AS (SELECT story_id, t + story_id * INTERVAL 18 HOUR AS last_activity FROM (SELECT user_id % 40 AS story_id, min(ts) AS t FROM events GROUP BY 1)),
se AS (SELECT DISTINCT user_id % 40 AS story_id, 'e' || user_id AS entity_id FROM events UNION SELECT DISTINCT (user_id + 1) % 40, 'e' || user_id FROM events)"""


@query(
    "story_candidates",
    f"""WITH {_STORY}, sh AS (SELECT doc_id, story_id, count(*) AS shared FROM d JOIN se USING (entity_id) GROUP BY ALL)
    SELECT doc_id, story_id, shared FROM sh JOIN d USING (doc_id) JOIN s USING (story_id) WHERE last_activity <= seen_at AND last_activity >= seen_at - CASE event_type WHEN 'click' THEN INTERVAL 168 HOUR WHEN 'purchase' THEN INTERVAL 720 HOUR ELSE INTERVAL 72 HOUR END""",
)
def story_candidates(spark, sf):
    e = table(spark, sf, "events")
    ent = F.concat(F.lit("e"), F.col("user_id").cast("string")).alias("entity_id")
    kind = F.when(F.col("event_type") == "click", "FORUM_THREAD").when(F.col("event_type") == "purchase", "CLASSIFIED_LISTING").otherwise("NEWS_ARTICLE")
    story = (F.col("user_id") % 40).alias("story_id")
    stories = e.groupBy(story).agg(F.min("ts").alias("t")).select("story_id", (F.col("t") + F.make_dt_interval(hours=(F.col("story_id") * 18).cast("int"))).alias("last_activity"))
    of = e.select(story, ent).union(e.select(((F.col("user_id") + 1) % 40).alias("story_id"), ent)).distinct()
    return H.story_candidates(e.select(F.col("event_id").alias("doc_id"), F.col("ts").alias("at"), kind.alias("page_type")), stories, e.select(F.col("event_id").alias("doc_id"), ent), of)


@query("story_rollups", "SELECT user_id % 40 AS story_id, count(DISTINCT event_id % 500) AS documents, count(DISTINCT user_id) AS sources, min(ts) AS first_published, max(ts) AS last_published FROM events GROUP BY 1")
def story_rollups(spark, sf):
    e = table(spark, sf, "events")
    return H.story_rollup(e.select((F.col("user_id") % 40).alias("story_id"), (F.col("event_id") % 500).alias("doc_id"), F.col("user_id").alias("domain"), F.col("ts").alias("published_at")))
