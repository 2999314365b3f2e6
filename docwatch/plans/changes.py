"""Queries over two captures of the documents: changes and versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from docwatch.functions import text as X
from docwatch.operators import changes as C
from docwatch.operators import fingerprints as FP
from docwatch.plans.bindings import FETCH_OUTCOMES, SNAPSHOT_CURR, SNAPSHOT_PREV, bind, duck
from docwatch.plans.pages_docs import _SIMHASH
from docwatch.plans.registry import query

_P, _C = duck(SNAPSHOT_PREV, "documents"), duck(SNAPSHOT_CURR, "documents")
_N = lambda c: f"lower(trim(regexp_replace({c}, '\\s+', ' ', 'g')))"


def _snapshots(spark, sf):
    return bind(spark, sf, SNAPSHOT_PREV, "documents"), bind(spark, sf, SNAPSHOT_CURR, "documents")


def _with_simhash(df):
    return df.join(FP.simhash64(df.select("normalized_url", "body"), "normalized_url", "body"), "normalized_url")


# A changed news body gets a paragraph after a blank line: a text of lines without one is then another split, and all its lines count as moved.
@query(
    "detect_changes",
    f"""WITH p AS ({_P}), c AS ({_C}),
    j AS (SELECT c.normalized_url, c.page_type, trim(p.title) <> trim(c.title) AS t, {_N('p.body')} <> {_N('c.body')} AS b, p.price <> c.price AS pr, p.status <> c.status AS s,
      NOT contains(p.body, chr(10) || chr(10)) AND len(list_filter(string_split(p.body, chr(10)), lambda x: trim(x) <> '')) >= 3 AS many FROM p JOIN c USING (normalized_url)),
    k AS (SELECT *, CASE WHEN page_type = 'NEWS_ARTICLE' THEN CASE WHEN t AND b THEN 'ARTICLE_UPDATED' WHEN t THEN 'TITLE_CHANGED' WHEN b THEN 'CONTENT_CHANGED' WHEN pr OR s THEN 'METADATA_CHANGED' END
      WHEN page_type = 'CLASSIFIED_LISTING' THEN CASE WHEN pr THEN 'PRICE_CHANGED' WHEN s THEN 'STATUS_CHANGED' WHEN b THEN 'DESCRIPTION_CHANGED' WHEN t THEN 'METADATA_CHANGED' END
      ELSE CASE WHEN b THEN 'CONTENT_CHANGED' WHEN t THEN 'METADATA_CHANGED' END END AS kind FROM j)
    SELECT normalized_url, page_type, kind IS NOT NULL AS changed, coalesce(kind, 'NO_CHANGE') AS change_type,
    CASE WHEN kind IS NULL THEN 'NONE' WHEN page_type = 'NEWS_ARTICLE' THEN CASE WHEN t AND b THEN 'HIGH' WHEN t THEN 'MEDIUM' WHEN b AND many THEN 'HIGH' WHEN b THEN 'MEDIUM' ELSE 'LOW' END
      WHEN page_type = 'CLASSIFIED_LISTING' THEN CASE WHEN pr OR s THEN 'HIGH' WHEN b THEN 'MEDIUM' ELSE 'LOW' END ELSE 'LOW' END AS severity,
    CASE WHEN kind IS NULL THEN 1.0 WHEN page_type IN ('NEWS_ARTICLE', 'CLASSIFIED_LISTING') THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence,
    CASE WHEN kind IS NULL THEN [] ELSE list_filter([CASE WHEN t THEN 'title' END, CASE WHEN b THEN CASE WHEN page_type = 'CLASSIFIED_LISTING' THEN 'description' ELSE 'body' END END,
      CASE WHEN pr AND page_type = 'CLASSIFIED_LISTING' THEN 'price' END, CASE WHEN s AND page_type = 'CLASSIFIED_LISTING' THEN 'status' END], lambda x: x IS NOT NULL) END AS changed_fields FROM k""",
)
def detect_changes(spark, sf):
    p, c = _snapshots(spark, sf)
    blank = F.lit(None).cast("long")
    return C.detect_changes(p.withColumn("simhash", blank), c.withColumn("simhash", blank)).drop("similarity")


@query(
    "generic_change_tiers",
    f"""WITH {_SIMHASH}, p AS ({_P}), c AS ({_C}), ps AS (SELECT p.normalized_url, simhash FROM p JOIN sim USING (doc_id))
    SELECT c.page_type, count(*) AS pages, count(*) FILTER ({_N('p.body')} <> {_N('c.body')}) AS bodies_changed FROM p JOIN c USING (normalized_url) GROUP BY 1""",
)
def generic_change_tiers(spark, sf):
    p, c = _snapshots(spark, sf)
    d = C.detect_changes(_with_simhash(p), _with_simhash(c))
    body = F.array_contains("changed_fields", "body") | F.array_contains("changed_fields", "description")
    return d.groupBy("page_type").agg(F.count("*").alias("pages"), F.count_if(body).alias("bodies_changed"))


@query("paragraph_diffs")
def paragraph_diffs(spark, sf):
    p, c = _snapshots(spark, sf)
    j = p.select("normalized_url", F.col("body").alias("old")).join(c.select("normalized_url", F.col("body").alias("new")), "normalized_url")
    j = j.where(X.normalize_text(F.col("old")) != X.normalize_text(F.col("new")))
    return j.select("normalized_url", C.paragraph_diff("old", "new").alias("d")).select("normalized_url", "d.*")


@query("version_line_diffs")
def version_line_diffs(spark, sf):
    p, c = _snapshots(spark, sf)
    j = p.select("normalized_url", F.col("body").alias("old")).join(c.select("normalized_url", F.col("body").alias("new")), "normalized_url").where("old <> new")
    return j.select("normalized_url", C.line_diff("old", "new").alias("d")).select("normalized_url", "d.*")


@query(
    "field_diffs",
    f"""WITH p AS ({_P}), c AS ({_C}) SELECT normalized_url, trim(p.status) <> trim(c.status) AS status_changed, (c.price - p.price)::DOUBLE AS delta,
    round_even((c.price - p.price) / p.price * 100, 2)::DOUBLE AS percentage,
    list_sort(list_filter(string_split(c.title, ' '), lambda x: NOT list_contains(string_split(p.title, ' '), x)))[1] AS first_added FROM p JOIN c USING (normalized_url) WHERE p.price <> c.price OR p.title <> c.title""",
)
def field_diffs(spark, sf):
    p, c = _snapshots(spark, sf)
    old = p.select("normalized_url", *[F.col(x).alias(f"p_{x}") for x in ("status", "price", "title")])
    j = old.join(c, "normalized_url").where("p_price <> price OR p_title <> title")
    n = X.number_diff(F.col("p_price").cast("double"), F.col("price").cast("double"))
    words = X.list_diff(F.split("p_title", " "), F.split("title", " "))
    return j.select(
        "normalized_url", X.scalar_changed(F.col("p_status"), F.col("status")).alias("status_changed"),
        F.coalesce(n["delta"], F.lit(0.0)).alias("delta"), F.coalesce(n["percentage"], F.lit(0.0)).alias("percentage"),
        F.try_element_at(words["added"], F.lit(1)).alias("first_added"),
    )


_ITEMS_P = f"SELECT concat('https://', split_part(split_part(normalized_url, '/', 3), '.', 1), '.example.org') AS site, CAST(doc_id AS STRING) AS id, price, status, body FROM ({{x}})"


def _items(df):
    site = F.concat(F.lit("https://"), F.split_part(F.split_part("normalized_url", F.lit("/"), F.lit(3)), F.lit("."), F.lit(1)), F.lit(".example.org"))
    return df.select(site.alias("site"), F.col("doc_id").cast("string").alias("id"), "price", "status", "body")


_FULL = f"""p AS ({_ITEMS_P.replace('{x}', _P)}), c AS ({_ITEMS_P.replace('{x}', _C)} WHERE doc_id % 5 <> 1), q AS (SELECT * FROM p WHERE id::BIGINT % 5 <> 2),
j AS (SELECT coalesce(q.site, c.site) AS site, q.id AS pid, c.id AS cid, q.price AS pp, c.price AS cp, q.status AS ps, c.status AS cs, q.body AS pb, c.body AS cb FROM q FULL JOIN c ON q.site = c.site AND q.id = c.id)"""


@query(
    "index_changes",
    f"""WITH {_FULL}, a AS (SELECT site, count(*) FILTER (pid IS NULL) AS added, count(*) FILTER (cid IS NULL) AS removed, count(*) FILTER (pid IS NOT NULL AND cid IS NOT NULL AND pp <> cp) AS price_changed,
    count(*) FILTER (pid IS NOT NULL AND cid IS NOT NULL AND ps <> cs) AS status_changed, round(count(*) FILTER (pid IS NOT NULL AND cid IS NOT NULL) / count(*), 6) AS similarity FROM j GROUP BY site)
    SELECT *, CASE WHEN added + removed + price_changed + status_changed = 0 THEN 'NO_CHANGE' WHEN added > 0 AND removed = 0 THEN 'LISTING_ADDED' WHEN removed > 0 AND added = 0 THEN 'LISTING_REMOVED' WHEN price_changed > 0 THEN 'PRICE_CHANGED'
    WHEN status_changed > 0 THEN 'STATUS_CHANGED' ELSE 'STRUCTURE_CHANGED' END AS change_type, CASE WHEN added + removed + price_changed + status_changed = 0 THEN 'NONE' WHEN added + removed + price_changed > 0 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM a""",
)
def index_changes(spark, sf):
    p, c = _snapshots(spark, sf)
    p, c = _items(p.where("doc_id % 5 <> 2")), _items(c.where("doc_id % 5 <> 1"))
    return C.index_change_type(C.collection_changes(p, c, "site", "id", ["price", "status"])).withColumn("similarity", F.round("similarity", 6))


@query(
    "thread_changes",
    f"""WITH {_FULL}, a AS (SELECT site, count(*) FILTER (pid IS NULL) AS added, count(*) FILTER (cid IS NULL) AS removed, count(*) FILTER (pid IS NOT NULL AND cid IS NOT NULL AND {_N('pb')} <> {_N('cb')}) AS body_changed,
    round(count(*) FILTER (pid IS NOT NULL AND cid IS NOT NULL) / count(*), 6) AS similarity FROM j GROUP BY site)
    SELECT *, CASE WHEN removed > 0 THEN 'POST_REMOVED' WHEN body_changed > 0 THEN 'POST_EDITED' WHEN added > 0 THEN 'NEW_POSTS' ELSE 'NO_CHANGE' END AS change_type,
    CASE WHEN removed > 0 THEN 'HIGH' WHEN body_changed > 0 THEN 'MEDIUM' WHEN added >= 10 THEN 'HIGH' WHEN added > 0 THEN 'MEDIUM' ELSE 'NONE' END AS severity FROM a""",
)
def thread_changes(spark, sf):
    p, c = _snapshots(spark, sf)
    n = X.normalize_text(F.col("body"))
    p, c = _items(p.where("doc_id % 5 <> 2")).withColumn("body", n), _items(c.where("doc_id % 5 <> 1")).withColumn("body", n)
    return C.thread_change_type(C.collection_changes(p, c, "site", "id", ["body"])).withColumn("similarity", F.round("similarity", 6))


def _versions(spark, sf):
    p, c = _snapshots(spark, sf)
    as_version = lambda df, day: df.select("normalized_url", X.text_hash(F.col("body")).alias("content_hash"), F.lit(f"2024-01-0{day}").cast("timestamp_ntz").alias("collected_at"))
    first = as_version(p, 1).withColumn("version", F.lit(1))
    second = C.append_versions(first, as_version(c, 2).withColumn("blocked", F.col("normalized_url").endswith("7")))
    both = first.withColumn("status", F.lit("NEW")).unionByName(second)
    third = as_version(c.withColumn("body", F.concat("body", F.lit("."))), 3).withColumn("blocked", F.lit(False))
    return both.unionByName(C.append_versions(both, third))


_H = lambda c: f"sha256({_N(c)})"
_VERSIONS = f"""p AS ({_P}), c AS ({_C}), v1 AS (SELECT normalized_url, {_H('body')} AS content_hash, TIMESTAMP '2024-01-01' AS collected_at, 1 AS version, 'NEW' AS status FROM p),
v2 AS (SELECT c.normalized_url, {_H('c.body')} AS content_hash, TIMESTAMP '2024-01-02' AS collected_at, 2 AS version, 'UPDATED' AS status FROM c JOIN v1 USING (normalized_url) WHERE NOT ends_with(c.normalized_url, '7') AND {_H('c.body')} <> v1.content_hash),
b AS (SELECT * FROM v1 UNION ALL SELECT * FROM v2), l AS (SELECT normalized_url, max(version) AS lv, arg_max(content_hash, version) AS lh FROM b GROUP BY 1),
v3 AS (SELECT c.normalized_url, {_H("c.body || '.'")} AS content_hash, TIMESTAMP '2024-01-03' AS collected_at, l.lv + 1 AS version, 'UPDATED' AS status FROM c JOIN l USING (normalized_url) WHERE {_H("c.body || '.'")} <> l.lh),
v AS (SELECT * FROM b UNION ALL SELECT * FROM v3)"""


@query("document_versions", f"WITH {_VERSIONS} SELECT * , lead(collected_at) OVER w AS valid_to, lead(version) OVER w IS NULL AS is_latest FROM v WINDOW w AS (PARTITION BY normalized_url ORDER BY version)")
def document_versions(spark, sf):
    return C.history(_versions(spark, sf))


@query(
    "listed_changes",
    f"""WITH {_VERSIONS}, h AS (SELECT *, lag(content_hash) OVER (PARTITION BY normalized_url ORDER BY version) AS previous_hash FROM v)
    SELECT normalized_url, version, content_hash, previous_hash FROM h WHERE status = 'UPDATED' AND collected_at <= TIMESTAMP '2024-01-05' ORDER BY collected_at DESC, normalized_url, version LIMIT 300""",
)
def listed_changes(spark, sf):
    return C.list_changes(_versions(spark, sf), most=300).select("normalized_url", "version", "content_hash", "previous_hash")


@query("versions_as_of", f"WITH {_VERSIONS} SELECT normalized_url, max(version) AS version, arg_max(content_hash, version) AS content_hash FROM v WHERE collected_at <= TIMESTAMP '2024-01-02' GROUP BY 1")
def versions_as_of(spark, sf):
    return C.version_as_of(_versions(spark, sf), F.lit("2024-01-02").cast("timestamp_ntz")).select("normalized_url", "version", "content_hash")


@query(
    "run_stats",
    f"""WITH o AS ({duck(FETCH_OUTCOMES, 'events')}) SELECT domain AS job_id, count(*) AS attempted, count(*) FILTER (success) AS fetched, count(*) FILTER (NOT success) AS failed,
    count(*) FILTER (outcome_id % 3 = 0 AND success) AS new, count(*) FILTER (outcome_id % 3 = 1 AND success) AS updated, count(*) FILTER (outcome_id % 3 = 2 AND success) AS unchanged,
    count(*) FILTER (strategy = 'http') AS http, count(*) FILTER (strategy = 'browser') AS browser, coalesce(sum(content_bytes), 0)::BIGINT AS bytes FROM o GROUP BY 1""",
)
def run_stats(spark, sf):
    o = bind(spark, sf, FETCH_OUTCOMES, "events")
    change = F.when(F.col("success"), F.element_at(F.array(F.lit("NEW"), F.lit("UPDATED"), F.lit("UNCHANGED")), (F.col("outcome_id") % 3 + 1).cast("int")))
    return C.run_stats(o.select(F.col("domain").alias("job_id"), F.col("success").alias("fetched"), "strategy", change.alias("change"), "content_bytes"))
