"""Queries over pages and documents: URL jobs, fingerprints, copies."""

from __future__ import annotations

from pyspark.sql import functions as F

from docwatch.functions import text as X
from docwatch.functions import urls as U
from docwatch.operators import fingerprints as FP
from docwatch.plans.registry import query
from docwatch.session import settled, table

# ---- DuckDB spellings shared by the twins
SCHEME = r"lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))"
AUTHORITY = r"regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
HOST = rf"lower(regexp_replace(regexp_replace({AUTHORITY}, '^.*@', ''), ':[0-9]*$', ''))"
PATH = r"regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1)"
QUERY = r"regexp_extract(trim(url), '^[^?#]*\?([^#]*)', 1)"
_TRACK = ", ".join(f"'{t}'" for t in U.TRACKING)
NORMAL = rf"""{SCHEME} || '://' || {HOST}
 || CASE WHEN regexp_extract({AUTHORITY}, ':([0-9]+)$', 1) = '' OR ({SCHEME} = 'http' AND {AUTHORITY} LIKE '%:80') OR ({SCHEME} = 'https' AND {AUTHORITY} LIKE '%:443') THEN '' ELSE ':' || regexp_extract({AUTHORITY}, ':([0-9]+)$', 1) END
 || CASE WHEN {PATH} IN ('', '/') THEN '/' ELSE regexp_replace({PATH}, '/+$', '') END
 || coalesce('?' || nullif(array_to_string(list_transform(list_filter(string_split({QUERY}, '&'),
    lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_') AND lower(regexp_extract(x, '^([^=]*)', 1)) NOT IN ({_TRACK})),
    lambda x: replace(CASE WHEN contains(x, '=') THEN x ELSE x || '=' END, '%20', '+')), '&'), ''), '')"""
PATTERN = rf"""CASE WHEN {SCHEME} = '' THEN '' ELSE {SCHEME} || '://' || {AUTHORITY} END || '/' || array_to_string(list_transform(list_filter(string_split({PATH}, '/'), lambda s: s <> ''),
 lambda s: CASE WHEN regexp_matches(s, '(?i)^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$') THEN '{{uuid}}' WHEN regexp_matches(s, '^\d+$') THEN '{{id}}'
   WHEN regexp_matches(s, '^[\p{{L}}\p{{N}}_]+(?:[-_][\p{{L}}\p{{N}}_]+){{2,}}$') THEN '{{slug}}'
   WHEN regexp_matches(s, '(?i)^[a-z0-9]{{6,}}$') AND regexp_matches(s, '[0-9]') AND regexp_matches(s, '(?i)[a-z]') THEN '{{id}}' ELSE s END), '/')"""
TEXT = r"lower(trim(regexp_replace(text, '\s+', ' ', 'g')))"


@query("url_canonical_groups", f"SELECT {NORMAL} AS normalized_url, count(*) AS aliases, min(page_id) AS first_page FROM pages GROUP BY 1")
def url_canonical_groups(spark, sf):
    p = table(spark, sf, "pages")
    return p.groupBy(U.normalize_url(F.col("url")).alias("normalized_url")).agg(F.count("*").alias("aliases"), F.min("page_id").alias("first_page"))


@query(
    "pages_per_host",
    f"SELECT {HOST} AS host, regexp_replace({HOST}, '^www\\.', '') AS host_key, count(*) AS pages, count(DISTINCT {NORMAL}) AS urls FROM pages GROUP BY ALL",
)
def pages_per_host(spark, sf):
    p = table(spark, sf, "pages")
    return p.groupBy(U.extract_domain(F.col("url")).alias("host"), U.host_key(F.col("url")).alias("host_key")).agg(
        F.count("*").alias("pages"), F.countDistinct(U.normalize_url(F.col("url"))).alias("urls")
    )


#: A few public suffixes of two labels, for the query; a caller passes a whole list as a table.
SUFFIXES = "com net org example.com example.net co.uk".split()


@query(
    "registrable_domains",
    rf"""WITH h AS (SELECT page_id, {HOST} AS host FROM pages), s AS (SELECT unnest({SUFFIXES}) AS suffix),
    c AS (SELECT page_id, host, string_split(host, '.') AS parts FROM h),
    e AS (SELECT page_id, host, i, array_to_string(parts[i:], '.') AS suffix, array_to_string(parts[i - 1:], '.') AS site FROM (SELECT *, unnest(range(2, len(parts) + 1)) AS i FROM c)),
    m AS (SELECT page_id, arg_min(site, i) AS site FROM e JOIN s USING (suffix) GROUP BY page_id)
    SELECT coalesce(m.site, h.host) AS site, count(*) AS pages, count(DISTINCT h.host) AS hosts FROM h LEFT JOIN m USING (page_id) GROUP BY 1""",
)
def registrable_domains(spark, sf):
    from docwatch.operators.sites import registrable_domain

    suffixes = spark.createDataFrame([(s,) for s in SUFFIXES], "suffix string")
    d = registrable_domain(table(spark, sf, "pages").select("page_id", "url"), suffixes)
    return d.groupBy("site").agg(F.count("*").alias("pages"), F.countDistinct("host").alias("hosts"))


@query("url_patterns_per_host", f"SELECT {HOST} AS host, {PATTERN} AS pattern, count(*) AS pages FROM pages GROUP BY ALL")
def url_patterns_per_host(spark, sf):
    p = table(spark, sf, "pages")
    return p.groupBy(U.extract_domain(F.col("url")).alias("host"), U.url_pattern(F.col("url")).alias("pattern")).agg(F.count("*").alias("pages"))


_SINK_LINKS = "SELECT 'https://' || source || '.example.org/' || CASE doc_id % 8 WHEN 0 THEN 'account/login' WHEN 1 THEN 'a/my-account?x=1' WHEN 2 THEN 'cart' WHEN 3 THEN 'my%2Daccount' WHEN 4 THEN 'myaccount/x' ELSE lang || '/' || doc_id END AS url FROM documents"
_SINK_SET = ", ".join(f"'{s}'" for s in U.SINKS)


@query(
    "link_rejects",
    rf"""WITH u AS ({_SINK_LINKS}), r AS (SELECT url, list_filter(string_split(lower({PATH}), '/'), lambda s: s IN ({_SINK_SET}))[1] AS seg FROM u)
    SELECT coalesce(CASE WHEN seg IS NOT NULL THEN 'sink_segment:' || seg WHEN regexp_matches({PATH} || coalesce('?' || nullif({QUERY}, ''), ''), '{U.SINK_PATH}') THEN 'sink_path_pattern' END, 'kept') AS reason, count(*) AS links FROM r GROUP BY 1""",
)
def link_rejects(spark, sf):
    d = table(spark, sf, "documents")
    k = F.col("doc_id") % 8
    tail = F.when(k == 0, "account/login").when(k == 1, "a/my-account?x=1").when(k == 2, "cart").when(k == 3, "my%2Daccount").when(k == 4, "myaccount/x").otherwise(F.concat("lang", F.lit("/"), "doc_id"))
    u = d.select(F.concat(F.lit("https://"), "source", F.lit(".example.org/"), tail).alias("url"))
    return u.groupBy(F.coalesce(U.sink_reason(F.col("url")), F.lit("kept")).alias("reason")).agg(F.count("*").alias("links"))


@query(
    "pagination_patterns",
    r"""WITH p AS (SELECT url, regexp_replace(url, '(?i)([?&](?:page|pg|p)=)\d+', '\1{page}', 'g') AS p FROM pages),
    q AS (SELECT CASE WHEN p = url THEN regexp_replace(url, '(?i)/page[/-]\d+/?$', '/page/{page}') ELSE p END AS p FROM p)
    SELECT p AS pattern, count(*) AS pages FROM q GROUP BY 1""",
)
def pagination_patterns(spark, sf):
    return table(spark, sf, "pages").groupBy(U.pagination_pattern(F.col("url")).alias("pattern")).agg(F.count("*").alias("pages"))


_FORUM = """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'https://www.reddit.com/r/' || source || '/comments/' || doc_id || '/t/c' || doc_id % 9
  WHEN 1 THEN 'old.reddit.com/r/' || source || '/comments/' || doc_id WHEN 2 THEN 'https://redd.it/' || doc_id WHEN 3 THEN 'https://reddit.com/r/' || source || '/'
  WHEN 4 THEN 'https://www.reddit.com/user/u' || doc_id % 5 || '/comments/' || doc_id ELSE 'https://t.me/' || source || '/' || doc_id END AS url FROM documents"""


@query(
    "forum_links",
    rf"""WITH l AS ({_FORUM}) SELECT CASE doc_id % 6 WHEN 0 THEN 'comment' WHEN 3 THEN 'subreddit' ELSE 'post' END AS kind,
    CASE WHEN doc_id % 6 IN (0, 1, 3) THEN regexp_extract(url, '/r/([^/]+)', 1) END AS subreddit, count(*) AS links,
    count(DISTINCT CASE WHEN doc_id % 6 <> 3 THEN doc_id END) AS posts FROM l WHERE doc_id % 6 < 5 GROUP BY ALL""",
)
def forum_links(spark, sf):
    d = table(spark, sf, "documents")
    k, i = F.col("doc_id") % 6, F.col("doc_id").cast("string")
    c = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    s = F.col("source")
    url = (
        F.when(k == 0, c("https://www.reddit.com/r/", s, "/comments/", i, "/t/c", (F.col("doc_id") % 9).cast("string")))
        .when(k == 1, c("old.reddit.com/r/", s, "/comments/", i))
        .when(k == 2, c("https://redd.it/", i))
        .when(k == 3, c("https://reddit.com/r/", s, "/"))
        .when(k == 4, c("https://www.reddit.com/user/u", (F.col("doc_id") % 5).cast("string"), "/comments/", i))
        .otherwise(c("https://t.me/", s, "/", i))
    )
    r = d.select(U.classify_forum_url(url).alias("r")).where("r IS NOT NULL")
    return r.groupBy("r.kind", "r.subreddit").agg(F.count("*").alias("links"), F.countDistinct("r.post_id").alias("posts"))


@query(
    "channel_links",
    """WITH r AS (SELECT source AS s, doc_id % 5 AS k FROM documents)
    SELECT CASE k WHEN 0 THEN 'username' WHEN 1 THEN 'invite_hash' WHEN 2 THEN 'numeric_id' ELSE 'username' END AS kind,
    CASE k WHEN 0 THEN '@' || lower(s) || '_ch' WHEN 1 THEN 'https://t.me/+' || s || 'Hash' WHEN 2 THEN '-100' || substr(s, 4) ELSE '@' || lower(s) || '_at' END AS normalized, count(*) AS links
    FROM r WHERE k < 4 GROUP BY ALL""",
)
def channel_links(spark, sf):
    d = table(spark, sf, "documents").select("source", (F.col("doc_id") % 5).alias("k"))
    c = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    s = F.col("source")
    url = F.when(F.col("k") == 0, c("https://t.me/", s, "_ch/")).when(F.col("k") == 1, c("t.me/joinchat/", s, "Hash")).when(F.col("k") == 4, c("https://bit.ly/", s))
    typed = F.when(F.col("k") == 2, c("-100", F.substring(s, 4, 9))).when(F.col("k") == 3, c("@", s, "_AT"))
    r = d.select(F.coalesce(U.classify_channel_url(url), U.normalize_channel_id(typed)).alias("r")).where("r IS NOT NULL")
    return r.groupBy("r.kind", "r.normalized").agg(F.count("*").alias("links"))


@query(
    "identifiers",
    """WITH r AS (SELECT CASE doc_id % 6 WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'PHONE' WHEN 2 THEN 'DOMAIN' WHEN 3 THEN 'USERNAME' WHEN 4 THEN 'PERSON_NAME' END AS type,
    CASE doc_id % 6 WHEN 0 THEN lower(source) || '@mail.example.com' WHEN 1 THEN '+1555000' || lpad((doc_id % 40)::VARCHAR, 4, '0') WHEN 2 THEN source || '.example.org' WHEN 3 THEN lower(source) WHEN 4 THEN 'Anna Berta' END AS value FROM documents)
    SELECT type, value, count(*) AS seen FROM r WHERE type IS NOT NULL GROUP BY ALL""",
)
def identifiers(spark, sf):
    d = table(spark, sf, "documents")
    k, s = F.col("doc_id") % 6, F.col("source")
    c = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    raw = (
        F.when(k == 0, c(" ", F.upper(s), "@Mail.Example.com"))
        .when(k == 1, c("+1 (555) 000-", F.lpad((F.col("doc_id") % 40).cast("string"), 4, "0")))
        .when(k == 2, c("https://www.", s, ".example.org/x"))
        .when(k == 3, c("@", F.upper(s)))
        .when(k == 4, "anna   BERTA")
        .otherwise("  ")
    )
    r = d.select(U.normalize_identifier(raw).alias("r")).where("r IS NOT NULL")
    return r.groupBy("r.type", "r.value").agg(F.count("*").alias("seen"))


@query(
    "profile_handles",
    """SELECT lower(source) || '_x' AS handle, count(*) AS links FROM documents WHERE doc_id % 4 IN (0, 1) GROUP BY 1""",
)
def profile_handles(spark, sf):
    d = table(spark, sf, "documents")
    k = F.col("doc_id") % 4
    url = F.when(k == 0, F.concat(F.lit("https://github.com/"), "source", F.lit("_x/"))).when(k == 1, F.concat(F.lit("https://www.X.com/"), "source", F.lit("_x"))).when(k == 2, "https://x.com/login").otherwise("https://example.com/a")
    return d.select(U.profile_handle(url).alias("handle")).where("handle IS NOT NULL").groupBy("handle").agg(F.count("*").alias("links"))


@query("document_fingerprints", f"SELECT doc_id, sha256(text) AS content_hash, sha256({TEXT}) AS normalized_hash, sha256(lower(trim(regexp_replace(substring(text, 1, 60), '\\s+', ' ', 'g')))) AS title_hash FROM documents")
def document_fingerprints(spark, sf):
    d = table(spark, sf, "documents").withColumn("title", F.substring("text", 1, 60))
    return FP.fingerprints(d, "text", "title").select("doc_id", "content_hash", "normalized_hash", "title_hash")


_SIMHASH = rf"""t AS (SELECT doc_id, unnest(regexp_extract_all({TEXT}, '[\p{{L}}\p{{N}}_]+')) AS w FROM documents),
h AS (SELECT doc_id, w, count(*) AS c, ('0x' || substr(md5(w), 17, 8))::BIGINT AS hi, ('0x' || substr(md5(w), 25, 8))::BIGINT AS lo FROM t GROUP BY ALL),
b AS (SELECT doc_id, bit, sum(CASE WHEN (CASE WHEN bit < 32 THEN lo >> bit ELSE hi >> (bit - 32) END) & 1 = 1 THEN c ELSE -c END) AS s FROM h, range(64) r(bit) GROUP BY ALL),
f AS (SELECT doc_id, sum(CASE WHEN s > 0 THEN CASE WHEN bit = 63 THEN -9223372036854775808::HUGEINT ELSE (1::HUGEINT << bit::INT) END ELSE 0 END)::BIGINT AS simhash FROM b GROUP BY doc_id),
sim AS (SELECT d.doc_id, coalesce(f.simhash, 0) AS simhash FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN f USING (doc_id))"""


@query("document_simhash", f"WITH {_SIMHASH} SELECT * FROM sim")
def document_simhash(spark, sf):
    return FP.simhash64(table(spark, sf, "documents"))


@query(
    "near_duplicate_pairs",
    f"""WITH {_SIMHASH}, c AS (SELECT simhash, min(doc_id) AS id, count(*) AS copies FROM sim WHERE simhash <> 0 GROUP BY simhash)
    SELECT a.id AS doc_a, b.id AS doc_b, bit_count(xor(a.simhash, b.simhash))::INT AS distance, a.copies AS copies_a, b.copies AS copies_b
    FROM c a JOIN c b ON a.id < b.id AND bit_count(xor(a.simhash, b.simhash)) <= 3""",
)
def near_duplicate_pairs(spark, sf):
    return FP.near_duplicate_pairs(FP.simhash64(table(spark, sf, "documents")))


@query(
    "simhash_tiers",
    f"""WITH {_SIMHASH}, p AS (SELECT a.simhash AS x, b.simhash AS y FROM sim a JOIN sim b ON b.doc_id = a.doc_id + 1)
    SELECT CASE WHEN bit_count(xor(x, y)) <= 3 THEN 'near_identical' WHEN bit_count(xor(x, y)) <= 12 THEN 'moderate' ELSE 'large' END AS tier, count(*) AS pairs,
    min(1 - bit_count(xor(x, y)) / 64.0::DOUBLE) AS least_similarity FROM p GROUP BY 1""",
)
def simhash_tiers(spark, sf):
    h = settled(FP.simhash64(table(spark, sf, "documents")))
    nxt = h.select((F.col("doc_id") - 1).alias("doc_id"), F.col("simhash").alias("y"))
    p = h.join(nxt, "doc_id")
    a, b = F.col("simhash"), F.col("y")
    return p.groupBy(X.simhash_tier(a, b).alias("tier")).agg(F.count("*").alias("pairs"), F.min(X.simhash_similarity(a, b)).alias("least_similarity"))


@query(
    "duplicate_of",
    f"""WITH h AS (SELECT doc_id, sha256({TEXT}) AS normalized_hash FROM documents)
    SELECT doc_id, normalized_hash, CASE WHEN min(doc_id) OVER (PARTITION BY normalized_hash) <> doc_id THEN min(doc_id) OVER (PARTITION BY normalized_hash) END AS near_duplicate_of FROM h""",
)
def duplicate_of(spark, sf):
    return FP.duplicate_of(table(spark, sf, "documents"))
