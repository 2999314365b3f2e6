"""Queries over messages, feed posts and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from docwatch.functions import text as X
from docwatch.operators import feeds as L
from docwatch.operators import messages as K
from docwatch.operators import search as J
from docwatch.plans.bindings import MESSAGES, POSTS, bind, duck
from docwatch.plans.pages_docs import TEXT
from docwatch.plans.registry import query
from docwatch.session import table

_M, _PO = duck(MESSAGES, "conversations"), duck(POSTS, "documents").replace("AS STRING", "AS VARCHAR")


def _messages(spark, sf):
    return bind(spark, sf, MESSAGES, "conversations")


def _posts(spark, sf):
    return bind(spark, sf, POSTS, "documents")


@query("insert_ignore", "SELECT doc_id % 300 AS id, count(*) AS offered FROM documents WHERE doc_id % 300 NOT IN (SELECT event_id % 100 FROM events) GROUP BY 1")
def insert_ignore(spark, sf):
    d, e = table(spark, sf, "documents"), table(spark, sf, "events")
    batch = d.select((F.col("doc_id") % 300).alias("id"))
    new = K.insert_ignore(e.select((F.col("event_id") % 100).alias("id")), batch, ["id"])
    return new.join(batch.groupBy("id").agg(F.count("*").alias("offered")), "id")


@query("media_rows", f"SELECT source_id, message_id, media_type FROM ({_M}) WHERE media_type IS NOT NULL")
def media_rows(spark, sf):
    return K.explode_media(_messages(spark, sf))


@query("normalized_messages", f"SELECT source_id, message_id, nullif(trim(text), '') AS text, 'https://t.me/' || sender_username || '/' || message_id AS message_url, media_type IS NOT NULL AS has_media FROM ({_M})")
def normalized_messages(spark, sf):
    return K.normalize_messages(_messages(spark, sf), F.col("sender_username")).select("source_id", "message_id", "text", "message_url", "has_media")


_CP = "SELECT source_id, max(message_id) // 2 AS checkpoint FROM m GROUP BY source_id"


@query(
    "collect_incremental",
    f"""WITH m AS ({_M}), cp AS ({_CP}), n AS (SELECT m.source_id, message_id, row_number() OVER (PARTITION BY m.source_id ORDER BY message_id) AS rn FROM m JOIN cp USING (source_id) WHERE message_id > checkpoint)
    SELECT source_id, message_id FROM n WHERE rn <= 3 AND message_id % 4 <> 1""",
)
def collect_incremental(spark, sf):
    m = _messages(spark, sf).dropDuplicates(["source_id", "message_id"])
    cp = K.checkpoints(m).withColumn("checkpoint", F.floor(F.col("checkpoint") / 2))
    return K.collect_incremental(m, m.where("message_id % 4 = 1"), cp, 3).select("source_id", "message_id")


@query(
    "collect_backfill",
    f"""WITH m AS ({_M}), cp AS ({_CP}), n AS (SELECT m.source_id, message_id, row_number() OVER (PARTITION BY m.source_id ORDER BY message_id DESC) AS rn FROM m JOIN cp USING (source_id)
    WHERE message_id < checkpoint AND message_date >= TIMESTAMP '2024-01-02') SELECT source_id, message_id FROM n WHERE rn <= 2""",
)
def collect_backfill(spark, sf):
    m = _messages(spark, sf)
    cp = K.checkpoints(m).withColumn("checkpoint", F.floor(F.col("checkpoint") / 2))
    return K.collect_backfill(m, cp, F.lit("2024-01-02").cast("timestamp"), 2).select("source_id", "message_id")


@query("search_messages", f"SELECT source_id, message_id FROM ({_M}) WHERE contains(lower(text), 'er') AND sender_username = 'user' AND message_date >= TIMESTAMP '2024-01-01 12:00:00' AND message_date <= TIMESTAMP '2024-01-05'")
def search_messages(spark, sf):
    return K.search_messages(_messages(spark, sf), "ER", "user", "2024-01-01 12:00:00", "2024-01-05").select("source_id", "message_id")


@query("counted_by_source", f"SELECT source_id, count(*) AS n, min(message_date) AS first_date, max(message_date) AS last_date FROM ({_M}) WHERE contains(lower(text), 'er') GROUP BY 1")
def counted_by_source(spark, sf):
    return K.count_by_source(K.search_messages(_messages(spark, sf), "er"))


@query("newest_messages", f"SELECT source_id, message_id, message_date FROM ({_M}) WHERE contains(lower(text), 'er') ORDER BY message_date DESC NULLS LAST, message_id DESC, source_id LIMIT 40")
def newest_messages(spark, sf):
    return K.newest(K.search_messages(_messages(spark, sf), "er"), 40).select("source_id", "message_id", "message_date")


@query("filter_results", f"SELECT source_id, message_id FROM ({_M}) WHERE media_type = 'photo' AND (message_date IS NULL OR message_date >= TIMESTAMP '2024-01-03')")
def filter_results(spark, sf):
    return K.search_messages(_messages(spark, sf), media="photo", start="2024-01-03", dates="lenient").select("source_id", "message_id")


@query(
    "keyset_page",
    """WITH p AS (SELECT event_id, event_type FROM events WHERE event_id < 700 ORDER BY event_id DESC LIMIT 51) SELECT event_id, event_type, count(*) OVER () > 50 AS has_more, CASE WHEN count(*) OVER () > 50 THEN (SELECT min(event_id) FROM (SELECT event_id FROM p ORDER BY event_id DESC LIMIT 50)) END AS next_cursor
    FROM p QUALIFY row_number() OVER (ORDER BY event_id DESC) <= 50""",
)
def keyset_page(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type")
    page = K.keyset_page(e, 700, 50, "event_id")
    return page.select("event_id", "event_type", "has_more", F.when(F.col("has_more"), F.min("event_id").over(_whole())).alias("next_cursor"))


def _whole():
    from pyspark.sql.window import Window

    return Window.partitionBy()


@query(
    "multi_source_search",
    f"""WITH m AS ({_M}), s AS (SELECT source_id, CASE source_id % 4 WHEN 0 THEN 'monitoring' WHEN 1 THEN 'joined' WHEN 2 THEN 'error' ELSE 'disabled' END AS st FROM (SELECT DISTINCT source_id FROM m))
    SELECT source_id, message_id, NULL AS skipped FROM m JOIN s USING (source_id) WHERE st IN ('monitoring', 'joined') AND contains(lower(text), 'an') UNION ALL SELECT source_id, NULL, 'status:' || st FROM s WHERE st NOT IN ('monitoring', 'joined')""",
)
def multi_source_search(spark, sf):
    m = _messages(spark, sf)
    st = F.element_at(F.array(*map(F.lit, ("monitoring", "joined", "error", "disabled"))), (F.col("source_id") % 4 + 1).cast("int"))
    s = m.select("source_id").distinct().withColumn("access_status", st)
    return K.multi_source_search(s, m, "an", ["monitoring", "joined"])


@query("channel_summary", f"WITH m AS ({_M}) SELECT coalesce(nullif(media_type, ''), nullif(sender_username, ''), 'unknown') AS label, min(source_id) AS first_seen, count(*) AS messages FROM m GROUP BY 1")
def channel_summary(spark, sf):
    return K.channel_summary(_messages(spark, sf), ["media_type", "sender_username"], "source_id")


@query(
    "discovered_links",
    f"""WITH m AS ({_M}) SELECT 'username' AS kind, '@chan' || source_id % 9 AS normalized, count(*) AS mentions, min(source_id) AS first_source, min_by(message_id, (source_id, message_id)) AS first_message, source_id % 9 < 4 AS already_known FROM m WHERE message_id % 3 = 0 GROUP BY ALL""",
)
def discovered_links(spark, sf):
    m = _messages(spark, sf)
    link = F.when(F.col("message_id") % 3 == 0, F.concat(F.lit(" see https://t.me/Chan"), (F.col("source_id") % 9).cast("string"), F.lit(". and http://bit.ly/x")))
    m = m.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.coalesce(link, F.lit(""))))
    known = spark.range(4).select(F.concat(F.lit("@chan"), F.col("id").cast("string")).alias("normalized"))
    return K.discover_links(m, known)


@query("dedupe_sources", "SELECT doc_id AS id, source || '/' || lang AS entity_id, min(doc_id) OVER (PARTITION BY source || '/' || lang) AS canonical_id FROM documents")
def dedupe_sources(spark, sf):
    return K.dedupe_sources(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat_ws("/", "source", "lang").alias("entity_id")))


_STATES = "discovered accessible monitoring error disabled".split()
_HIST = f"SELECT user_id % 50 AS source_id, event_id, {_STATES}[(event_id * 7 + user_id) % 5 + 1] AS state FROM events"
_PAIRS = ", ".join(f"('{a}', '{b}')" for a, to in K.TRANSITIONS.items() for b in to.split())


def _history(spark, sf):
    return table(spark, sf, "events").select((F.col("user_id") % 50).alias("source_id"), "event_id", F.element_at(F.array(*map(F.lit, _STATES)), ((F.col("event_id") * 7 + F.col("user_id")) % 5 + 1).cast("int")).alias("state"))


@query(
    "state_transitions",
    f"""WITH h AS (SELECT *, lag(state) OVER (PARTITION BY source_id ORDER BY event_id) AS previous FROM ({_HIST})), t AS (SELECT * FROM (VALUES {_PAIRS}) v(a, b))
    SELECT previous, state, previous IS NULL OR (previous, state) IN (SELECT (a, b) FROM t) AS valid, state IN ('error', 'disabled') AS must_not_monitor, count(*) AS n FROM h GROUP BY ALL""",
)
def state_transitions(spark, sf):
    return K.transitions(_history(spark, sf), "source_id", ["event_id"]).groupBy("previous", "state", "valid", "must_not_monitor").agg(F.count("*").alias("n"))


@query(
    "notifications",
    f"SELECT * FROM (SELECT source_id, event_id, lag(state) OVER (PARTITION BY source_id ORDER BY event_id) AS previous, state FROM ({_HIST})) WHERE previous <> state",
)
def notifications(spark, sf):
    return K.notifications(_history(spark, sf), "source_id", ["event_id"])


_HAY = r"lower(regexp_replace(title || ' ' || content, '\s+', ' ', 'g'))"
_TERMS = ["the  AND", "que", "tion th"]


@query(
    "keyword_matches",
    rf"""WITH p AS (SELECT doc_id, {_HAY} AS h FROM ({_PO})) SELECT doc_id, list_filter([CASE WHEN contains(h, 'the and') THEN 'the and' END, CASE WHEN contains(h, 'que') THEN 'que' END, CASE WHEN contains(h, 'tion th') THEN 'tion th' END, CASE WHEN contains(h, 'idiot') THEN 'idiot' END], lambda x: x IS NOT NULL) AS matched_keywords,
    contains(h, 'idiot') OR (contains(h, 'the and')::INT + contains(h, 'que')::INT + contains(h, 'tion th')::INT) >= 2 AS signal FROM p WHERE NOT contains(h, 'pour les')""",
)
def keyword_matches(spark, sf):
    return L.match_keywords(_posts(spark, sf), _TERMS, ["Idiot"], ["pour  les"], min_matches=2).select("doc_id", "matched_keywords", "signal")


@query("deduped_posts", f"SELECT doc_id, id, guid FROM ({_PO}) QUALIFY coalesce(id, guid) IS NULL OR row_number() OVER (PARTITION BY coalesce(id, guid) ORDER BY doc_id) = 1")
def deduped_posts(spark, sf):
    return L.dedupe_posts(_posts(spark, sf), ["doc_id"]).select("doc_id", "id", "guid")


@query("posts_in_range", f"SELECT doc_id FROM ({_PO}) WHERE published_at >= TIMESTAMP '2024-01-02' AND published_at < TIMESTAMP '2024-01-11'")
def posts_in_range(spark, sf):
    return L.date_bounds(_posts(spark, sf), "2024-01-02", "2024-01-10").select("doc_id")


_MON = rf"""q AS (SELECT doc_id, subreddit, id, guid, published_at, {_HAY} AS h FROM ({_PO}) WHERE subreddit IN ('src1', 'src2', 'src3')),
u AS (SELECT * FROM q QUALIFY coalesce(id, guid) IS NULL OR row_number() OVER (PARTITION BY coalesce(id, guid) ORDER BY doc_id) = 1),
mon AS (SELECT * FROM u WHERE published_at >= TIMESTAMP '2024-01-02')"""


@query("feed_monitor", f"WITH {_MON} SELECT doc_id, subreddit, contains(h, 'the and') OR contains(h, 'que') AS signal FROM mon ORDER BY published_at DESC NULLS LAST, doc_id LIMIT 100")
def feed_monitor(spark, sf):
    return L.monitor(_posts(spark, sf), ["the and", "que"], ["doc_id"], subreddits=["src1", "src2", "src3"], start="2024-01-02", limit=100).select("doc_id", "subreddit", "signal")


@query(
    "event_signals",
    f"""WITH {_MON}, t AS (SELECT CASE WHEN contains(h, 'the and') THEN 'the and' END AS a, CASE WHEN contains(h, 'que') THEN 'que' END AS b, subreddit FROM mon)
    SELECT count(*) >= 10 AS detected, count(*) AS post_count, count(DISTINCT subreddit) AS unique_subreddits, list_sort(list_filter([max(a), max(b)], lambda x: x IS NOT NULL)) AS matched_keywords FROM t""",
)
def event_signals(spark, sf):
    return L.event_signal(L.monitor(_posts(spark, sf), ["the and", "que"], ["doc_id"], subreddits=["src1", "src2", "src3"], start="2024-01-02"))


@query(
    "inverted_index",
    rf"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all({TEXT}, '[\p{{L}}\p{{N}}_]+')) AS term FROM documents), l AS (SELECT doc_id, count(*) AS length FROM t GROUP BY 1)
    SELECT term, count(*) AS documents, sum(tf)::BIGINT AS occurrences FROM (SELECT term, doc_id, count(*) AS tf FROM t GROUP BY ALL) GROUP BY term""",
)
def inverted_index(spark, sf):
    return J.inverted_index(table(spark, sf, "documents")).groupBy("term").agg(F.count("*").alias("documents"), F.sum("tf").alias("occurrences"))


@query(
    "bm25_matches",
    rf"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all({TEXT}, '[\p{{L}}\p{{N}}_]+')) AS term FROM documents), n AS (SELECT doc_id, count(*) AS length FROM t GROUP BY 1),
    p AS (SELECT term, doc_id, count(*) AS tf FROM t WHERE term IN ('the', 'and', 'idiot') GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
    s AS (SELECT p.doc_id, count(*) AS c, sum(ln(1.0 + ((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / (SELECT sum(length) / (SELECT count(*) FROM documents) FROM n)))) AS score FROM p JOIN f USING (term) JOIN n USING (doc_id) GROUP BY 1)
    SELECT doc_id, round(score::DOUBLE, 6) AS score FROM s WHERE c = 3""",
)
def bm25_matches(spark, sf):
    return J.bm25(table(spark, sf, "documents"), ["the", "and", "Idiot"]).withColumn("score", F.round("score", 6))


@query("search_page", "SELECT doc_id, source, (SELECT count(*) FROM documents WHERE lang = 'en' AND n_chars >= 500) AS total FROM documents WHERE lang = 'en' AND n_chars >= 500 ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 5")
def search_page(spark, sf):
    d = table(spark, sf, "documents")
    return J.search_documents(d, {"lang": "en"}, F.lit(500), None, "n_chars", [F.col("n_chars").desc(), F.col("doc_id")], 20, 5).select("doc_id", "source", "total")


@query(
    "snippets",
    """WITH p AS (SELECT doc_id, text, coalesce(least(nullif(instr(lower(text), 'idiot'), 0), nullif(instr(lower(text), 'que'), 0)), 1) AS f FROM documents), s AS (SELECT *, greatest(1, f - 80) AS st FROM p)
    SELECT doc_id, CASE WHEN st > 1 THEN '…' ELSE '' END || trim(substring(text, st, 240)) || CASE WHEN length(text) >= st + 240 THEN '…' ELSE '' END AS snippet FROM s""",
)
def snippets(spark, sf):
    return table(spark, sf, "documents").select("doc_id", J.snippet(F.col("text"), "Idiot que").alias("snippet"))


@query("substring_hits", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the and') OR contains(lower(source), 'the and')")
def substring_hits(spark, sf):
    return J.substring_search(table(spark, sf, "documents"), "The AND", ["text", "source"]).select("doc_id")


@query(
    "relevant_results",
    """WITH r AS (SELECT event_id % 40 AS query_id, event_id AS rank, event_type AS title, props AS snippet, 'https://h' || user_id % 60 || '.example.org/' || event_id % 97 AS url FROM events),
    q AS (SELECT query_id, ['view', 'click', 'k', 'error'][query_id % 4 + 1] AS term FROM (SELECT DISTINCT query_id FROM r)),
    j AS (SELECT r.*, row_number() OVER (PARTITION BY query_id ORDER BY rank, url) AS n FROM r JOIN q USING (query_id) WHERE contains(lower(title || ' ' || snippet || ' ' || url), term))
    SELECT query_id, rank, url FROM j WHERE n <= 10 QUALIFY row_number() OVER (PARTITION BY url ORDER BY query_id, rank) = 1""",
)
def relevant_results(spark, sf):
    e = table(spark, sf, "events")
    c = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    r = e.select((F.col("event_id") % 40).alias("query_id"), F.col("event_id").alias("rank"), F.col("event_type").alias("title"), F.col("props").alias("snippet"), c("https://h", F.col("user_id") % 60, ".example.org/", F.col("event_id") % 97).alias("url"))
    q = r.select("query_id").distinct().withColumn("term", F.element_at(F.array(*map(F.lit, ("view", "click", "k", "error"))), (F.col("query_id") % 4 + 1).cast("int")))
    return J.relevant_results(r, q)


@query(
    "engine_summary",
    """SELECT user_id % 30 AS query_id, list_sort(list(DISTINCT event_type) FILTER (value > 100)) AS answered,
    list_sort(list_filter(list(DISTINCT event_type), lambda x: NOT list_contains(coalesce(list(DISTINCT event_type) FILTER (value > 100), []), x))) AS failed FROM events GROUP BY 1""",
)
def engine_summary(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 30).alias("query_id"), F.col("event_type").alias("engine"), (F.col("value") > 100).alias("ok"))
    return J.engine_summary(e, "query_id")


@query("html_texts", r"SELECT page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)\b.*?</(script|style)\s*>', ' ', 'gis'), '<[^>]+>', ' ', 'gs'), '\s+', ' ', 'g'))) > 0 AS has_text FROM pages")
def html_texts(spark, sf):
    return table(spark, sf, "pages").select("page_id", (F.length(X.html_to_text(F.col("html"))) > 0).alias("has_text"))
