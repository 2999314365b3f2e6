"""Queries over fetch outcomes: source and domain state, profiles, routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from docwatch.operators import monitor as M
from docwatch.plans.bindings import FETCH_OUTCOMES, bind, duck
from docwatch.plans.registry import query

_O = duck(FETCH_OUTCOMES, "events")
_CAT = """CASE WHEN status_code IN (403, 404, 410, 429) THEN 'http_' || status_code WHEN status_code BETWEEN 500 AND 599 THEN 'http_5xx' WHEN status_code >= 400 THEN 'other_http_error'
  WHEN status_code IS NOT NULL THEN 'none' WHEN error IS NULL THEN 'none' WHEN contains(lower(error), 'timeout') THEN 'timeout' ELSE 'connection_failure' END"""
_OC = f"o AS (SELECT *, {_CAT} AS category FROM ({_O}))"
#: Two of three fetches fail besides, so that long rows of failures occur.
_HARD = f"o AS (SELECT *, {_CAT} AS category FROM (SELECT * REPLACE (success AND outcome_id % 3 = 0 AS success, CASE WHEN outcome_id % 3 > 0 THEN 503 ELSE status_code END AS status_code) FROM ({_O})))"
_BLOCKED = "('http_403', 'http_429', 'robots_blocked', 'soft_blocked')"


def _outcomes(spark, sf):
    return bind(spark, sf, FETCH_OUTCOMES, "events")


def _hard_outcomes(spark, sf):
    fails = F.col("outcome_id") % 3 > 0
    return _outcomes(spark, sf).withColumns({"success": F.col("success") & ~fails, "status_code": F.when(fails, 503).otherwise(F.col("status_code"))})


@query("failure_categories", f"WITH {_OC} SELECT domain, category, count(*) AS n FROM o WHERE category <> 'none' GROUP BY ALL")
def failure_categories(spark, sf):
    return M.failure_counts(_outcomes(spark, sf))


@query(
    "removed_restored",
    f"""WITH {_HARD}, i AS (SELECT *, sum(success::INT) OVER w AS island, (category NOT IN {_BLOCKED} AND category <> 'none')::INT AS counts FROM o WINDOW w AS (PARTITION BY domain ORDER BY ts, outcome_id)),
    f AS (SELECT *, sum(counts) OVER (PARTITION BY domain, island ORDER BY ts, outcome_id) AS failures FROM i),
    g AS (SELECT *, lag(failures) OVER (PARTITION BY domain ORDER BY ts, outcome_id) AS prev FROM f)
    SELECT domain, ts, outcome_id, CASE WHEN counts = 1 AND failures = 3 THEN 'REMOVED' ELSE 'RESTORED' END AS event FROM g WHERE (counts = 1 AND failures = 3) OR (success AND prev >= 3)""",
)
def removed_restored(spark, sf):
    return M.removed_restored(_hard_outcomes(spark, sf))


@query(
    "next_intervals",
    f"""WITH {_OC}, c AS (SELECT outcome_id, domain, ts, category <> 'none' AS changed FROM o), i AS (SELECT *, sum(changed::INT) OVER (PARTITION BY domain ORDER BY ts, outcome_id) AS island FROM c),
    r AS (SELECT *, row_number() OVER (PARTITION BY domain, island ORDER BY ts, outcome_id) - (island > 0)::INT AS k FROM i)
    SELECT outcome_id, domain, least(86400, 600 * pow(2.0, least(k, 60)))::BIGINT AS interval_seconds FROM r""",
)
def next_intervals(spark, sf):
    c = M.with_category(_outcomes(spark, sf)).withColumn("changed", F.col("category") != "none")
    return M.next_interval(c, "domain", "changed", 600, 86400, ["ts", "outcome_id"]).select("outcome_id", "domain", "interval_seconds")


_STATES = f"""{_OC}, i AS (SELECT *, sum((category = 'none')::INT) OVER (PARTITION BY domain ORDER BY ts, outcome_id) AS island FROM o),
n AS (SELECT *, (sum((category <> 'none')::INT) OVER (PARTITION BY domain, island ORDER BY ts, outcome_id))::BIGINT AS consecutive_failures FROM i),
st AS (SELECT domain, ts, outcome_id, category, consecutive_failures, CASE WHEN consecutive_failures >= 6 THEN 'open' WHEN consecutive_failures >= 3 THEN 'degraded' ELSE 'healthy' END AS circuit_state,
  CASE WHEN consecutive_failures >= 6 THEN max(CASE WHEN consecutive_failures = 6 THEN ts END) OVER (PARTITION BY domain, island ORDER BY ts, outcome_id) END AS opened_at FROM n)"""


_RETRY = "CASE WHEN o.status_code = 429 THEN o.outcome_id % 9 END"


@query(
    "circuit_states",
    f"""WITH RECURSIVE {_STATES}, q AS (SELECT st.*, row_number() OVER (PARTITION BY st.domain ORDER BY st.ts, st.outcome_id) AS k, greatest(CASE WHEN st.category IN {_BLOCKED} THEN 500.0 ELSE 200.0 END::DOUBLE, coalesce(({_RETRY}) * 1000.0, 0)::DOUBLE) AS floor
      FROM st JOIN o ON o.outcome_id = st.outcome_id),
    f AS (SELECT domain, 0::BIGINT AS k, 0::DOUBLE AS delay FROM q WHERE k = 1
      UNION ALL SELECT q.domain, q.k, CASE WHEN q.category = 'none' THEN CASE WHEN delay * 0.9::DOUBLE < 50 THEN 0 ELSE delay * 0.9::DOUBLE END ELSE least(30000, greatest(q.floor, delay * CASE WHEN q.category IN {_BLOCKED} THEN 2.0 ELSE 1.5 END::DOUBLE)) END
      FROM f JOIN q ON q.domain = f.domain AND q.k = f.k + 1)
    SELECT q.* EXCLUDE (k, floor), round(f.delay + 0.0000001::DOUBLE, 3) AS delay_ms, CASE WHEN consecutive_failures >= 3 THEN 1 ELSE 5 END AS concurrency FROM q JOIN f USING (domain, k)""",
)
def circuit_states(spark, sf):
    o = _outcomes(spark, sf).withColumn("retry", F.expr(_RETRY.replace("o.", "")))
    return M.circuit_state(o, retry_after="retry").withColumn("delay_ms", F.round(F.col("delay_ms") + 1e-7, 3))


@query(
    "circuit_open_edges",
    f"""WITH {_STATES.replace(_OC, _HARD)}, e AS (SELECT *, lag(circuit_state) OVER (PARTITION BY domain ORDER BY ts, outcome_id) AS prev FROM st)
    SELECT domain, ts, outcome_id, consecutive_failures FROM e WHERE circuit_state = 'open' AND prev IS DISTINCT FROM 'open'""",
)
def circuit_open_edges(spark, sf):
    return M.circuit_open_edges(M.circuit_state(_hard_outcomes(spark, sf))).select("domain", "ts", "outcome_id", "consecutive_failures")


@query(
    "metrics_rollup",
    f"""WITH {_OC} SELECT strategy, category, CASE WHEN latency_ms <= 500 THEN '500' WHEN latency_ms <= 2000 THEN '2000' WHEN latency_ms <= 10000 THEN '10000' ELSE '+Inf' END AS bucket,
    count(*) AS n, round(sum(latency_ms), 4) AS total FROM o GROUP BY ALL""",
)
def metrics_rollup(spark, sf):
    r = M.metrics_rollup(M.with_category(_outcomes(spark, sf)), ["strategy", "category"], "latency_ms", [500, 2000, 10000])
    return r.withColumn("total", F.round("total", 4))


def _profile_sql(keys: str) -> str:
    return f"""SELECT {keys}, count(*) FILTER (strategy = 'http') AS http_attempts, count(*) FILTER (strategy = 'http' AND success) AS http_successes, avg(latency_ms) FILTER (strategy = 'http') AS avg_http_latency_ms,
    count(*) FILTER (strategy = 'browser') AS browser_attempts, count(*) FILTER (strategy = 'browser' AND success) AS browser_successes, avg(latency_ms) FILTER (strategy = 'browser') AS avg_browser_latency_ms,
    count(*) FILTER (strategy = 'http' AND success AND NOT extraction_ok) AS http_extraction_failures, avg(content_bytes) AS avg_content_bytes, avg(quality) AS avg_extraction_quality,
    count(quality) AS quality_observations, count(*) FILTER (category IN {_BLOCKED}) AS blocked, count(*) FILTER (category = 'soft_blocked') AS soft_blocked, max(ts) AS last_observed_at FROM o GROUP BY {keys}"""


_ROUND = ("avg_http_latency_ms", "avg_browser_latency_ms", "avg_content_bytes", "avg_extraction_quality")
_REPLACE = ", ".join(f"round({c}, 6) AS {c}" for c in _ROUND)


@query("domain_profiles", f"WITH {_OC}, p AS ({_profile_sql('domain')}) SELECT * REPLACE ({_REPLACE}) FROM p")
def domain_profiles(spark, sf):
    p = M.domain_profile(_outcomes(spark, sf))
    return p.withColumns({c: F.round(c, 6) for c in _ROUND})


@query(
    "domain_profiles_status",
    f"WITH {_OC} SELECT domain, (status_code // 100)::BIGINT || 'xx' AS status_class, count(*) AS n FROM o WHERE status_code IS NOT NULL GROUP BY ALL",
)
def domain_profiles_status(spark, sf):
    return M.status_classes(_outcomes(spark, sf))


_PATTERN = "'/' || split_part(path, '/', 2) || '/{id}'"


def _with_pattern(o):
    return o.withColumn("pattern", F.concat(F.lit("/"), F.split_part("path", F.lit("/"), F.lit(2)), F.lit("/{id}")))


@query(
    "pattern_profiles",
    f"""WITH {_OC}, q AS (SELECT * REPLACE (coalesce(page_type, 'UNKNOWN') AS page_type), {_PATTERN} AS pattern FROM o)
    SELECT domain, pattern, page_type, (grouping(page_type) = 1) AS rolled_up, count(*) AS attempts, count(*) FILTER (success) AS successes, round(avg(latency_ms), 6) AS avg_latency_ms, round(avg(quality), 6) AS avg_quality
    FROM q GROUP BY GROUPING SETS ((domain, pattern, page_type), (domain, pattern))""",
)
def pattern_profiles(spark, sf):
    p = M.pattern_profile(_with_pattern(_outcomes(spark, sf)))
    return p.withColumns({"avg_latency_ms": F.round("avg_latency_ms", 6), "avg_quality": F.round("avg_quality", 6)})


@query(
    "health_scores",
    f"""WITH {_OC}, p AS ({_profile_sql('domain')}), s AS (SELECT domain, http_attempts + browser_attempts AS n, (http_successes + browser_successes) / (http_attempts + browser_attempts) AS a,
    CASE WHEN http_successes > 0 THEN (http_successes - http_extraction_failures) / http_successes ELSE 1.0 END AS e, blocked, coalesce(nullif(avg_http_latency_ms, 0), nullif(avg_browser_latency_ms, 0), 0) AS ms FROM p)
    SELECT domain, n < 5 AS insufficient_data, CASE WHEN n < 5 THEN 50.0::DOUBLE ELSE round_even(a * 40 + e * 30 + (1 - blocked / n) * 15 + (CASE WHEN ms <= 1000 THEN 1.0 WHEN ms >= 10000 THEN 0.0 ELSE 1 - (ms - 1000) / 9000 END) * 15, 1)::DOUBLE END AS health FROM s""",
)
def health_scores(spark, sf):
    return M.health_score(M.domain_profile(_outcomes(spark, sf))).select("domain", "insufficient_data", "health")


#: How complete a capture was, and which strategy's capture of a page was better, for some domains.
_SEEN = """CASE WHEN domain IN ('d7.example.org', 'd8.example.org') AND success THEN (outcome_id % 5) / 8.0 WHEN domain = 'd2.example.org' THEN 0.9 END AS completeness,
    CASE WHEN domain = 'd1.example.org' THEN CASE WHEN outcome_id % 3 > 0 THEN 'browser_superior' ELSE 'http_superior' END WHEN domain = 'd2.example.org' THEN CASE WHEN outcome_id % 2 > 0 THEN 'browser_superior' ELSE 'browser_equivalent' END END AS comparison"""
_MORE = ", avg(completeness) AS avg_completeness, count(completeness) AS completeness_observations, count(*) FILTER (comparison = 'browser_superior') AS browser_superior, count(*) FILTER (comparison = 'http_superior') AS http_superior, count(*) FILTER (comparison = 'browser_equivalent') AS browser_equivalent FROM"


@query(
    "routing_decisions",
    f"""WITH {_OC}, q AS (SELECT *, {_SEEN}, {_PATTERN} AS pattern FROM o), d AS ({_profile_sql('domain').replace(' FROM o', _MORE + ' q')}), p AS ({_profile_sql('domain, pattern').replace(' FROM o', _MORE + ' q')}),
    h AS (SELECT 'd' AS lvl, domain, NULL AS pattern, * EXCLUDE (domain) FROM d UNION ALL SELECT 'p', domain, pattern, * EXCLUDE (domain, pattern) FROM p),
    x AS (SELECT *, browser_superior + http_superior + browser_equivalent AS cmp, browser_attempts = 0 OR browser_successes / browser_attempts > 0.5 AS viable, CASE WHEN http_attempts > 0 THEN 1 - http_successes / http_attempts ELSE 0 END > 0.6 AS failing,
      CASE WHEN http_successes > 0 THEN http_extraction_failures / http_successes ELSE 0 END > 0.6 AS unread FROM h),
    y AS (SELECT *, CASE WHEN NOT viable THEN []::VARCHAR[] WHEN cmp >= 5 AND browser_superior / cmp >= 0.6 THEN ['browser_superior'] WHEN http_attempts >= 5 AND quality_observations >= 5 AND avg_extraction_quality < 0.4 THEN ['low_quality']
      WHEN http_attempts >= 5 AND completeness_observations >= 5 AND avg_completeness < 0.4 THEN ['low_completeness'] WHEN http_attempts >= 5 AND soft_blocked / http_attempts > 0.3 THEN ['soft_blocks']
      ELSE list_filter([CASE WHEN unread THEN 'extraction_failures' END, CASE WHEN failing THEN 'http_failures' END], lambda v: v IS NOT NULL) END AS w FROM x),
    v AS (SELECT lvl, domain, pattern, CASE WHEN http_attempts + browser_attempts < 5 THEN NULL WHEN len(w) > 0 THEN 'browser' ELSE 'http' END AS s, CASE WHEN len(w) > 0 THEN w ELSE ['http_suffices'] END AS w FROM y),
    r AS (SELECT DISTINCT domain, pattern, CASE WHEN domain = 'd3.example.org' THEN 'browser' ELSE 'auto' END AS requested, domain = 'd9.example.org' AS js_required FROM q
          UNION ALL SELECT 'new' || (user_id % 3) || '.example.org', '/x', 'auto', user_id % 3 = 0 FROM (SELECT DISTINCT user_id % 3 AS user_id FROM events))
    SELECT r.domain, r.pattern, r.requested, r.js_required, coalesce(CASE WHEN requested <> 'auto' THEN requested END, vp.s, vd.s, CASE WHEN js_required THEN 'browser' END, 'http') AS strategy,
    CASE WHEN requested <> 'auto' THEN 'explicit' WHEN vp.s IS NOT NULL THEN 'url_pattern' WHEN vd.s IS NOT NULL THEN 'domain' WHEN js_required THEN 'js_heuristic' ELSE 'default' END AS basis,
    CASE WHEN requested <> 'auto' THEN ['asked_for'] WHEN vp.s IS NOT NULL THEN vp.w WHEN vd.s IS NOT NULL THEN vd.w WHEN js_required THEN ['js_required'] ELSE ['no_history'] END AS reasons
    FROM r LEFT JOIN v vp ON vp.lvl = 'p' AND vp.domain = r.domain AND vp.pattern = r.pattern LEFT JOIN v vd ON vd.lvl = 'd' AND vd.domain = r.domain""",
)
def routing_decisions(spark, sf):
    o = spark.sql(f"SELECT *, {_SEEN} FROM {{o}}", o=_with_pattern(_outcomes(spark, sf)))
    known = o.select("domain", "pattern").distinct()
    known = known.select("domain", "pattern", F.when(F.col("domain") == "d3.example.org", "browser").otherwise("auto").alias("requested"), (F.col("domain") == "d9.example.org").alias("js_required"))
    k = (F.split_part(F.split_part("domain", F.lit("."), F.lit(1)), F.lit("d"), F.lit(2)).cast("int") % 3).alias("k")
    new = o.select(k).distinct()
    new = new.select(F.concat(F.lit("new"), "k", F.lit(".example.org")).alias("domain"), F.lit("/x").alias("pattern"), F.lit("auto").alias("requested"), (F.col("k") == 0).alias("js_required"))
    return M.routing_decision(known.unionByName(new), M.domain_profile(o), M.domain_profile(o, ["domain", "pattern"]))


@query(
    "capabilities",
    f"""WITH {_OC}, q AS (SELECT coalesce(page_type, 'UNKNOWN') AS page_type, domain, {_PATTERN} AS pattern, success, quality FROM o),
    p AS (SELECT domain, pattern, page_type, count(*) AS attempts, count(*) FILTER (success) AS successes, avg(quality) AS q FROM q GROUP BY ALL),
    c AS (SELECT domain, page_type, sum(attempts)::BIGINT AS attempts, round(sum(successes) / sum(attempts), 6) AS success_rate, round(sum(q * attempts) / sum(attempts) FILTER (q IS NOT NULL), 6) AS quality FROM p GROUP BY ALL)
    SELECT *, CASE WHEN attempts >= 50 THEN 'high' WHEN attempts >= 10 THEN 'medium' ELSE 'low' END AS confidence FROM c""",
)
def capabilities(spark, sf):
    c = M.capabilities(M.pattern_profile(_with_pattern(_outcomes(spark, sf))))
    return c.withColumns({"success_rate": F.round("success_rate", 6), "quality": F.round("quality", 6)})


@query(
    "due_sources",
    f"""WITH {_OC}, s AS (SELECT domain AS source_id, domain <> 'd4.example.org' AS active, CASE WHEN domain = 'd5.example.org' THEN NULL ELSE max(ts) END AS next_crawl_at FROM o GROUP BY domain)
    SELECT source_id, next_crawl_at FROM s WHERE active AND (next_crawl_at IS NULL OR next_crawl_at <= TIMESTAMP '2024-01-30 23:55:00') AND source_id <> 'd6.example.org' ORDER BY next_crawl_at NULLS FIRST, source_id LIMIT 8""",
)
def due_sources(spark, sf):
    o = _outcomes(spark, sf)
    s = o.groupBy(F.col("domain").alias("source_id")).agg(F.max("ts").alias("m"))
    s = s.select("source_id", (F.col("source_id") != "d4.example.org").alias("active"), F.when(F.col("source_id") != "d5.example.org", F.col("m")).alias("next_crawl_at"))
    jobs = s.where("source_id = 'd6.example.org'").select("source_id")
    return M.due_sources(s, jobs, F.lit("2024-01-30 23:55:00").cast("timestamp_ntz"), 8).select("source_id", "next_crawl_at")
