"""Queries over the evidence binding of the events: entities, confidence, pivots, views."""

from __future__ import annotations

from pyspark.sql import functions as F

from docwatch.operators import evidence as E
from docwatch.plans.bindings import EVIDENCE, bind, duck
from docwatch.plans.registry import query
from docwatch.session import table

_E = duck(EVIDENCE, "events")
_NV = "lower(trim(value))"
_SITE = r"regexp_replace(regexp_extract(value, '^[a-z]+://([^/?#]*)', 1), '^www\.', '')"
_ENT = f"ent AS (SELECT case_id, entity_type, {_NV} AS normalized_value, min(observed_at) AS first_seen, count(*) AS evidence_count FROM ({_E}) WHERE claim_type <> 'TECHNICAL' GROUP BY ALL)"


def _evidence(spark, sf):
    return bind(spark, sf, EVIDENCE, "events")


def _roots(ev):
    r = ev.select("case_id").distinct()
    return r.select("case_id", F.when(F.col("case_id") % 2 == 0, "PERSON").otherwise("USERNAME").alias("root_type"), F.concat(F.lit("root"), F.col("case_id").cast("string")).alias("root_value"))


_ROOTS = f"roots AS (SELECT DISTINCT case_id, CASE WHEN case_id % 2 = 0 THEN 'PERSON' ELSE 'USERNAME' END AS root_type, 'root' || case_id AS root_value FROM ({_E}))"


@query("evidence_entities", f"WITH {_ENT} SELECT * FROM ent")
def evidence_entities(spark, sf):
    return E.entities(_evidence(spark, sf))


@query("evidence_relationships", f"WITH {_ENT}, {_ROOTS} SELECT case_id, root_type, root_value, entity_type, normalized_value, 'MENTIONED_IN' AS relation FROM ent JOIN roots USING (case_id)")
def evidence_relationships(spark, sf):
    ev = _evidence(spark, sf)
    return E.relationships(E.entities(ev), _roots(ev))


_TRUST = "CASE source_name WHEN 'phonenumbers' THEN 0.99 WHEN 'holehe' THEN 0.80 WHEN 'maigret' THEN 0.65 WHEN 'sherlock' THEN 0.60 ELSE 0.5 END"


@query(
    "evidence_confidence",
    f"""WITH p AS (SELECT case_id, {_NV} AS v, source_name, max(observed_at) AS seen, bool_or(evidence_id % 97 = 0) AS exact, bool_or(evidence_id % 41 = 0) AS agree FROM ({_E}) GROUP BY ALL),
    g AS (SELECT case_id, v, count(*) AS sources, max(seen) AS seen, bool_or(exact) AS exact, bool_or(agree) AS agree, avg({_TRUST}) AS trust FROM p GROUP BY ALL),
    f AS (SELECT *, seen >= TIMESTAMP '2024-04-10' - INTERVAL 90 DAY AS recent FROM g)
    SELECT case_id, v AS normalized_value, sources, round_even(least(1.0, 0.3 + (sources >= 2)::INT * 0.2 + (sources >= 3)::INT * 0.15 + exact::INT * 0.15 + agree::INT * 0.10 + recent::INT * 0.05 + (trust >= 0.7)::INT * 0.05), 4)::DOUBLE AS score,
    list_filter(['direct', CASE WHEN sources >= 2 THEN 'second' END, CASE WHEN sources >= 3 THEN 'third' END, CASE WHEN exact THEN 'exact' END, CASE WHEN agree THEN 'agreement' END, CASE WHEN recent THEN 'recent' END, CASE WHEN trust >= 0.7 THEN 'reliable' END], lambda x: x IS NOT NULL) AS factors FROM f""",
)
def evidence_confidence(spark, sf):
    ev = _evidence(spark, sf).withColumn("normalized_value", E.entity_value(F.col("value")))
    return E.confidence(ev, ["case_id", "normalized_value"], F.lit("2024-04-10").cast("timestamp_ntz"), F.col("evidence_id") % 97 == 0, F.col("evidence_id") % 41 == 0)


@query("evidence_by_site", f"SELECT case_id, {_SITE} AS site, min(evidence_id) AS first_evidence, array_to_string(list_sort(list(DISTINCT source_name)), '+') AS source_name, count(*) AS n FROM ({_E}) GROUP BY ALL")
def evidence_by_site(spark, sf):
    return E.merge_by_site(_evidence(spark, sf))


_CAND = f"cand AS (SELECT case_id, {_SITE} AS domain, count(*) AS mentions FROM ({_E}) WHERE {_SITE} NOT IN ('h1.example.org', 'h2.example.org') GROUP BY ALL)"


@query("pivot_candidates", f"WITH {_CAND} SELECT *, CASE WHEN mentions >= 2 THEN 0.6 ELSE 0.35 END::DOUBLE AS confidence FROM cand")
def pivot_candidates(spark, sf):
    return E.pivot_candidates(_evidence(spark, sf), ["h1.example.org", "h2.example.org"])


_SEQ = f"""c AS (SELECT case_id, source_name AS parent, evidence_id AS seq, 'v' || evidence_id % 60 AS value, CASE WHEN evidence_id % 7 = 0 THEN 0.35 ELSE 0.6 END AS confidence FROM ({_E})),
k AS (SELECT DISTINCT case_id, 'v' || case_id AS value FROM c), r AS (SELECT DISTINCT case_id, 'v' || (case_id + 10) AS root_value FROM c),
s AS (SELECT c.*, root_value, k.value IS NOT NULL AS known, confidence >= 0.5 AS ok FROM c LEFT JOIN k ON c.case_id = k.case_id AND c.value = k.value LEFT JOIN r ON c.case_id = r.case_id),
d AS (SELECT *, ok AND row_number() OVER (PARTITION BY case_id, value, ok ORDER BY seq, value) > 1 AS again FROM s),
a AS (SELECT *, CASE WHEN value = root_value THEN 'SKIPPED_SELF_REFERENCE' WHEN known OR again THEN 'SKIPPED_DUPLICATE' WHEN NOT ok THEN 'SKIPPED_LOW_CONFIDENCE' END AS st FROM d),
b AS (SELECT *, st IS NULL AND row_number() OVER (PARTITION BY case_id, parent, st IS NULL ORDER BY seq, value) <= 5 AS fits FROM a),
z AS (SELECT *, row_number() OVER (PARTITION BY case_id, fits ORDER BY seq, value) AS cr FROM b)"""


@query("pivot_decisions", f"WITH {_SEQ} SELECT case_id, parent, seq, value, confidence::DOUBLE AS confidence, coalesce(st, CASE WHEN fits AND cr <= 15 THEN 'PENDING' ELSE 'SKIPPED_LIMIT_REACHED' END) AS status FROM z")
def pivot_decisions(spark, sf):
    ev = _evidence(spark, sf)
    v = lambda n: F.concat(F.lit("v"), n.cast("string"))
    c = ev.select("case_id", F.col("source_name").alias("parent"), F.col("evidence_id").alias("seq"), v(F.col("evidence_id") % 60).alias("value"), F.when(F.col("evidence_id") % 7 == 0, 0.35).otherwise(0.6).alias("confidence"))
    cases = ev.select("case_id").distinct()
    known = cases.select("case_id", v(F.col("case_id")).alias("normalized_value"))
    return E.decide_pivots(c, known, cases.select("case_id", v(F.col("case_id") + 10).alias("root_value")))


@query("graph_nodes", f"WITH {_ENT}, {_ROOTS} SELECT case_id, entity_type, normalized_value, false AS is_root FROM ent UNION ALL SELECT case_id, root_type, root_value, true FROM roots")
def graph_nodes(spark, sf):
    ev = _evidence(spark, sf)
    return E.graph_nodes(E.entities(ev), _roots(ev))


@query("evidence_timeline", f"WITH {_ENT} SELECT case_id, 'entity' AS event, first_seen AS at, normalized_value AS label FROM ent UNION ALL SELECT case_id, 'evidence', observed_at, source_name FROM ({_E})")
def evidence_timeline(spark, sf):
    ev = _evidence(spark, sf)
    found = E.entities(ev).select("case_id", F.col("first_seen").alias("at"), F.col("normalized_value").alias("label"))
    return E.timeline(entity=found, evidence=ev.select("case_id", F.col("observed_at").alias("at"), F.col("source_name").alias("label")))


@query("evidence_report", f"SELECT case_id, count(*) FILTER (source_name = 'maigret') AS maigret, count(*) FILTER (source_name = 'sherlock') AS sherlock, count(*) FILTER (source_name = 'public_web') AS public_web FROM ({_E}) GROUP BY 1")
def evidence_report(spark, sf):
    p = _evidence(spark, sf).groupBy("case_id").pivot("source_name", ["maigret", "sherlock", "public_web"]).agg(F.count(F.lit(1)))
    return p.na.fill(0)


_JOBS = "SELECT user_id AS case_id, CASE WHEN user_id % 4 = 0 THEN 'COMPLETED' WHEN user_id % 7 = 3 THEN 'UNAVAILABLE' WHEN user_id % 7 = 5 AND event_type = 'error' THEN 'UNAVAILABLE' WHEN user_id % 7 = 5 THEN 'FAILED' WHEN event_type IN ('view', 'click') THEN 'COMPLETED' ELSE 'FAILED' END AS status FROM events"


@query(
    "final_status",
    f"""WITH j AS ({_JOBS}), g AS (SELECT case_id, bool_and(status = 'COMPLETED') AS a, bool_or(status = 'COMPLETED') AS s, bool_and(status = 'UNAVAILABLE') AS n FROM j GROUP BY 1)
    SELECT c.case_id, CASE WHEN c.case_id % 13 = 0 THEN 'CANCELLED' WHEN a IS NULL OR a THEN 'COMPLETED' WHEN s THEN 'PARTIAL' WHEN n THEN 'UNAVAILABLE' ELSE 'FAILED' END AS status FROM (SELECT DISTINCT user_id AS case_id FROM events UNION SELECT DISTINCT user_id + 100000 FROM events) c LEFT JOIN g USING (case_id)""",
)
def final_status(spark, sf):
    e = table(spark, sf, "events")
    u = F.col("user_id")
    error = F.col("event_type") == "error"
    st = F.when(u % 4 == 0, "COMPLETED").when((u % 7 == 3) | (u % 7 == 5) & error, "UNAVAILABLE").when((u % 7 == 5) | ~F.col("event_type").isin("view", "click"), "FAILED").otherwise("COMPLETED")
    jobs = e.select(u.alias("case_id"), st.alias("status"))
    cases = e.select(u.alias("case_id")).union(e.select(u + 100_000)).distinct().withColumn("cancelled", F.col("case_id") % 13 == 0)
    return E.final_status(jobs, cases)


@query(
    "source_health",
    """WITH r AS (SELECT user_id % 25 AS source_name, event_type <> 'error' AND user_id % 25 NOT IN (3) AND (user_id % 25 <> 4 OR event_id % 5 = 0) AS ok, value AS seconds, value > 450 AS timed_out, ts FROM events),
    g AS (SELECT source_name, count(*) AS runs, round(avg(ok::INT), 6) AS success_rate, round(avg(seconds), 6) AS mean_seconds, count(*) FILTER (timed_out) AS timeouts, max(ts) FILTER (ok) AS last_success, max(ts) FILTER (NOT ok) AS last_failure FROM r GROUP BY 1)
    SELECT *, CASE WHEN success_rate = 0 THEN 'unavailable' WHEN success_rate < 0.5 THEN 'degraded' ELSE 'working' END AS status FROM g""",
)
def source_health(spark, sf):
    e = table(spark, sf, "events")
    s = F.col("user_id") % 25
    ok = (F.col("event_type") != "error") & (s != 3) & ((s != 4) | (F.col("event_id") % 5 == 0))
    h = E.source_health(e.select(s.alias("source_name"), ok.alias("ok"), F.col("value").alias("seconds"), (F.col("value") > 450).alias("timed_out"), F.col("ts").alias("at")))
    return h.withColumns({"success_rate": F.round("success_rate", 6), "mean_seconds": F.round("mean_seconds", 6)})


@query(
    "selected_urls",
    f"""WITH e AS ({_E}), u AS (SELECT DISTINCT case_id, value FROM e WHERE evidence_id % 11 = 0), f AS (SELECT case_id, value, min(evidence_id) AS evidence_id FROM e GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY evidence_id) AS n FROM f WHERE (case_id, value) NOT IN (SELECT (case_id, value) FROM u)), s AS (SELECT case_id, count(*) AS spent FROM u GROUP BY 1)
    SELECT case_id, evidence_id, value FROM n LEFT JOIN s USING (case_id) WHERE n <= 100 - coalesce(spent, 0)""",
)
def selected_urls(spark, sf):
    ev = _evidence(spark, sf)
    return E.select_urls(ev, ev.where("evidence_id % 11 = 0").select("case_id", "value"), 100)


@query("purged_cases", f"WITH e AS ({_E}), p AS (SELECT case_id, min(observed_at) AS t, max(observed_at) AS created_at FROM e GROUP BY 1), g AS (SELECT case_id FROM p WHERE case_id < 3) SELECT case_id, count(*) AS evidence FROM e WHERE case_id NOT IN (SELECT case_id FROM g) GROUP BY 1")
def purged_cases(spark, sf):
    ev = _evidence(spark, sf)
    day = F.when(F.col("case_id") < 3, "2023-01-01").otherwise("2024-01-01").cast("timestamp")
    parents = ev.select("case_id").distinct().withColumn("created_at", day)
    kept = E.purge_expired(parents, [ev], F.lit("2023-06-01").cast("timestamp"))
    return kept[1].groupBy("case_id").agg(F.count("*").alias("evidence"))


@query(
    "expanded_graph",
    f"""WITH RECURSIVE e AS ({_E}), l AS (SELECT DISTINCT case_id, 'n' || evidence_id % 37 AS src, 'n' || (evidence_id * 3 + 1) % 37 AS dst FROM e),
    w AS (SELECT DISTINCT case_id, 'n' || case_id AS value, 0 AS depth FROM e UNION SELECT w.case_id, l.dst, depth + 1 FROM w JOIN l ON l.case_id = w.case_id AND l.src = w.value WHERE depth < 2)
    SELECT case_id, value, min(depth) AS depth FROM w GROUP BY ALL""",
)
def expanded_graph(spark, sf):
    ev = _evidence(spark, sf)
    n = lambda x: F.concat(F.lit("n"), x.cast("string"))
    i = F.col("evidence_id")
    links = ev.select("case_id", n(i % 37).alias("src"), n((i * 3 + 1) % 37).alias("dst")).distinct()
    roots = ev.select("case_id").distinct().withColumn("root_value", n(F.col("case_id")))
    return E.expand_graph(roots, links, 2)
