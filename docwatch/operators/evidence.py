"""Evidence graphs: entities, their confidence, pivots and views. Evidence: evidence_id, case_id, source_name, entity_type, value, observed_at, claim_type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docwatch.functions import urls as U

#: Trust in each source, 0.5 for others.
RELIABILITY = {"phonenumbers": 0.99, "hibp_pwned_passwords": 0.95, "holehe": 0.80, "maigret": 0.65, "sherlock": 0.60, "public_web": 0.50}
#: Relation of a root entity to what is found, by their types.
RELATIONS = {
    **{(a, "SOCIAL_PROFILE"): "HAS_PROFILE" for a in ("USERNAME", "EMAIL", "PERSON")},
    **{(a, b): "MENTIONED_IN" for a in ("PHONE", "EMAIL", "USERNAME", "PERSON", "DOMAIN") for b in ("URL", "DOCUMENT")},
    **{("PERSON", b): "ASSOCIATED_WITH" for b in ("COMPANY", "PERSON")},
}


def entity_value(value: Column) -> Column:
    return F.lower(F.trim(value))


def entities(evidence: DataFrame) -> DataFrame:
    """One row for each (case, type, normalized value) of the evidence that isn't merely technical: first seen, evidence count."""
    e = evidence.where("claim_type <> 'TECHNICAL'").withColumn("normalized_value", entity_value(F.col("value")))
    return e.groupBy("case_id", "entity_type", "normalized_value").agg(F.min("observed_at").alias("first_seen"), F.count("*").alias("evidence_count"))


def relationships(found: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges (case_id, root_type, root_value, entity_type, normalized_value, relation) from each case's root to its entities, by the rule table."""
    rules = found.sparkSession.createDataFrame([(a, b, r) for (a, b), r in RELATIONS.items()], "root_type string, entity_type string, relation string")
    return found.join(roots, "case_id").join(F.broadcast(rules), ["root_type", "entity_type"]).select("case_id", "root_type", "root_value", "entity_type", "normalized_value", "relation")


def confidence(evidence: DataFrame, keys: list[str], as_of: Column, exact_match: Column | None = None, agreement: Column | None = None) -> DataFrame:
    """Per keys: score and factors. One, two, three sources .30 .20 .15; exact match .15; name and company agree in a source .10; seen in the last 90 days .05; mean trust of the sources at least .70 .05."""
    spark = evidence.sparkSession
    trust = spark.createDataFrame(list(RELIABILITY.items()), "source_name string, trust double")
    per = evidence.groupBy(*keys, "source_name").agg(F.max("observed_at").alias("seen"), *[F.max(c).alias(n) for c, n in ((exact_match, "exact"), (agreement, "agree")) if c is not None])
    per = per.join(F.broadcast(trust), "source_name", "left").withColumn("trust", F.coalesce("trust", F.lit(0.5)))
    g = per.groupBy(*keys).agg(F.count("*").alias("sources"), F.max("seen").alias("seen"), F.avg("trust").alias("trust"), *[(F.lit(False) if c is None else F.coalesce(F.max(n), F.lit(False))).alias(n) for c, n in ((exact_match, "exact"), (agreement, "agree"))])
    recent = F.col("seen") >= as_of - F.expr("INTERVAL 90 DAY")
    parts = [(F.col("sources") >= 1, 0.30, "direct"), (F.col("sources") >= 2, 0.20, "second"), (F.col("sources") >= 3, 0.15, "third"), (F.col("exact"), 0.15, "exact"), (F.col("agree"), 0.10, "agreement"), (recent, 0.05, "recent"), (F.col("trust") >= 0.70, 0.05, "reliable")]
    score = F.bround(F.least(F.lit(1.0), sum((F.when(c, F.lit(w)).otherwise(0.0) for c, w, _ in parts), F.lit(0.0))), 4)
    return g.select(*keys, "sources", score.alias("score"), F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, _, n in parts])).alias("factors"))


def merge_by_site(evidence: DataFrame) -> DataFrame:
    """Per (case, site): the first evidence, all sources joined by +, and the number of rows."""
    site = F.coalesce(U.host_key(F.col("value")), F.col("value"))
    return evidence.groupBy("case_id", site.alias("site")).agg(
        F.min("evidence_id").alias("first_evidence"), F.array_join(F.array_sort(F.collect_set("source_name")), "+").alias("source_name"), F.count("*").alias("n")
    )


def pivot_candidates(evidence: DataFrame, blocklist: list[str]) -> DataFrame:
    """(case_id, domain, mentions, confidence): domains of URL evidence that aren't blocked; .60 from two mentions on, else .35."""
    d = evidence.where("entity_type = 'URL'").select("case_id", U.host_key(F.col("value")).alias("domain")).where(F.col("domain").isNotNull() & ~F.col("domain").isin(blocklist))
    return d.groupBy("case_id", "domain").agg(F.count("*").alias("mentions")).withColumn("confidence", F.when(F.col("mentions") >= 2, 0.60).otherwise(0.35))


def decide_pivots(candidates: DataFrame, known: DataFrame, roots: DataFrame, least: float = 0.5, per_case: int = 15, per_parent: int = 5) -> DataFrame:
    """`candidates` (case_id, parent, seq, value, confidence) with status: the case's own value, known or seen before, low confidence, over a limit, or PENDING.

    A rejection by a parent's limit uses nothing of the case's: ranks by parent come first, then ranks by case of those that are left.
    """
    order = ["seq", "value"]
    c = candidates.join(roots.select("case_id", "root_value"), "case_id", "left")
    c = c.join(known.select("case_id", F.col("normalized_value").alias("value"), F.lit(True).alias("known")), ["case_id", "value"], "left")
    again = F.row_number().over(Window.partitionBy("case_id", "value", "confidence_ok").orderBy(*order)) > 1
    c = c.withColumn("confidence_ok", F.col("confidence") >= least).withColumn("again", again & F.col("confidence_ok"))
    c = c.withColumn("status", F.when(F.col("value") == F.col("root_value"), "SKIPPED_SELF_REFERENCE").when(F.coalesce("known", F.lit(False)) | F.col("again"), "SKIPPED_DUPLICATE").when(~F.col("confidence_ok"), "SKIPPED_LOW_CONFIDENCE"))
    free = F.col("status").isNull()
    c = c.withColumn("p_rank", F.when(free, F.row_number().over(Window.partitionBy("case_id", "parent", free).orderBy(*order))))
    c = c.withColumn("fits", free & (F.col("p_rank") <= per_parent))
    c = c.withColumn("c_rank", F.when(F.col("fits"), F.row_number().over(Window.partitionBy("case_id", "fits").orderBy(*order))))
    status = F.coalesce("status", F.when(F.col("fits") & (F.col("c_rank") <= per_case), "PENDING").otherwise("SKIPPED_LIMIT_REACHED"))
    return c.withColumn("status", status).select(*candidates.columns, "status")


def graph_nodes(found: DataFrame, roots: DataFrame) -> DataFrame:
    r = roots.select("case_id", F.col("root_type").alias("entity_type"), F.col("root_value").alias("normalized_value"), F.lit(True).alias("is_root"))
    rest = found.select("case_id", "entity_type", "normalized_value", F.lit(False).alias("is_root"))
    return r.unionByName(rest.join(r.drop("is_root"), ["case_id", "entity_type", "normalized_value"], "left_anti"))


def timeline(**events: DataFrame) -> DataFrame:
    """Typed events (case_id, at, label) of several tables as one."""
    out = None
    for kind, df in events.items():
        part = df.select("case_id", F.lit(kind).alias("event"), "at", "label")
        out = part if out is None else out.unionByName(part)
    return out


def final_status(jobs: DataFrame, cases: DataFrame) -> DataFrame:
    """Status of each case by its jobs: all completed, some, all unavailable, else failed; cancelled wins; without jobs completed."""
    g = jobs.groupBy("case_id").agg(F.bool_and(F.col("status") == "COMPLETED").alias("all"), F.bool_or(F.col("status") == "COMPLETED").alias("some"), F.bool_and(F.col("status") == "UNAVAILABLE").alias("none"))
    s = F.when(F.col("cancelled"), "CANCELLED").when(F.col("all").isNull() | F.col("all"), "COMPLETED").when(F.col("some"), "PARTIAL").when(F.col("none"), "UNAVAILABLE").otherwise("FAILED")
    return cases.join(g, "case_id", "left").select("case_id", s.alias("status"))


def source_health(runs: DataFrame) -> DataFrame:
    """Per source: runs, success rate, mean duration, timeouts, last success and failure, and working, degraded (below half) or unavailable (none)."""
    g = runs.groupBy("source_name").agg(
        F.count("*").alias("runs"), F.avg(F.col("ok").cast("double")).alias("success_rate"), F.avg("seconds").alias("mean_seconds"), F.count_if("timed_out").alias("timeouts"),
        F.max(F.when(F.col("ok"), F.col("at"))).alias("last_success"), F.max(F.when(~F.col("ok"), F.col("at"))).alias("last_failure"),
    )
    return g.withColumn("status", F.when(F.col("success_rate") == 0, "unavailable").when(F.col("success_rate") < 0.5, "degraded").otherwise("working"))


def select_urls(evidence: DataFrame, used: DataFrame, most: int = 10) -> DataFrame:
    """The first distinct URLs of each case that were not used yet, within what is left of `most`. `used`: case_id, value."""
    first = evidence.where("entity_type = 'URL'").groupBy("case_id", "value").agg(F.min("evidence_id").alias("evidence_id"))
    first = first.join(used.select("case_id", "value").distinct(), ["case_id", "value"], "left_anti")
    spent = used.groupBy("case_id").agg(F.countDistinct("value").alias("spent"))
    n = F.row_number().over(Window.partitionBy("case_id").orderBy("evidence_id"))
    return first.withColumn("n", n).join(spent, "case_id", "left").where(F.col("n") <= most - F.coalesce("spent", F.lit(0))).select("case_id", "evidence_id", "value")


def purge_expired(parents: DataFrame, children: list[DataFrame], cutoff: Column | None, key: str = "case_id", at: str = "created_at") -> list[DataFrame]:
    """What stays of `parents` and of each child table after parents older than `cutoff` are deleted with their children; None keeps all."""
    if cutoff is None:
        return [parents, *children]
    gone = parents.where(F.col(at) < cutoff).select(key).distinct()
    return [parents.where(F.col(at).isNull() | (F.col(at) >= cutoff)), *[c.join(gone, key, "left_anti") for c in children]]


def expand_graph(roots: DataFrame, links: DataFrame, depth: int = 2) -> DataFrame:
    """(case_id, value, depth): what is reached from each case's root over links (case_id, src, dst) in at most `depth` steps, at its least depth."""
    seen = roots.select("case_id", F.col("root_value").alias("value"), F.lit(0).alias("depth"))
    edge = seen
    for d in range(1, depth + 1):
        nxt = edge.join(links, (edge["case_id"] == links["case_id"]) & (edge["value"] == links["src"])).select(edge["case_id"], F.col("dst").alias("value")).distinct()
        edge = nxt.join(seen.select("case_id", "value"), ["case_id", "value"], "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(edge)
    return seen
