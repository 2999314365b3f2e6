"""State of monitored sources and domains, derived from the facts of each fetch rather than kept in mutable counters.

Facts: outcome_id, ts, domain (or another key), strategy, success, status_code, error, latency_ms, content_bytes, extraction_ok, quality, page_type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Categories in which a site pushes back; they say nothing about a page being gone.
BLOCKED = ("http_403", "http_429", "robots_blocked", "soft_blocked")
DEGRADED_AT, OPEN_AT = 3, 6


def failure_category(status: Column, error: Column) -> Column:
    """Category of a failed fetch by its status, else by its transport error; "none" if neither tells of a failure."""
    e = F.lower(error)
    has = lambda *words: F.coalesce(sum((e.contains(w).cast("int") for w in words), F.lit(0)) > 0, F.lit(False))
    return (
        F.when(status.isin(403, 404, 410, 429), F.concat(F.lit("http_"), status.cast("string")))
        .when((status >= 500) & (status < 600), "http_5xx")
        .when(status >= 400, "other_http_error")
        .when(status.isNotNull(), "none")
        .when(error.isNull(), "none")
        .when(has("dns", "nodename", "name or service not known"), "dns_failure")
        .when(has("ssl", "certificate", "tls"), "tls_failure")
        .when(has("timeout", "timed out"), "timeout")
        .otherwise("connection_failure")
    )


def with_category(outcomes: DataFrame) -> DataFrame:
    return outcomes.withColumn("category", failure_category(F.col("status_code"), F.col("error")))


#: A delay's ceiling and what it ends below (ms), requests at once, and what a success, a failure and a throttled fetch do to it: factor and floor.
MOST_DELAY, LEAST_DELAY, CONCURRENCY = 30_000.0, 50.0, 5
ON_SUCCESS, ON_FAILURE, ON_THROTTLE = 0.9, (1.5, 200.0), (2.0, 500.0)
#: Seconds of a key's history that one task folds; results don't depend on it.
BUCKET = 21_600


def _in_order(key: str):
    return Window.partitionBy(key).orderBy("ts", "outcome_id")


def _bucket(at: str, seconds: int) -> Column:
    return F.floor(F.unix_micros(F.col(at).cast("timestamp")) / F.lit(seconds * 1_000_000))


def since_reset(df: DataFrame, key: str, order: list[str], resets: Column, values: dict[str, Column], seconds: int = BUCKET) -> DataFrame:
    """`df` with a column for each of `values` (numbers): its sum since the last row of the key for which `resets` holds, that row included.

    A scan in segments: `order` begins with a time, and a key's rows are cut by it into buckets of `seconds`, each summed by itself; one row a bucket tells whether it resets and what its end adds up to.
    Running over these gives what each bucket begins with. So a key's history, however long, is spread over its buckets.
    """
    d = df.withColumns({"b_": _bucket(order[0], seconds), "r_": F.coalesce(resets, F.lit(False)).cast("int")}).withColumns({f"{v}_v": F.coalesce(c, F.lit(0)).cast("long") for v, c in values.items()})
    d = d.withColumn("island_", F.sum("r_").over(Window.partitionBy(key, "b_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(key, "b_", "island_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({v: F.sum(f"{v}_v").over(inside) for v in values})
    ends = d.groupBy(key, "b_", "island_").agg(*[F.sum(f"{v}_v").alias(v) for v in values])
    ends = ends.groupBy(key, "b_").agg(F.max("island_").alias("r_"), *[F.max_by(v, "island_").alias(v) for v in values])
    along = Window.partitionBy(key).orderBy("b_")
    ends = ends.withColumn("run_", F.sum((F.col("r_") > 0).cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    upto = Window.partitionBy(key, "run_").orderBy("b_").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumns({f"{v}_c": F.sum(v).over(upto) for v in values})
    begins = ends.select(F.col(key).alias("k_"), F.col("b_").alias("kb_"), *[F.lag(f"{v}_c").over(along).alias(f"{v}_c") for v in values])
    d = d.join(begins, F.col(key).eqNullSafe(F.col("k_")) & F.col("b_").eqNullSafe(F.col("kb_")))
    carried = {v: F.col(v) + F.when(F.col("island_") == 0, F.coalesce(f"{v}_c", F.lit(0))).otherwise(0) for v in values}
    return d.withColumns(carried).select(*[c for c in df.columns if c not in values], *values)


def _before(df: DataFrame, key: str, column: str, seconds: int) -> DataFrame:
    """`df` with `before`, the column's value in the row before of the key: within buckets of time, with the last value of the bucket before for the first row."""
    d = df.withColumn("b_", _bucket("ts", seconds))
    last = d.groupBy(key, "b_").agg(F.max_by(column, F.struct("ts", "outcome_id")).alias("last_"))
    last = last.select(F.col(key).alias("k_"), F.col("b_").alias("kb_"), F.lag("last_").over(Window.partitionBy(key).orderBy("b_")).alias("last_"))
    near = F.lag(column).over(Window.partitionBy(key, "b_").orderBy("ts", "outcome_id"))
    d = d.withColumn("before", near).join(last, F.col(key).eqNullSafe(F.col("k_")) & (F.col("b_") == F.col("kb_")))
    return d.withColumn("before", F.coalesce("before", "last_")).drop("b_", "k_", "kb_", "last_")


def removed_restored(outcomes: DataFrame, key: str = "domain", threshold: int = 3, seconds: int = BUCKET) -> DataFrame:
    """Events (key, ts, outcome_id, event): REMOVED at the `threshold`-th failure in a row, RESTORED at the next success.

    Blocked or throttled fetches neither count nor interrupt the row. Failures since the last success are counted in segments of time.
    """
    counts = (~F.col("category").isin(*BLOCKED)) & (F.col("category") != "none")
    o = with_category(outcomes).withColumn("counts", counts.cast("int"))
    o = since_reset(o, key, ["ts", "outcome_id"], F.col("success"), {"failures": F.col("counts")}, seconds)
    o = _before(o, key, "failures", seconds)
    event = F.when((F.col("counts") == 1) & (F.col("failures") == threshold), "REMOVED").when(F.col("success") & (F.col("before") >= threshold), "RESTORED")
    return o.withColumn("event", event).where("event IS NOT NULL").select(key, "ts", "outcome_id", "event")


def next_interval(checks: DataFrame, key: str, changed: str, least: int, most: int, order: list[str], seconds: int = BUCKET) -> DataFrame:
    """`checks` with interval_seconds after each: `least` after a change, doubled after each check without one, at most `most`. `order` begins with a time."""
    c = since_reset(checks, key, order, F.col(changed), {"rows__": F.lit(1), "changes__": F.col(changed).cast("int")}, seconds)
    doublings = F.col("rows__") - F.when(F.col("changes__") > 0, 1).otherwise(0)
    interval = F.least(F.lit(float(most)), F.lit(float(least)) * F.pow(F.lit(2.0), F.least(doublings, F.lit(60))))
    return c.withColumn("interval_seconds", interval.cast("long")).drop("rows__", "changes__")


def due_sources(sources: DataFrame, active_jobs: DataFrame, now: Column, slots: int) -> DataFrame:
    """At most `slots` active sources that are due (next_crawl_at null or past) and have no active job, the longest due first."""
    due = sources.where(F.col("active") & (F.col("next_crawl_at").isNull() | (F.col("next_crawl_at") <= now)))
    return due.join(active_jobs.select("source_id"), "source_id", "left_anti").orderBy(F.col("next_crawl_at").asc_nulls_first(), "source_id").limit(slots)


def _then(f: Column, x: Column) -> Column:
    """The map of delays `f` (low, from, factor, high: low below `from`, else factor times the delay, at most high) followed by the outcome `x` (ok, factor, floor).

    Every outcome is such a map and so is every chain of them, so a whole bucket is one. Delays are 0 or between their least and most, so factors beyond a million change nothing.
    """
    held = lambda v: F.greatest(F.lit(1e-6), F.least(F.lit(1e6), v))
    eased = lambda v: F.when(v * ON_SUCCESS < LEAST_DELAY, 0.0).otherwise(v * ON_SUCCESS)
    raised = lambda v: F.least(F.lit(MOST_DELAY), F.greatest(x["floor"], v * x["factor"]))
    bound = F.greatest(f["from"], F.when(x["ok"], LEAST_DELAY / (f["factor"] * ON_SUCCESS)).otherwise(x["floor"] / (f["factor"] * x["factor"])))
    low = F.when(bound > f["from"], F.when(x["ok"], 0.0).otherwise(F.least(F.lit(MOST_DELAY), x["floor"]))).otherwise(F.when(x["ok"], eased(f["low"])).otherwise(raised(f["low"])))
    return F.struct(
        low.alias("low"), bound.alias("from"), held(f["factor"] * F.when(x["ok"], ON_SUCCESS).otherwise(x["factor"])).alias("factor"), F.when(x["ok"], eased(f["high"])).otherwise(raised(f["high"])).alias("high")
    )


def _delays(o: DataFrame, key: str, seconds: int) -> DataFrame:
    """`o` (with category, retry_ms) with delay_ms after each row: the outcomes of a bucket make one map, the maps of a key give each bucket's first delay, from which its rows are folded."""
    throttled = F.col("category").isin(*BLOCKED)
    factor, floor = (F.when(throttled, ON_THROTTLE[n]).otherwise(ON_FAILURE[n]) for n in (0, 1))
    row = F.struct("ts", "outcome_id", (F.col("category") == "none").alias("ok"), factor.alias("factor"), F.greatest(floor, F.coalesce("retry_ms", F.lit(0.0))).alias("floor"))
    none = F.struct(F.lit(0.0).alias("low"), F.lit(0.0).alias("from"), F.lit(1.0).alias("factor"), F.lit(MOST_DELAY).alias("high"))
    b = o.groupBy(key, _bucket("ts", seconds).alias("b_")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    maps = b.select(key, "b_", F.aggregate("rows", none, _then).alias("m"))
    of_key = maps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("b_", "m"))).alias("ms"))
    put = lambda m, v: F.when(v < m["from"], m["low"]).otherwise(F.least(m["high"], v * m["factor"]))
    start = F.struct(F.lit(0.0).alias("v"), F.array().cast("array<struct<b_:bigint,v:double>>").alias("out"))
    run = F.aggregate("ms", start, lambda acc, x: F.struct(put(x["m"], acc["v"]).alias("v"), F.concat(acc["out"], F.array(F.struct(x["b_"].alias("b_"), acc["v"].alias("v")))).alias("out")))
    begins = of_key.select(F.col(key).alias("k_"), F.inline(run["out"]))
    begins = begins.select("k_", F.col("b_").alias("kb_"), F.col("v").alias("begin"))
    each = F.struct(F.col("begin").alias("v"), F.array().cast("array<double>").alias("out"))

    def step(acc, x):
        ok = F.when(acc["v"] * ON_SUCCESS < LEAST_DELAY, 0.0).otherwise(acc["v"] * ON_SUCCESS)
        v = F.when(x["ok"], ok).otherwise(F.least(F.lit(MOST_DELAY), F.greatest(x["floor"], acc["v"] * x["factor"])))
        return F.struct(v.alias("v"), F.concat(acc["out"], F.array(v)).alias("out"))

    done = b.join(begins, F.col(key).eqNullSafe(F.col("k_")) & (F.col("b_") == F.col("kb_"))).withColumn("out", F.aggregate("rows", each, step)["out"])
    done = done.select(F.col(key).alias("k_"), F.explode(F.arrays_zip("rows", "out")).alias("z")).select("k_", F.col("z.rows.outcome_id").alias("id_"), F.col("z.rows.ts").alias("ts_"), F.col("z.out").alias("delay_ms"))
    return o.join(done, F.col(key).eqNullSafe(F.col("k_")) & (F.col("outcome_id") == F.col("id_")) & (F.col("ts") == F.col("ts_"))).drop("k_", "id_", "ts_")


def circuit_state(outcomes: DataFrame, key: str = "domain", retry_after: str | None = None, seconds: int = BUCKET) -> DataFrame:
    """State after each outcome (key, ts, outcome_id, all three given, each once): consecutive_failures, circuit_state (healthy, degraded, open), opened_at, delay_ms and concurrency.

    Three failures in a row degrade a domain, six open its circuit; opened_at stays that of the sixth until a success closes it. A success takes a tenth off the delay, below 50 ms it ends; a failure makes it
    half as long again, at least 200 ms, a throttled one twice, at least 500 ms; never less than the seconds that the server asked for (`retry_after`), never more than 30 s. From the third failure
    on one request goes out at once. Counts and delays are scanned in segments of time, so one domain's history is spread over many tasks.
    """
    bad = F.col("category") != "none"
    o = with_category(outcomes).withColumn("retry_ms", F.col(retry_after).cast("double") * 1000 if retry_after else F.lit(None).cast("double"))
    o = _delays(o, key, seconds)
    o = since_reset(o, key, ["ts", "outcome_id"], ~bad, {"consecutive_failures": bad.cast("int")}, seconds)
    n = F.col("consecutive_failures")
    # the time of the sixth failure, as a number that counts once a row of failures
    sixth = F.when(bad & (n == OPEN_AT), F.unix_micros(F.col("ts").cast("timestamp")))
    o = since_reset(o, key, ["ts", "outcome_id"], ~bad, {"sixth": sixth}, seconds)
    opened = F.timestamp_micros("sixth").cast(o.schema["ts"].dataType)
    state = F.when(n >= OPEN_AT, "open").when(n >= DEGRADED_AT, "degraded").otherwise("healthy")
    return o.select(
        key, "ts", "outcome_id", "category", "consecutive_failures", state.alias("circuit_state"), F.when(n >= OPEN_AT, opened).alias("opened_at"), "delay_ms",
        F.when(n >= DEGRADED_AT, 1).otherwise(CONCURRENCY).alias("concurrency"),
    )


def circuit_open_edges(states: DataFrame, key: str = "domain") -> DataFrame:
    """The rows at which a circuit opens."""
    before = F.lag("circuit_state").over(_in_order(key))
    return states.withColumn("before", before).where((F.col("circuit_state") == "open") & ~F.col("before").eqNullSafe("open")).drop("before")


def allowed(state: Column, opened_at: Column, now: Column, seconds: int = 120) -> Column:
    """Whether a request may go out: always but while a circuit is open and its time isn't over."""
    return (state != "open") | opened_at.isNull() | (now >= opened_at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(seconds))))


def metrics_rollup(events: DataFrame, labels: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Per labels: count, sum and the histogram of `value` as rows (bucket = first bound not below it, "+Inf" beyond)."""
    bucket = F.lit("+Inf")
    for b in sorted(bounds, reverse=True):
        bucket = F.when(F.col(value) <= b, F.lit(f"{b:g}")).otherwise(bucket)
    return events.groupBy(*labels, bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def _rates(strategy: str) -> list[Column]:
    here = F.col("strategy") == strategy
    return [
        F.count_if(here).alias(f"{strategy}_attempts"),
        F.count_if(here & F.col("success")).alias(f"{strategy}_successes"),
        F.avg(F.when(here, F.col("latency_ms"))).alias(f"avg_{strategy}_latency_ms"),
    ]


def domain_profile(outcomes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """What is learned of each domain (or other keys): attempts, successes, means, blocks. Means are of the values that are there.

    With a column `completeness` also its mean and number, with `comparison` (of the two strategies' captures of a page) how often each was better.
    """
    o = with_category(outcomes)
    more = [F.avg("completeness").alias("avg_completeness"), F.count("completeness").alias("completeness_observations")] if "completeness" in o.columns else []
    if "comparison" in o.columns:
        more += [F.count_if(F.col("comparison") == v).alias(v) for v in ("browser_superior", "http_superior", "browser_equivalent")]
    return o.groupBy(*(keys or ["domain"])).agg(
        *_rates("http"),
        *_rates("browser"),
        F.count_if((F.col("strategy") == "http") & F.col("success") & ~F.col("extraction_ok")).alias("http_extraction_failures"),
        F.avg("content_bytes").alias("avg_content_bytes"),
        F.avg("quality").alias("avg_extraction_quality"),
        F.count("quality").alias("quality_observations"),
        F.count_if(F.col("category").isin(*BLOCKED)).alias("blocked"),
        F.count_if(F.col("category") == "soft_blocked").alias("soft_blocked"),
        F.max("ts").alias("last_observed_at"),
        *more,
    )


def failure_counts(outcomes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, category, n) of the failures."""
    return with_category(outcomes).where("category <> 'none'").groupBy(*(keys or ["domain"]), "category").agg(F.count("*").alias("n"))


def status_classes(outcomes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, status_class, n) of the responses: 2xx, 4xx, ..."""
    kind = F.concat(F.floor(F.col("status_code") / 100).cast("string"), F.lit("xx"))
    return outcomes.where("status_code IS NOT NULL").groupBy(*(keys or ["domain"]), kind.alias("status_class")).agg(F.count("*").alias("n"))


def pattern_profile(outcomes: DataFrame) -> DataFrame:
    """By (domain, pattern, page_type) and by (domain, pattern) in one pass: attempts, successes, means of quality and latency.

    `outcomes` has `pattern`. In rows for all page types, page_type is null and rolled_up true.
    """
    o = outcomes.withColumn("page_type", F.coalesce("page_type", F.lit("UNKNOWN")))
    g = o.groupingSets([[F.col("domain"), F.col("pattern"), F.col("page_type")], [F.col("domain"), F.col("pattern")]], "domain", "pattern", "page_type")
    return g.agg(
        (F.grouping("page_type") == 1).alias("rolled_up"),
        F.count("*").alias("attempts"),
        F.count_if("success").alias("successes"),
        F.avg("latency_ms").alias("avg_latency_ms"),
        F.avg("quality").alias("avg_quality"),
    )


def health_score(profile: DataFrame, min_observations: int = 5) -> DataFrame:
    """`profile` with health (0 to 100) and insufficient_data: 40 availability, 30 extraction, 15 not blocked, 15 latency (full at 1 s, none at 10 s)."""
    n = F.col("http_attempts") + F.col("browser_attempts")
    available = (F.col("http_successes") + F.col("browser_successes")) / n
    extracted = F.when(F.col("http_successes") > 0, (F.col("http_successes") - F.col("http_extraction_failures")) / F.col("http_successes")).otherwise(F.lit(1.0))
    ms = F.coalesce(F.nullif("avg_http_latency_ms", F.lit(0.0)), F.nullif("avg_browser_latency_ms", F.lit(0.0)), F.lit(0.0))
    fast = F.when(ms <= 1000, 1.0).when(ms >= 10000, 0.0).otherwise(1 - (ms - 1000) / 9000)
    score = F.bround(available * 40 + extracted * 30 + (1 - F.col("blocked") / n) * 15 + fast * 15, 1)
    few = n < min_observations
    return profile.withColumns({"health": F.when(few, F.lit(50.0)).otherwise(score), "insufficient_data": few})


def _from_history(p: str, least: int, has: list[str]) -> tuple[Column, Column]:
    """(browser, http or null (too little history); why), by the counters with prefix `p`. Counters that a profile doesn't have count as 0.

    The first rule that holds decides: browser better in 60 percent of the compared captures, low quality, low completeness, soft blocks, failures.
    """
    c = lambda name: F.coalesce(F.col(f"{p}{name}"), F.lit(0)) if name in has else F.lit(0)
    n = c("http_attempts") + c("browser_attempts")
    failing = F.when(c("http_attempts") > 0, 1 - c("http_successes") / c("http_attempts")).otherwise(F.lit(0.0))
    unread = F.when(c("http_successes") > 0, c("http_extraction_failures") / c("http_successes")).otherwise(F.lit(0.0))
    viable = (c("browser_attempts") == 0) | (c("browser_successes") / c("browser_attempts") > 0.5)
    compared = c("browser_superior") + c("http_superior") + c("browser_equivalent")
    tried = c("http_attempts") >= least
    poor = tried & (c("quality_observations") >= least) & (c("avg_extraction_quality") < 0.4)
    partial = tried & (c("completeness_observations") >= least) & (c("avg_completeness") < 0.4)
    soft = tried & (c("soft_blocked") / c("http_attempts") > 0.3)
    why = (
        F.when((compared >= least) & (c("browser_superior") / compared >= 0.6), F.array(F.lit("browser_superior"))).when(poor, F.array(F.lit("low_quality"))).when(partial, F.array(F.lit("low_completeness")))
        .when(soft, F.array(F.lit("soft_blocks"))).otherwise(F.array_compact(F.array(F.when(unread > 0.6, "extraction_failures"), F.when(failing > 0.6, "http_failures"))))
    )
    why = F.when(viable, why).otherwise(F.array().cast("array<string>"))
    known = F.coalesce(n, F.lit(0)) >= least
    return F.when(known, F.when(F.size(why) > 0, "browser").otherwise("http")), F.when(known, F.when(F.size(why) > 0, why).otherwise(F.array(F.lit("http_suffices"))))


def routing_decision(requests: DataFrame, domains: DataFrame, patterns: DataFrame, min_observations: int = 5) -> DataFrame:
    """`requests` (domain, pattern, requested, js_required) with strategy, basis and reasons.

    Precedence: what was asked for, the pattern's history, the domain's, a script-driven page, plain HTTP.
    `domains` and `patterns` are profiles by domain and by (domain, pattern).
    """
    d = domains.select("domain", *[F.col(c).alias(f"d_{c}") for c in domains.columns if c != "domain"])
    p = patterns.select("domain", "pattern", *[F.col(c).alias(f"p_{c}") for c in patterns.columns if c not in ("domain", "pattern")])
    r = requests.join(d, "domain", "left").join(p, ["domain", "pattern"], "left")
    (by_p, why_p), (by_d, why_d) = _from_history("p_", min_observations, patterns.columns), _from_history("d_", min_observations, domains.columns)
    asked = F.when(F.col("requested") != "auto", F.col("requested"))
    script = F.when(F.col("js_required"), "browser")
    basis = F.when(asked.isNotNull(), "explicit").when(by_p.isNotNull(), "url_pattern").when(by_d.isNotNull(), "domain").when(script.isNotNull(), "js_heuristic").otherwise("default")
    why = F.when(asked.isNotNull(), F.array(F.lit("asked_for"))).otherwise(F.coalesce(why_p, why_d, F.when(script.isNotNull(), F.array(F.lit("js_required"))), F.array(F.lit("no_history"))))
    return r.select(*requests.columns, F.coalesce(asked, by_p, by_d, script, F.lit("http")).alias("strategy"), basis.alias("basis"), why.alias("reasons"))


def capabilities(patterns: DataFrame) -> DataFrame:
    """Per domain and page type of a pattern profile: attempts, success rate, quality weighted by attempts, confidence band."""
    rows = patterns.where("NOT rolled_up")
    q = F.sum(F.col("avg_quality") * F.col("attempts")) / F.sum(F.when(F.col("avg_quality").isNotNull(), F.col("attempts")))
    out = rows.groupBy("domain", "page_type").agg(F.sum("attempts").alias("attempts"), (F.sum("successes") / F.sum("attempts")).alias("success_rate"), q.alias("quality"))
    band = F.when(F.col("attempts") >= 50, "high").when(F.col("attempts") >= 10, "medium").otherwise("low")
    return out.withColumn("confidence", band)
