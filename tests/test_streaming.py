"""Streams replay to the rows of their batch twins."""

import pytest
from pyspark.sql import functions as F

from docwatch.operators import monitor as M
from docwatch.plans.bindings import FETCH_OUTCOMES, bind
from docwatch.streaming import jobs as S


@pytest.fixture(scope="module")
def replay(spark, sf, tmp_path_factory):
    """The outcomes in three files, in time order."""
    path = str(tmp_path_factory.mktemp("outcomes"))
    o = bind(spark, sf, FETCH_OUTCOMES, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    for k in range(3):
        o.where((F.col("outcome_id") >= k * 350) & (F.col("outcome_id") < (k + 1) * 350)).coalesce(1).write.mode("append").parquet(path)
    schema = ", ".join(f"{n} {t}" for n, t in o.dtypes)
    return o, path, schema


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_removed_restored(spark, replay, tmp_path):
    o, path, schema = replay
    S.drain(S.removed_restored(S.read_stream(spark, path, schema), threshold=2), None, f"{tmp_path}/c", f"{tmp_path}/out")
    assert rows(spark.read.parquet(f"{tmp_path}/out"), "domain", "outcome_id", "event") == rows(M.removed_restored(o, threshold=2), "domain", "outcome_id", "event")


def test_circuit(spark, replay, tmp_path):
    o, path, schema = replay
    S.drain(S.circuit(S.read_stream(spark, path, schema)), None, f"{tmp_path}/c", f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert rows(out, "domain", "outcome_id", "consecutive_failures", "circuit_state") == rows(M.circuit_state(o), "domain", "outcome_id", "consecutive_failures", "circuit_state")
    assert out.agg(F.max("delay_ms"), F.min("delay_ms")).first()[1] >= 0


def test_collect_adds_nothing_twice(spark, replay, tmp_path):
    o, path, schema = replay
    for _ in range(2):
        S.collect(S.read_stream(spark, path, schema), f"{tmp_path}/t", f"{tmp_path}/c", ["domain", "strategy"])
    assert spark.read.parquet(f"{tmp_path}/t").count() == o.select("domain", "strategy").distinct().count()


def test_dedup_and_matches(spark, replay, tmp_path):
    o, path, schema = replay
    S.drain(S.deduplicated(S.read_stream(spark, path, schema), ["domain"], "ts", "60 days"), None, f"{tmp_path}/c", f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == o.select("domain").distinct().count()


def test_late_rows_are_kept_apart(spark, replay, tmp_path):
    o, path, schema = replay
    S.split_late(S.read_stream(spark, path, schema), "ts", 3600, f"{tmp_path}/k", f"{tmp_path}/l", f"{tmp_path}/c")
    assert spark.read.parquet(f"{tmp_path}/k").count() + spark.read.parquet(f"{tmp_path}/l").count() == o.count()


def test_late_bound_outlives_a_restart(spark, replay, tmp_path):
    """With two runs the second goes on from the tables: what is late is as in one run over batches of one file."""
    o, path, schema = replay
    top = {r.k: r.t for r in o.groupBy((F.col("outcome_id") / 350).cast("int").alias("k")).agg(F.max("ts").alias("t")).collect()}
    extra = o.limit(5).withColumn("outcome_id", F.col("outcome_id") + 10**6)  # old rows in a file of their own, read by the second run
    folder = f"{tmp_path}/in"
    o.coalesce(1).write.parquet(folder)
    S.split_late(S.read_stream(spark, folder, schema), "ts", 3600, f"{tmp_path}/k", f"{tmp_path}/l", f"{tmp_path}/c")
    extra.coalesce(1).write.mode("append").parquet(folder)
    S.split_late(S.read_stream(spark, folder, schema), "ts", 3600, f"{tmp_path}/k", f"{tmp_path}/l", f"{tmp_path}/c")
    bound = max(top.values())
    late = {r.outcome_id for r in spark.read.parquet(f"{tmp_path}/l").collect()}
    assert late == {r.outcome_id for r in extra.collect() if (bound - r.ts).total_seconds() > 3600}


def test_changes_replay_to_the_versions(spark, tmp_path):
    """Versions of a stream in batches are those of a plain walk over each page's captures; a second run adds nothing."""
    import datetime
    import random

    rng, rows, t0 = random.Random(3), [], datetime.datetime(2024, 1, 1)
    for n in range(300):
        rows.append((f"u{rng.randrange(25)}", t0 + datetime.timedelta(minutes=n), f"h{rng.randrange(3)}", rng.random() < 0.1, n))
    schema = "normalized_url string, collected_at timestamp, content_hash string, blocked boolean, n long"
    for k in range(3):
        spark.createDataFrame(rows[k * 100 : (k + 1) * 100], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    want, last = [], {}
    for url, at, h, blocked, n in rows:
        if not blocked and last.get(url, (None, 0))[0] != h:
            version = last.get(url, (None, 0))[1] + 1
            want.append((url, version, h, n, "UPDATED" if url in last else "NEW"))
            last[url] = (h, version)
    for _ in range(2):
        S.stream_changes(S.read_stream(spark, f"{tmp_path}/in", schema), f"{tmp_path}/v", f"{tmp_path}/c")
        got = spark.read.parquet(f"{tmp_path}/v")
        assert rows_of(got) == sorted(want)


def rows_of(df):
    return sorted((r.normalized_url, r.version, r.content_hash, r.n, r.status) for r in df.collect())


def test_matches(spark, sf, tmp_path):
    """Posts with a signal, as in the batch."""
    from docwatch.operators import feeds

    posts = spark.createDataFrame([(1, "Selling a bike", "cheap", ""), (2, "Weather", "rain", ""), (3, "Looking for a BIKE", "", "")], "id long, title string, content string, flair string")
    posts.coalesce(1).write.parquet(f"{tmp_path}/in")
    S.drain(S.matches(S.read_stream(spark, f"{tmp_path}/in", "id long, title string, content string, flair string"), ["bike"]), None, f"{tmp_path}/c", f"{tmp_path}/out")
    want = {r.id for r in feeds.match_keywords(posts, ["bike"]).where("signal").collect()}
    assert {r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want == {1, 3}


def test_sessions(spark, replay, tmp_path):
    """Runs without a longer gap; those that the watermark has passed are out."""
    o, path, schema = replay
    S.drain(S.sessions(S.read_stream(spark, path, schema), "ts", "domain", "2 hours", "0 seconds"), None, f"{tmp_path}/c", f"{tmp_path}/out")
    got = {(r.start, r.domain): r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r.start, r.domain): r.n for r in o.groupBy(F.session_window("ts", "2 hours").alias("w"), "domain").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "domain", "n").collect()}
    assert got and all(want[k] == n for k, n in got.items())


def test_windows(spark, replay, tmp_path):
    o, path, schema = replay
    S.drain(S.bursts(S.read_stream(spark, path, schema), "ts", "strategy", "1 day", "1 day", "0 seconds", 5), None, f"{tmp_path}/c", f"{tmp_path}/out")
    got = {(r.start, r.strategy): r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r.start, r.strategy): r.n for r in o.groupBy(F.window("ts", "1 day").start.alias("start"), "strategy").agg(F.count("*").alias("n")).where("n >= 5").collect()}
    assert got and all(want[k] == n for k, n in got.items()) and len(want) - len(got) <= 4
