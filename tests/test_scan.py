"""Scans in segments of time against a fold over each key's history, whatever the segments are."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docwatch.operators import monitor as M


def history(seed, n=400):
    rng = random.Random(seed)
    rows, at = [], {}
    for i in range(n):
        key = rng.choice(["a", "a", "a", "b", None])
        at[key] = at.get(key, datetime(2024, 1, 1)) + timedelta(minutes=rng.choice([0, 1, 7, 90, 3000]))
        ok = rng.random() < (0.9 if i % 120 > 80 else 0.3)
        status = 200 if ok else rng.choice([403, 404, 429, 500, 503])
        rows.append((i, key, at[key], ok, status, None, rng.choice([None, 1, 20, 90]) if status == 429 else None))
    return rows


def folded(rows):
    """outcome_id to (failures, delay, opened_at, event, interval)."""
    out, state = {}, {}
    for i, key, ts, ok, status, _, retry in sorted(rows, key=lambda r: (r[2], r[0])):
        failures, delay, opened, counted, interval = state.get(key, (0, 0.0, None, 0, 600))
        event = None
        if ok:
            delay = 0.0 if delay * 0.9 < 50 else delay * 0.9
            event = "RESTORED" if counted >= 3 else None
            failures, opened, counted, interval = 0, None, 0, 600
        else:
            throttled = status in (403, 429)
            delay = min(30_000.0, max(500.0 if throttled else 200.0, delay * (2 if throttled else 1.5), (retry or 0) * 1000))
            failures += 1
            opened = ts if failures == 6 else opened
            counted += not throttled
            event = "REMOVED" if counted == 3 and not throttled else None
            interval = min(86_400, interval * 2)
        state[key] = failures, delay, opened, counted, interval
        out[i] = failures, round(delay, 6), opened if failures >= 6 else None, event, interval
    return out


@pytest.mark.parametrize("seed, seconds", [(1, 60), (2, 21_600), (3, 10**9)])
def test_states_are_those_of_the_fold(spark, seed, seconds):
    rows = history(seed)
    df = spark.createDataFrame(rows, "outcome_id long, domain string, ts timestamp_ntz, success boolean, status_code int, error string, retry int")
    want = folded(rows)
    got = {r.outcome_id: r for r in M.circuit_state(df, retry_after="retry", seconds=seconds).collect()}
    assert len(got) == len(rows) and max(r.consecutive_failures for r in got.values()) >= 6
    for i, (failures, delay, opened, _, _) in want.items():
        r = got[i]
        assert (r.consecutive_failures, r.opened_at) == (failures, opened) and r.delay_ms == pytest.approx(delay, abs=1e-5)
        assert (r.circuit_state, r.concurrency) == ("open" if failures >= 6 else "degraded" if failures >= 3 else "healthy", 1 if failures >= 3 else 5)
    events = {r.outcome_id: r.event for r in M.removed_restored(df, seconds=seconds).collect()}
    assert events == {i: w[3] for i, w in want.items() if w[3]} and events


def test_intervals(spark):
    rows = history(5, 200)
    df = spark.createDataFrame(rows, "outcome_id long, domain string, ts timestamp_ntz, success boolean, status_code int, error string, retry int")
    got = [{r.outcome_id: r.interval_seconds for r in M.next_interval(df, "domain", "success", 600, 86_400, ["ts", "outcome_id"], s).collect()} for s in (60, 10**6)]
    assert got[0] == got[1]
    first = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        first.setdefault(r[1], []).append(r)
    for mine in first.values():
        interval, changed = 600, False
        for i, _, _, ok, *_ in mine:
            interval = 600 if ok else min(86_400, interval * 2)
            assert got[0][i] == interval, i


def test_one_key_over_many_buckets(spark):
    df = spark.range(100).select(F.lit("d").alias("domain"), (F.lit(datetime(2024, 1, 1)) + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("ts"), F.col("id").alias("outcome_id"))
    assert [r.n for r in M.since_reset(df, "domain", ["ts", "outcome_id"], F.lit(False), {"n": F.lit(1)}).orderBy("outcome_id").collect()] == list(range(1, 101))
