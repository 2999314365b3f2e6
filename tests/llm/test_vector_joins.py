"""Joins of vectors: what grows with the rows isn't broadcast, whatever sizes the planner guesses for arrays."""

import pytest
from pyspark.sql import functions as F

from docwatch.llm import multi_index, topk


@pytest.fixture
def guessed_small(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def joins(df):
    """Kinds of joins in the plan that ran, and the result."""
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return plan.count("BroadcastHashJoin"), plan.count("SortMergeJoin"), plan.count("BroadcastExchange"), rows


def test_tiles_of_top_k(spark, guessed_small, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 50)
    monkeypatch.setattr(topk, "QUERIES", 10)
    v = [(i, [(i * 7 + k * 31) % 41 - 20 for k in range(8)]) for i in range(300)]
    df = topk.search(spark.createDataFrame(v, "vec_id long, embedding array<int>"), F.col("vec_id") % 20 == 0, 5)
    hashed, merged, sent, rows = joins(df)
    assert (hashed, sent) == (0, 0) and merged == 2
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    want = {(q, n + 1, i, -s) for q, x in v if q % 20 == 0 for n, (s, i) in enumerate(sorted((-dot(x, y), i) for i, y in v if i != q)[:5])}
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)


def test_zones_of_the_index(spark, guessed_small, monkeypatch):
    """Only the places of cells are sent, which are bounded."""
    monkeypatch.setattr(multi_index, "ZONE", 40)
    v = [(i, [float((i * 7 + k * 31) % 41 - 20) + i / 1000 for k in range(8)]) for i in range(300)]
    df = multi_index.search(spark.createDataFrame(v, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, 5)
    hashed, merged, sent, rows = joins(df)
    assert (hashed, sent) == (1, 1) and merged == 1
    assert {r.query_id for r in rows} == set(range(0, 300, 50)) and len(rows) == 30
    of = dict(v)
    assert all(r.score == pytest.approx(sum((x - y) ** 2 for x, y in zip(of[r.query_id], of[r.vec_id])) ** 0.5) for r in rows)
