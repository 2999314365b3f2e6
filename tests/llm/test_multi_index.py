"""The inverted multi-index against brute force: recall, exact scores, ties, odd rows, crowded cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docwatch.llm import multi_index, queries
from tests.conftest import DATA

KIND = "vec_id long, embedding array<float>, label int"


def brute(ids, x, asked, k):
    """Per query its k nearest (score, id), nearest first, of the rows of other ids."""
    out = {}
    for i in np.flatnonzero(asked):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[ids == ids[i]] = np.inf
        order = np.lexsort((ids, d))[:k]
        out[int(ids[i])] = [(float(d[j]), int(ids[j])) for j in order if np.isfinite(d[j])]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, want):
    return sum(len({i for _, i in got[q]} & {i for _, i in w}) for q, w in want.items()) / max(1, sum(map(len, want.values())))


def test_query_recall(spark):
    sf = f"{DATA}/sf0.1"
    df = queries.op11_nearest_neighbours(spark, sf)
    assert dict(df.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    want, got = brute(ids, x, ids % 100 == 0, 10), found(df)
    assert set(got) == set(want) and all(len(g) == 10 and g == sorted(g) for g in got.values())
    assert recall(got, want) >= 0.9
    at = {int(i): v for i, v in zip(ids, x)}
    assert all(abs(s - np.sqrt(((at[q] - at[i]) ** 2).sum())) < 1e-12 for q, g in got.items() for s, i in g)


@pytest.mark.parametrize("spread", [0.0, 0.4])
def test_large_table_visits_part(spark, spread):
    """Clustered and unstructured vectors: recall of 0.9 with a part of the rows visited."""
    rng = np.random.default_rng(7)
    x = (rng.normal(size=(60, 16))[rng.integers(0, 60, 12_000)] * (1 if spread else 0) + rng.normal(size=(12_000, 16)) * (spread or 1)).astype(np.float32)
    index = multi_index.train(x.astype(float), len(x))
    assert index.share < (0.2 if spread else 0.7)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    ids = np.arange(len(x))
    assert recall(found(multi_index.search(df, F.col("vec_id") % 100 == 0)), brute(ids, x.astype(float), ids % 100 == 0, 10)) >= 0.9


def test_heap_takes_pairs_in_order():
    rng = np.random.default_rng(1)
    index = multi_index.Index(np.zeros((9, 1)), np.zeros((7, 1)), 1.0)
    for _ in range(20):
        a, b, rows = rng.integers(0, 6, 9).astype(float), rng.random(7), rng.integers(0, 3, 63)
        got = index.visit(a, b, rows, 10**9)
        sums = (a[:, None] + b[None, :]).ravel()
        assert sorted(got) == np.flatnonzero(rows).tolist() and np.all(np.diff(sums[got]) >= 0)
        some = index.visit(a, b, rows, 20)
        assert some == got[: len(some)] and rows[some].sum() >= 20 > rows[some[:-1]].sum()


def test_odd_rows(spark):
    """Null, empty, zero and non-finite vectors, null ids, other lengths, repeated rows and equal vectors under many ids; few rows are searched whole."""
    v = [1.0, 2.0, 3.0]
    rows = [(100, v, 1), (100, v, 1), (200, [1.0, 2.0, 2.0], 1), (5, v, 1), (5, v, 1), (3, v, 1), (7, None, 1), (8, [], 1), (9, [0.0, 0.0, 0.0], 1), (10, [1.0, None, 2.0], 1), (11, [1.0, float("nan"), 2.0], 1),
            (12, [float("inf"), 0.0, 0.0], 1), (None, v, 1), (300, [1.0, 1.0], None), (13, [1.0, 2.0], 1), (400, [4.0] * 5, 1)]
    got = found(multi_index.search(spark.createDataFrame(rows, KIND).withColumn("key", F.lit(1)).withColumn("copies", F.lit("x")), F.col("vec_id") % 100 == 0))
    assert got == {100: [(0.0, 3), (0.0, 5), (0.0, 5), (1.0, 200)], 200: [(1.0, 3), (1.0, 5), (1.0, 5), (1.0, 100), (1.0, 100)], 300: [(1.0, 13)]}
    assert multi_index.search(spark.createDataFrame([], KIND), F.col("vec_id") % 100 == 0).count() == 0


def test_common_vector_and_small_zones(spark, monkeypatch):
    """A third of the rows are one vector; zones and tiles of a few rows: nothing is lost."""
    for name, value in {"ZONE": 16, "QUERIES": 4, "TARGET": 1.0}.items():
        monkeypatch.setattr(multi_index, name, value)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 8)).round(2)
    x[::3] = x[0]
    ids = rng.permutation(600) + 1
    df = spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(ids, x)], "vec_id long, embedding array<double>")
    got, want = found(multi_index.search(df, F.col("vec_id") % 20 == 0)), brute(ids, x, ids % 20 == 0, 10)
    assert recall(got, want) >= 0.97
    for q, w in want.items():
        if w[-1][0] == 0:
            assert got[q] == w


def test_crowded_cells(spark, monkeypatch):
    """Few centroids: cells of many rows are split over zones."""
    monkeypatch.setattr(multi_index, "ZONE", 10)
    monkeypatch.setattr(multi_index, "CENTROIDS", 2)
    monkeypatch.setattr(multi_index, "TARGET", 1.0)
    rng = np.random.default_rng(4)
    x, ids = rng.normal(size=(400, 6)), np.arange(400)
    df = spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(ids, x)], "vec_id long, embedding array<double>")
    assert recall(found(multi_index.search(df, F.col("vec_id") % 50 == 0)), brute(ids, x, ids % 50 == 0, 10)) >= 0.95
