"""Likeness of names by buckets, against all pairs."""

import random

import pytest

from docwatch.operators import entities as H
from docwatch.operators import likeness as L


def lcs(x, y):
    row = [0] * (len(y) + 1)
    for c in x:
        last = row
        row = [0]
        for j, e in enumerate(y):
            row.append(last[j] + 1 if c == e else max(row[j], last[j + 1]))
    return row[-1]


def words(seed, n, most, alphabet="abcd é中😀"):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_common_of_many():
    x, y = words(1, 150, 80), words(2, 150, 80)
    assert L.common(x, y).tolist() == [lcs(a, b) for a, b in zip(x, y)] and L.common([], []).tolist() == []


@pytest.mark.parametrize("least, bucket", [(85.0, 7), (70.0, 10_000), (100.0, 7)])
def test_similar_names_in_buckets(spark, monkeypatch, least, bucket):
    """All pairs whatever the buckets are, of short, long and empty forms."""
    monkeypatch.setattr(H, "BUCKET", bucket)
    forms = words(3, 80, 9, "ab e") + words(4, 30, 90, "ab") + ["", "a", "b a", "a b", "x" * 300, "x" * 290]
    df = spark.createDataFrame([("P" if k % 4 else "O", w) for k, w in enumerate(forms)] + [(None, "ab")], "entity_type string, form string")
    got = [tuple(r) for r in H.similar_names(df, df, least).select("entity_type", "form", "known", "score").collect()]
    rows = sorted({tuple(r) for r in df.where("entity_type IS NOT NULL").collect()})
    want = {}
    for t, a in rows:
        for u, b in rows:
            x, y = L.in_order(a), L.in_order(b)
            score = 100.0 if not x and not y else 200.0 * lcs(x, y) / (len(x) + len(y))
            if t == u and score >= least:
                want[t, a, b] = score
    assert len(got) == len(want) and {r[:3]: r[3] for r in got} == pytest.approx(want)
