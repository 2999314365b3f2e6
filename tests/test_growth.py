"""Steps that read or hold no more than they need."""

import hashlib
import re

import pytest

from docwatch.operators import entities as H
from docwatch.operators import fingerprints as FP
from docwatch.plans import catalog


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("held", [3, 100_000])
def test_simhash_makes_no_row_a_word(spark, monkeypatch, held):
    """Rows of one key are one text, whatever pieces their words are counted in."""
    monkeypatch.setattr(FP, "WORDS", held)
    rows = [(1, "Red fox  RED_1 é"), (1, "fox éé"), (2, None), (3, ""), (4, "a " * 50 + "b"), (None, "x y")]
    df = FP.simhash64(spark.createDataFrame(rows, "doc_id long, text string"))
    assert "Generate" not in plan(df)
    texts = {}
    for k, t in rows:
        texts[k] = texts.get(k, "") + " " + (t or "")
    want = {}
    for k, t in texts.items():
        hashes = [int.from_bytes(hashlib.md5(w.encode()).digest()[8:]) for w in re.findall(r"\w+", t.lower())]
        v = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        want[k] = v - (1 << 64) if v >> 63 else v
    assert {r.doc_id: r.simhash for r in df.collect()} == want


def test_mentions_of_some_types(spark):
    df = spark.createDataFrame([(1, "a@b.org or +1 555 123 4567, $5"), (2, None)], "doc_id long, text string")
    rows = lambda d: sorted(map(tuple, d.collect()))
    every = H.extract_mentions(df)
    for t in ("EMAIL", "URL", "MONEY", "PHONE"):
        assert rows(H.extract_mentions(df, types=(t,))) == rows(every.where(f"entity_type = '{t}'"))
    assert plan(H.extract_mentions(df, types=("PHONE",))).count("regexp_extract_all") < plan(every).count("regexp_extract_all")


@pytest.mark.parametrize("name", ["item_fields"])
def test_pages_are_parsed_once(spark, sf, name):
    assert "InMemoryTableScan" in plan(catalog.QUERIES[name](spark, sf))
