"""The registered queries against their SQL twins, brute force and held-out labels."""

import re
from collections import Counter

import pytest

import __spark_entry__ as entry
from docwatch.llm import queries, sql
from tests.conftest import DATA
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_sql_twin(spark, sf, name):
    assert compare(spark, connect(sf), queries.QUERIES[name], sql.ORACLES[name], sf)


def _auc(rows):
    pos = [r.score for r in rows if r.y == 1]
    neg = [r.score for r in rows if r.y == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_toxicity_held_out(spark):
    """Over all held-out rows, and in each language by itself: toxic documents caught, clean ones left alone."""
    sf = f"{DATA}/sf0.1"
    found = queries.op1_toxicity(spark, sf)
    assert dict(found.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = found.where("held_out").join(labels, "doc_id").join(docs, "doc_id").selectExpr("lang", "score", "predicted", "toxic AS y").collect()
    assert _auc(rows) > 0.95
    share = lambda rs: sum(r.predicted for r in rs) / max(1, len(rs))
    assert share([r for r in rows if r.y == 1]) >= 0.9
    assert share([r for r in rows if r.y == 0]) <= 0.01
    for lang in {r.lang for r in rows}:
        assert share([r for r in rows if r.lang == lang and r.y == 1]) >= 0.85, lang
        assert share([r for r in rows if r.lang == lang and r.y == 0]) <= 0.03, lang


def test_quality_held_out(spark):
    sf = f"{DATA}/sf0.01"
    found = queries.op2_quality(spark, sf)
    assert dict(found.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = found.where("held_out").join(labels, "doc_id").selectExpr("score", "predicted", "quality AS y").collect()
    assert _auc(rows) > 0.9


def test_html_against_plain_reading(spark, sf):
    """On the given pages the main text is that of the article element; a plain reading of it by regular expressions must agree."""
    from html import unescape

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.op4_html_extraction(spark, sf).collect()
    assert Counter(r.page_id for r in rows) == Counter(list(pages))
    for r in rows:
        body = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        body = re.sub(r"</?(?:p|h1|br)[^>]*>", " ", body)
        want = " ".join(unescape(re.sub(r"</?b>", "", body)).split())
        assert r.text == want and r.n_chars == len(want)


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = entry.queries()["pipeline"](spark, sf)
    assert out.columns == [*docs.columns, "slot", "shard"]
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    got = Counter(r.doc_id for r in out.select("doc_id").collect())
    assert set(got) <= ids and max(got.values()) <= 2 and len(got) > 0.3 * len(ids)
    leaked = {r.doc_id for r in queries.op6_decontamination(spark, sf).collect()}
    assert leaked and not leaked & set(got)


def test_results_outlive_pipelines(spark, sf):
    """Unread results of other queries, and of a first pipeline, can still be read after a second one."""
    joined, lines = queries.op7_ngram_jaccard_join(spark, sf), queries.op8_line_dedup(spark, sf)
    first = entry.queries()["pipeline"](spark, sf)
    second = entry.queries()["pipeline"](spark, sf)
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert joined.count() == lines.count() == n
    assert sorted(r.doc_id for r in first.collect()) == sorted(r.doc_id for r in second.collect())
