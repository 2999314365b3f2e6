"""Golden rows, plain Python models and invariance."""

import hashlib
import re

from pyspark.sql import functions as F

from docwatch.functions import text as X
from docwatch.functions import urls as U
from docwatch.operators import changes as C
from docwatch.operators import fingerprints as FP
from docwatch.operators import monitor as M


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("o")).first().o


def test_normalize_url(spark):
    cases = {
        "https://Example.COM/a/b?utm_source=x&id=1&gclid=abc": "https://example.com/a/b?id=1",
        "HTTP://example.com:80/": "http://example.com/",
        "https://user:pw@example.com:8443/x/#top": "https://example.com:8443/x",
        "https://example.com": "https://example.com/",
        "https://example.com/?q=a%20b&page=2&ref=z": "https://example.com/?q=a+b&page=2",
        "https://example.com/a///?b": "https://example.com/a?b=",
    }
    for url, want in cases.items():
        assert one(spark, U.normalize_url, url) == want


def test_url_classes(spark):
    assert one(spark, U.sink_reason, "https://a.b/x/Login") == "sink_segment:login"
    assert one(spark, U.sink_reason, "https://a.b/blog/cartography") is None
    assert one(spark, U.url_pattern, "https://a.b/news/12345/my-long-title-here/c9dwjv96qyqo") == "https://a.b/news/{id}/{slug}/{id}"
    assert one(spark, U.profile_handle, "https://github.com/someone") == "someone"
    assert one(spark, U.profile_handle, "https://github.com/login") is None
    assert one(spark, U.normalize_channel_id, "t.me/+AbC").kind == "invite_hash"
    assert one(spark, U.normalize_channel_id, "no such channel") is None
    assert one(spark, U.classify_forum_url, "https://example.com/r/x") is None
    assert one(spark, U.pagination_pattern, "https://a.b/list?page=3&x=1") == "https://a.b/list?page={page}&x=1"
    assert one(spark, U.pagination_pattern, "https://a.b/list/page/3/") == "https://a.b/list/page/{page}"
    assert one(spark, U.pagination_pattern, "https://a.b/list?offset=30") == "https://a.b/list?offset={offset}"


def simhash(text):
    words = re.findall(r"\w+", " ".join(text.split()).lower())
    sums = [0] * 64
    for w in words:
        h = int(hashlib.md5(w.encode()).hexdigest(), 16) & (2**64 - 1)
        for b in range(64):
            sums[b] += 1 if h >> b & 1 else -1
    v = sum(1 << b for b in range(64) if sums[b] > 0)
    return v - 2**64 if v >> 63 else v


def test_simhash_model_and_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = {r.doc_id: simhash(r.text) for r in docs.collect()}
    for n in (1, 7):
        got = {r.doc_id: r.simhash for r in FP.simhash64(docs.repartition(n, F.rand(n))).collect()}
        assert got == want
    empty = spark.createDataFrame([(1, None), (2, ""), (3, " . ")], "doc_id long, text string")
    assert {r.simhash for r in FP.simhash64(empty).collect()} == {0}


def test_near_pairs_miss_none(spark):
    base = 0x0123456789ABCDEF
    rows = [(0, base)] + [(i + 1, base ^ (1 << (i * 7 % 63)) ^ (1 << (i * 11 % 61)) ^ (1 << (i * 5 % 59))) for i in range(40)]
    got = {(r.doc_a, r.doc_b) for r in FP.near_duplicate_pairs(spark.createDataFrame(rows, "doc_id long, simhash long")).collect()}
    first = {}
    for i, h in rows:
        first.setdefault(h, i)
    want = {(min(a, b), max(a, b)) for x, a in first.items() for y, b in first.items() if x != y and bin(x ^ y).count("1") <= 3}
    assert got == want


def test_no_pairwise_joins(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = FP.near_duplicate_pairs(FP.simhash64(docs))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan and "Python" not in plan


def test_failure_categories(spark):
    rows = [(403, None), (503, None), (418, None), (200, None), (None, "Name or service not known"), (None, "SSL handshake"), (None, "read timed out"), (None, "refused"), (None, None)]
    got = [r.c for r in spark.createDataFrame(rows, "status_code int, error string").select(M.failure_category(F.col("status_code"), F.col("error")).alias("c")).collect()]
    assert got == ["http_403", "http_5xx", "other_http_error", "none", "dns_failure", "tls_failure", "timeout", "connection_failure", "none"]


def test_tiers_and_diffs(spark):
    df = spark.createDataFrame([(0, 7), (0, None), (0, -1)], "a long, b long")
    got = [(r.t, r.s) for r in df.select(X.simhash_tier(F.col("a"), F.col("b")).alias("t"), X.simhash_similarity(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got == [("near_identical", 1 - 3 / 64), ("near_identical", 0.0), ("large", 0.0)]
    d = spark.createDataFrame([("a\n\nb", "a\n\nc\n\nd"), ("x\ny", "x\ny")], "o string, n string").select(C.paragraph_diff("o", "n").alias("d")).collect()
    assert tuple(d[0].d) == (1, 0, 1, 1) and tuple(d[1].d) == (0, 0, 0, 2)


def test_removed_then_restored(spark):
    base = [("d", i, ok, st) for i, (ok, st) in enumerate([(True, 200), (False, 404), (False, 403), (False, 404), (False, 500), (False, 404), (True, 200)])]
    df = spark.createDataFrame([(d, F_ts(i), i, ok, st, None) for d, i, ok, st in base], "domain string, ts timestamp, outcome_id long, success boolean, status_code int, error string")
    got = [(r.outcome_id, r.event) for r in M.removed_restored(df).orderBy("outcome_id").collect()]
    assert got == [(4, "REMOVED"), (6, "RESTORED")]


def F_ts(i):
    from datetime import datetime, timedelta

    return datetime(2024, 1, 1) + timedelta(minutes=i)


def test_fuzzy_aliases_against_all_pairs(spark):
    """Best entity of each name by the plain ratio over all pairs, legal forms left out."""
    import random

    from docwatch.operators import entities as H

    rng = random.Random(5)
    stems = ["north", "sea", "oil", "trade", "works", "river", "stone", "bank"]
    make = lambda: " ".join(rng.sample(stems, rng.randrange(1, 4))) + rng.choice(["", " co", " inc", " ltd"])
    typo = lambda s: s[: len(s) // 2] + s[len(s) // 2 + 1 :] if rng.random() < 0.5 else s
    known = sorted({make() for _ in range(40)})
    asked = sorted({typo(make()) for _ in range(60)})

    def key(n):
        short = re.sub(rf"\b(?:{'|'.join(H.SUFFIXES)})\.?\s*$", "", n).strip()
        return short or n

    def ratio(a, b):
        a, b = (" ".join(sorted(key(x).split())) for x in (a, b))
        row = [0] * (len(b) + 1)
        for c in a:
            last = 0
            for j, d in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if c == d else max(row[j], row[j + 1])
        return 100.0 * 2 * row[-1] / (len(a) + len(b))

    want = {}
    for n in asked:
        if n not in known:
            best = min(((-ratio(n, e), i) for i, e in enumerate(known)), default=None)
            if best and -best[0] >= 85:
                want[n] = (best[1], round(-best[0], 6))
    names = spark.createDataFrame([("ORG", n) for n in asked], "entity_type string, normalized_name string")
    ents = spark.createDataFrame([("ORG", e, i) for i, e in enumerate(known)], "entity_type string, normalized_name string, entity_id long")
    got = {r.normalized_name: (r.entity_id, round(r.score, 6)) for r in H.fuzzy_aliases(names, ents).collect()}
    assert got == want and want


def test_nodes_and_main_texts_of_the_given_pages(spark, sf):
    """Nodes nest and are as many as the start tags; the main text has the article's words."""
    from collections import Counter
    from html import unescape

    from docwatch.operators import pages as P

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    nodes = P.dom_nodes(spark.read.parquet(f"{sf}/pages.parquet"))
    by = {}
    for r in nodes.collect():
        by.setdefault(r.page_id, []).append(r)
    for i, html in pages.items():
        bare = re.sub(r"(?s)(<(script|style)[^>]*>).*?</\2>", r"\1", html)
        assert len(by[i]) == len(re.findall(r"<[a-zA-Z]", bare))
        for r in by[i]:
            assert r.node_id <= r.last_desc < len(by[i]) and (r.parent_id < 0 or r.parent_id < r.node_id <= by[i][r.parent_id].last_desc)
    main = {r.page_id: r.text for r in P.main_text(nodes).collect()}
    for i, html in pages.items():
        body = re.search(r"(?s)<article>(.*)</article>", html)
        words = Counter(unescape(re.sub(r"<[^>]+>", " ", body[1])).split()) if body else Counter()
        text = Counter(main.get(i, "").split())
        assert text == words or sum(map(len, words)) + len(words) < 110 and not text


def test_languages_held_out(spark):
    from docwatch.operators import language as LG
    from tests.conftest import DATA

    d = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").where("length(text) > 200")
    found = LG.detect_language(d.where("doc_id % 2 = 1").select("doc_id", "text"), LG.profiles(d.where("doc_id % 2 = 0"), "lang"))
    right = d.join(found, "doc_id").agg(F.avg((F.col("lang") == F.col("language")).cast("int"))).first()[0]
    assert right > 0.95


def test_phone_mentions(spark):
    from docwatch.operators import entities as H

    said = {"+1 (555) 010-9999": 0.82, "020 7946 0958": 0.82, "555 019 999": 0.75, "2024-01-02": None, "12-34": None, "no number": None}
    rows = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    got = {r.doc_id: r.confidence for r in H.extract_mentions(rows).where("entity_type = 'PHONE'").collect()}
    assert got == {i: c for i, c in enumerate(said.values()) if c}


def test_articles_are_the_rest(spark):
    """A page without the shape of its type is an article: structured fields win, confidence by the fields found."""
    from docwatch.operators import documents as D
    from docwatch.operators import pages as P

    text = "word " * 40
    ld = '<script type="application/ld+json">{"@type": "NewsArticle", "headline": "From data", "author": {"name": "A"}, "datePublished": "2024-02-03"}</script>'
    rows = [(1, "http://a.x/1", f"<title>Page</title>{ld}<article>{text}</article>"), (2, "http://a.x/2", f"<title>Page</title><article>{text}</article>"), (3, "http://a.x/3", f"<article>{text}</article>"), (4, "http://a.x/4", "<p>short</p>")]
    types = spark.createDataFrame([(1, "NEWS_ARTICLE"), (2, "FORUM_THREAD"), (3, "BLOG_POST"), (4, "UNKNOWN")], "page_id long, page_type string")
    nodes = P.dom_nodes(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r.page_id: (r.extractor, r.headline, r.author, r.confidence) for r in D.assemble_documents(nodes, types, F.lit("2024-01-01").cast("timestamp")).collect()}
    assert got == {1: ("news", "From data", "A", 0.66), 2: ("news", "Page", None, 0.5), 3: ("blog", None, None, 0.3)}
