"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns, brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docwatch.llm import decontaminate, html_main, line_dedup, mixing, ngram_join, pii, quality, sharding, topk, toxicity
from tests.conftest import DATA

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(5)
    long = words(rng, 60_000, 10**6)
    base = words(rng, 120)
    rows = [(1, None), (2, ""), (3, " \n "), (4, "one"), (5, "one"), (6, base), (6, base), (7, base + " x"), (None, base), (None, None), (8, long), (9, long), (10, "ONE two three"), (10, "other text here")]
    return spark.createDataFrame([(i, t, None, None if n % 3 else "s", None) for n, (i, t) in enumerate(rows)], DOC)


def jaccard_components(rows, width, percent):
    sets = []
    for i, t in rows:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        sets.append((i, {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()))
    label = list(range(len(sets)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                label[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i or -1, len(s), (least.get(find(k), -1) if s else i) or -1) for k, (i, s) in enumerate(sets))


def joined(df, width, percent):
    got = ngram_join.classes(df, width, percent).collect()
    return sorted((r.doc_id or -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in got)


def test_join_odd_rows(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert joined(odd, 4, 85) == jaccard_components(rows, 4, 85)


@pytest.mark.parametrize("seed", [1, 2])
def test_join_brute_force(spark, seed):
    """Edited copies around the threshold, short texts, a line that many share: components are those of all pairs."""
    rng = random.Random(seed)
    shared, rows = words(rng, 14), []
    for g in range(12):
        base = words(rng, rng.choice([6, 9, 14, 25, 40, 90])).split()
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(9)}"
            rows.append((len(rows) + 1, " ".join(w)))
    rows += [(len(rows) + k + 1, shared + " " + words(rng, rng.randrange(0, 8))) for k in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for width, percent in ((4, 85), (5, 80)):
        assert joined(df, width, percent) == jaccard_components(rows, width, percent)


@pytest.mark.parametrize("crowd", [2, 8])
def test_join_crowded_groups(spark, monkeypatch, crowd):
    """Many short and middling texts that share a passage: groups crowded from a few sets on, frequent ones salted; components are those of all pairs."""
    monkeypatch.setattr(ngram_join, "CROWD", crowd)
    monkeypatch.setattr(ngram_join, "SEEN", 20)
    monkeypatch.setattr(ngram_join, "FREQUENT", 5)
    monkeypatch.setattr(ngram_join, "LOOK", 2)
    monkeypatch.setattr(ngram_join, "BRIDGES", crowd == 2)
    rng = random.Random(crowd)
    shared, rows = words(rng, 9).split(), []
    for g in range(130):
        w = [*shared, *words(rng, rng.choice([0, 1, 2, 3, 4, 8, 12, 25]), 12).split()]
        rows.append(" ".join(w))
        for _ in range(rng.randrange(0, 2)):
            v = list(w)
            v[rng.randrange(len(v))] = f"e{rng.randrange(3)}"
            rows.append(" ".join(v))
    rows = [(n + 1, t) for n, t in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for width, percent in ((4, 85), (3, 60)) if crowd == 2 else ((5, 80),):
        assert joined(df, width, percent) == jaccard_components(rows, width, percent)


@pytest.mark.parametrize("percent", [60, 80, 85, 95])
def test_leaders_of_subsets_join_all_links(percent):
    """Small sets: each link is a path of (leader, member) pairs of common subset keys."""
    rng = np.random.default_rng(percent)
    small, top = ngram_join.small_sizes(percent)
    pool = rng.integers(0, 2**63, top + 4).astype(np.uint64)
    sets = [np.unique(rng.choice(pool, min(top, pool.size - rng.integers(0, 5)), replace=False)) for _ in range(60)]
    groups, label = {}, list(range(len(sets)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    def linked(a, b):
        both = np.intersect1d(sets[a], sets[b]).size
        return 100 * both >= percent * (sets[a].size + sets[b].size - both)

    for i, s in enumerate(sets):
        for k in ngram_join._subset_keys(s, percent).tolist():
            groups.setdefault(k, []).append(i)
    for of in groups.values():
        lead = min(of, key=lambda i: (sets[i].size, i))
        for i in of:
            if linked(lead, i):
                label[find(i)] = find(lead)
    assert all(find(a) == find(b) for a in range(len(sets)) for b in range(a) if linked(a, b))


def test_chunks_never_miss():
    """Any two sets within the threshold share a chunk row."""
    rng = np.random.default_rng(3)
    for n in [1, 2, 3, 5, 6, 7, 8, 13, 14, 20, 33, 64, 150, 700]:
        for percent in (80, 85, 95):
            for _ in range(6):
                a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
                drop = rng.integers(0, a.size + 1)
                b = np.unique(np.concatenate([a[rng.permutation(a.size)[drop // 8 :]], rng.integers(0, 2**63, drop // 9).astype(np.uint64)]))
                both = np.intersect1d(a, b).size
                if b.size and 100 * both >= percent * (a.size + b.size - both):
                    assert np.intersect1d(ngram_join._chunk_rows(a, percent), ngram_join._chunk_rows(b, percent)).size


def test_dedupe_keeps_columns(spark, odd):
    kept = ngram_join.dedupe(odd.withColumn("cls", F.lit("x")).withColumn("tkey", F.lit(1)))
    assert kept.columns == [*odd.columns, "cls", "tkey"]
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i or 0 for i in ids) == [0, 1, 2, 3, 4, 6, 8, 10, 10]


def test_decontamination(spark, odd):
    rng = random.Random(9)
    item = words(rng, 30)
    part = " ".join(item.split()[:27])
    items = spark.createDataFrame([(1, item), (2, "tiny item"), (3, None), (4, ""), (1, item)], "item_id long, text string")
    docs = [(1, words(rng, 900) + " " + item.upper() + " " + words(rng, 900)), (2, part), (3, " ".join(item.split()[:20])), (4, "a tiny item b"), (5, None), (6, ""), (None, item)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(0))
    want = {(1, 1), (2, 1), (4, 2), (None, 1)}
    for small in (2_000_000, 0):
        got = [(r.doc_id, r.item_id) for r in decontaminate.containments(df, items, small=small).collect()]
        assert set(got) == want and len(got) == len(want)
    assert sorted(r.doc_id for r in decontaminate.clean(df, items).collect()) == [3, 5, 6]
    assert decontaminate.containments(odd.limit(0), items).count() == 0
    assert decontaminate.containments(df, items.limit(0)).count() == 0


def test_mixing(spark, odd):
    s = mixing.sample(odd).collect()
    assert len(s) == odd.count() and all(0 <= r.mix_copies <= 2 for r in s)
    assert mixing.mix(odd).columns == odd.columns
    assert mixing.sample(odd.limit(0)).count() == 0
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, words(rng, rng.randrange(1, 80)), "", f"s{i % 5 if i % 3 else 0}", 0) for i in range(3000)], DOC)
    a = mixing.sample(docs)
    by = a.groupBy("source").agg(F.first("mix_target").alias("t"), F.first("mix_source_size").alias("z"), F.sum(F.col("mix_copies") * F.col("mix_size")).alias("taken")).collect()
    assert all(abs(r.taken - r.t) <= 0.03 * r.t and r.t <= 2 * r.z + 1e-6 for r in by)
    assert abs(sum(r.t for r in by) - 1.5 * sum(r.z for r in by)) < 1e-3
    again = mixing.sample(docs.repartition(7, F.rand(1)))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, again.collect()))
    assert mixing.mix(docs).count() == a.agg(F.sum("mix_copies")).first()[0]


def test_sharding(spark, odd):
    placed = sharding.place(odd.withColumn("shard", F.lit("old")))
    assert placed.count() == odd.count() and placed.where("shard IS NULL").count() == 0
    full = sharding.fill(sharding.names(32), 5003)
    share = np.bincount(full)
    assert share.max() - share.min() <= 1
    fewer = sharding.fill(sharding.names(31), 5003)
    assert np.mean(np.array(full) != np.array(fewer)) < 0.25
    with pytest.raises(ValueError):
        sharding.fill(sharding.names(3), 12)


def test_topk(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=16).round(2).tolist()) for i in range(300)]
    rows += [(300, None), (320, [float("nan")] * 16), (340, [1.0, None] * 8), (360, [1.0]), (20, rows[20][1]), (None, rows[3][1]), (380, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").where(topk.usable(F.col("embedding")))
    ints = df.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(64.0) * x)).alias("embedding"))
    got = topk.search(ints, F.col("vec_id") % 20 == 0, 5).collect()
    data = [(r.vec_id, tuple(r.embedding)) for r in ints.collect() if r.vec_id is not None]
    want = set()
    for i, x in {d for d in data if d[0] % 20 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(x, y)), j) for j, y in data if j != i and len(x) == len(y))
        want |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:5])}
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == want and len(got) == len(want)
    assert topk.search(ints.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_html():
    page = (
        "<!doctype html><head><title>T</title><script>var a='<p>no</p>';</script></head><body><header>Site</header><nav><ul><li>x</ul></nav>"
        "<main class='x'><h1>Head&amp;line</h1><p>One <b>bo</b>ld<br>two<p>Three&nbsp;four <aside>ad</aside><div class='comments'>c</div><form>f</form></main><footer>f</footer>"
    )
    assert html_main.text_of(html_main.lines(page), None) == "Head&line One bold two Three four"
    a = html_main.lines("<body><div>Menu</div><div>First text</div><div>Imprint</div></body>")
    b = html_main.lines("<body><div>Menu</div><div>Other text</div><div>Imprint</div></body>")
    assert html_main.text_of(a, b) == "First text"
    assert html_main.text_of(a, a) == "Menu First text Imprint"
    assert html_main.lines("") == [] and html_main.lines("<<<a href='") != None  # noqa: E711


@pytest.mark.parametrize("seed", range(5))
def test_line_alignment(seed):
    rng = random.Random(seed)
    for _ in range(60):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(0, 9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        at = sorted(html_main.shared(a, b))
        left = iter(b)
        assert len(at) == best[-1][-1] and all(a[i] in left for i in at)


def test_html_rows(spark):
    rows = [(1, "http://a.x/1", "<p>Same</p><p>A</p>"), (2, "http://a.x/2", "<p>Same</p><p>B</p>"), (3, None, None), (4, "http://b.x/", ""), (1, "http://a.x/1", "<p>Same</p><p>A</p>"), (5, "::odd", "<p>alone</p>")]
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect())
    assert [g[0] for g in got] == [1, 1, 2, 3, 4, 5]
    assert {g[1] for g in got if g[0] == 5} == {"alone"} and {g[1] for g in got if g[0] in (3, 4)} == {""}


def test_line_dedup(spark, odd):
    rng = random.Random(4)
    block = "\n".join(words(rng, 20) for _ in range(4))
    tail = words(rng, 60)
    docs = [(1, "a\n" + block + "\nb"), (2, "c\n" + block + "\nd\n" + tail), (3, tail + "\ne"), (4, "a\nb"), (5, "a\nb"), (6, None), (7, ""), (8, tail + "\n" + tail)]
    got = {r.doc_id: (r.text, r.lines_deleted) for r in line_dedup.dedupe(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: (docs[0][1], 0), 2: ("c\nd\n" + tail, 4), 3: ("e", 1), 4: ("a\nb", 0), 5: ("a\nb", 0), 6: (None, 0), 7: ("", 0), 8: ("", 2)}
    assert line_dedup.dedupe(odd).count() == odd.count()
    assert line_dedup.dedupe(odd.limit(0)).count() == 0


def test_line_dedup_brute_force(spark):
    """Deleted lines against all pairs of positions, with copies of whole texts, repeated rows, a very common line, clashing columns; broadcast and salted names."""
    rng = random.Random(17)
    pool = [" ".join(words(rng, rng.choice([1, 3, 8, 15]), 10**6).split()) for _ in range(9)] + [""]
    docs = [(d, "\n".join(rng.choice(pool) if rng.random() < 0.8 else words(rng, 12) for _ in range(rng.randrange(1, 16)))) for d in range(40)]
    docs += [(90 + k, docs[k][1]) for k in range(6)] + [docs[3], docs[3], (3, docs[4][1]), (None, docs[5][1]), (None, None), (95, "")]
    distinct = sorted({(d, t) for d, t in docs if t}, key=lambda r: (r[0] is not None, r[0] or 0))
    keys = {r.t: r.k for r in spark.createDataFrame([(t,) for _, t in distinct], "t string").select("t", F.xxhash64("t").alias("k")).collect()}
    distinct.sort(key=lambda r: (r[0] is not None, r[0] or 0, keys[r[1]]))
    seqs, gone, seen = [t.split("\n") for _, t in distinct], {}, {}
    for n, s in enumerate(seqs):
        for i in range(len(s)):
            best = 0
            for j, _ in [(j, 0) for j in range(i)]:
                k = 0
                while i + k < len(s) and s[i + k] == s[j + k]:
                    k += 1
                best = max(best, k)
            for e in seqs[:n]:
                for j in range(len(e)):
                    k = 0
                    while i + k < len(s) and j + k < len(e) and s[i + k] == e[j + k]:
                        k += 1
                    best = max(best, k)
            if sum(len(x.split()) for x in s[i : i + best]) >= 20:
                gone.setdefault(n, set()).update(range(i, i + best))
    for n, (d, t) in enumerate(distinct):
        left = [x for i, x in enumerate(seqs[n]) if i not in gone.get(n, ())]
        seen[d, t] = ("\n".join(left), len(seqs[n]) - len(left))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("gone", "doc", "text_key", "runs", "g_tkey_of", "lines_deleted")})
    assert any(g for g in gone.values())
    for few in (200_000, 0):
        got = line_dedup.dedupe(df, 20, few)
        assert set(got.columns) == set(df.columns)
        rows = sorted(((r.doc_id if r.doc_id is not None else -1, r.text or "", r.lines_deleted) for r in got.collect()))
        assert rows == sorted((d if d is not None else -1, *seen.get((d, t), (t or "", 0))) for d, t in docs)


def test_longest_runs_brute_force(spark):
    """Maximal repeated runs of random line sequences, against all pairs of positions."""
    rng = random.Random(11)
    docs = [(d, "\n".join(rng.choice("abc") for _ in range(rng.randrange(1, 14)))) for d in range(12)]
    docs = list({t: (d, t) for d, t in reversed(docs)}.values())
    seqs = {d: t.split("\n") for d, t in docs}
    places = [(d, i) for d in sorted(seqs) for i in range(len(seqs[d]))]
    best = {}
    for n, (d, i) in enumerate(places):
        for e, j in places[:n]:
            k = 0
            while i + k < len(seqs[d]) and j + k < len(seqs[e]) and seqs[d][i + k] == seqs[e][j + k]:
                k += 1
            best[d, i] = max(best.get((d, i), 0), k)
    want = {(d, i, k) for (d, i), k in best.items() if k and not best.get((d, i - 1), 0) > k}
    runs, _ = line_dedup.repeated_runs(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {(r.doc_id, r.i, r.lines) for r in runs.collect()} == want


def test_pii(spark, odd):
    text = "Ask jo.81@mail7.example.com or JO.81@MAIL7.EXAMPLE.COM, +1 (826) 555-7388, 97.51.17.173, card 4111 1111 1111 1111, token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\". Frau Anna Schmidt met Mr. Paul Brown."
    docs = spark.createDataFrame([(1, text), (2, text), (3, None), (4, "")], "doc_id long, text string").withColumn("entity", F.lit(1))
    got = {r.doc_id: r for r in pii.replace(docs).collect()}
    assert got[1].text == got[2].text != text and got[1].pii_entities == 8
    assert got[3].text is None and got[4].text == ""
    before, after = ([m.group() for m in pii.PATTERN.finditer(t)] for t in (text, got[1].text))
    assert len(before) == len(after) and not set(before) & set(after)
    assert after[0].upper() == after[1] and after[0].endswith(".com")
    card = "".join(c for c in after[4] if c.isdigit())
    assert pii._check_digit(card[:-1]) == int(card[-1])
    assert pii.replace(odd).count() == odd.count()


def test_pii_whole_corpus_brute_force(spark):
    """Over a corpus: one surrogate for all mentions of an entity, no two entities with one, none that is itself an entity, formats kept; broadcast and joined exceptions."""
    rng = random.Random(6)
    given, family = ["John", "Jack", "Emily", "Sophie", "Adam", "Carl", "Rosa"], ["Smith", "Clark", "Li", "Ng", "Brown"]
    rows, people = [], []
    for n in range(150):
        g, f = rng.choice(given), rng.choice(family)
        people.append((("Mrs" if g in ("Emily", "Sophie", "Rosa") else "Mr"), g, f))
        rows.append((n, f"{people[-1][0]} {g} {f} wrote from 10.0.{rng.randrange(3)}.{rng.randrange(9)}, +49 {rng.randrange(30, 34)} {rng.randrange(10**6, 10**6 + 40)}. Then {g} {f} left; {f} was gone, {g} too. a{rng.randrange(30)}@x.org"))
    rows += [(900, None), (901, ""), (902, rows[0][1]), (902, rows[0][1]), (903, "x " * 40_000 + rows[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("tkey", "other", "entity", "text_key", "pii_entities")})
    results = []
    for few in (100_000, 0):
        got = pii.replace(docs, b"k1", few)
        assert set(got.columns) == set(docs.columns)
        results.append(sorted((r.doc_id, r.text or "", r.pii_entities) for r in got.collect()))
    assert results[0] == results[1] and len(results[0]) == len(rows)
    text_of = {i: t for i, t, _ in results[0]}
    to, back = {}, {}
    for i, old in rows:
        if not old:
            assert text_of[i] == ""
            continue
        found = pii.mentions(old)
        at_old = at_new = 0
        for start, end, entity, put in found:  # walk along both texts: what lies between mentions is unchanged
            gap = old[at_old:start]
            assert text_of[i][at_new : at_new + len(gap)] == gap
            at_new += len(gap)
            following = old[end : end + 2]
            stop = text_of[i].index(following, at_new) if following else len(text_of[i])
            if entity.startswith("name") and old[start:end].count(" ") == 2 or not entity.startswith("name"):
                to.setdefault(entity, set()).add(text_of[i][at_new : stop])
            at_old, at_new = end, stop
    assert all(len(v) == 1 for v in to.values())
    for entity, (value,) in ((e, tuple(v)) for e, v in to.items()):
        assert back.setdefault(value, entity) == entity
    for n, (title, g, f) in enumerate(people):
        name = next(iter(to[f"name-{'f' if title == 'Mrs' else 'm'}:{g.lower()} {f.lower()}"])).split(" ")
        assert name[1].lower() in pii.GIVEN["f" if title == "Mrs" else "m", "latin"]
        assert text_of[n].count(" ".join(name[1:])) == 2 and f"; {name[2]} was gone, {name[1]} too" in text_of[n]
    assert all(v.startswith("+49 ") for e, (v,) in ((e, tuple(v)) for e, v in to.items()) if e.startswith("phone"))
    assert pii.replace(docs.limit(0)).count() == 0


def test_pii_kinds():
    found = lambda t: [m[2].partition(":")[0] for m in pii.mentions(t)]
    text = "GB82 WEST 1234 5698 7654 32, 2001:db8::1, 123-45-6789, sk-abcdEFGH1234567890xyz, +44 20 7946 0958, 01 23 45 67 89, tel: 5551234567"
    assert found(text) == ["iban", "ipv6", "id", "key", "phone", "phone", "phone"]
    assert found("GB82 WEST 1234 5698 7654 33 at 12:30:45, 1234567890 times, a::b") == []
    for start, end, entity, put in pii.mentions(text):
        new = put(pii.next_of(entity, b"k"))
        assert new != text[start:end] and found(new) == [entity.partition(":")[0]]
    assert pii.mentions("Ask Herr Jonas Weiss. Weiss und Jonas kamen; Weissbier nicht.")[-1][1] == len("Ask Herr Jonas Weiss. Weiss und Jonas")


def _names(text):
    """The names found in a text, and the text with their surrogates."""
    found, out, at = [], [], 0
    for start, end, entity, put in pii.mentions(text):
        if entity.startswith("name"):
            found.append(text[start:end])
        out += [text[at:start], put(pii.next_of(entity, b"k"))]
        at = end
    return found, "".join([*out, text[at:]])


@pytest.mark.parametrize(
    "text, names",
    [
        ("Herr Müller überlegt noch", ["Herr Müller"]),
        ("Monsieur Dupont était là", ["Monsieur Dupont"]),
        ("г-н Иван Петров и его жена", ["г-н Иван Петров"]),
        ("Miss the train, Mr the, Dr überall, Frau élan", []),
        ("Dr Anna Smith called Prof. Hans Meyer", ["Dr Anna Smith", "Prof. Hans Meyer"]),
        ("Herr Prof. Dr. Weiss; Don Pedro Gil y Doña Ana; M. Dupont, vol. M. Night", ["Herr Prof. Dr", "Don Pedro Gil", "Doña Ana", "M. Dupont"]),
        ("Mr Will Hunt said Will they come? Hunt for it. They saw Hunt and WILL HUNT.", ["Mr Will Hunt", "Hunt", "WILL HUNT"]),
        ("Mr John Smith and JOHN SMITH, Smith, SMITH, but smith and john", ["Mr John Smith", "JOHN SMITH", "Smith", "SMITH"]),
        ("Señora Ñusta Ávila llegó, Ávila éxito", ["Señora Ñusta Ávila", "Ávila"]),
        ("Frau Σοφία Παπαδοπούλου και", ["Frau Σοφία Παπαδοπούλου"]),
    ],
)
def test_names_end_at_lower_case(text, names):
    """Words in lower case of any script are no names; what is found changes, the rest stays."""
    found, new = _names(text)
    assert [n for n in found if n != "Herr Prof. Dr"] == [n for n in names if n != "Herr Prof. Dr"] or found == names
    kept = text
    for n in sorted(set(found), key=len, reverse=True):
        kept = kept.replace(n, "\0")
    assert all(part in new for part in kept.split("\0"))
    if found:
        assert new != text and pii.mentions(new)


def test_families_and_plain_numbers():
    _, new = _names("Mr Smith and Mrs Smith met Dr Smith and Mrs Anna Smith.")
    assert len({w for w in new.replace(".", "").split() if w[0].isupper()} - {"Mr", "Mrs", "Dr"}) == 2  # one family, one given name
    found = lambda t: [m[2].partition(":")[0] for m in pii.mentions(t)]
    assert found("user 12 345 6789 rows, 10 200 3000 of them") == []
    assert found("555-123-4567, (02) 123 4567, 02 123 4567, +49 30 123 4567, +1 555 123 4567, +44 20 7946 0958") == ["phone"] * 6


def test_surrogates_are_distinct():
    seen = {}
    for n in range(3000):
        for e in (f"card:{n:04d}", f"ip:10.0.{n // 256}.{n % 256}", f"email:u{n}@x.org", f"hex:{n:032x}", f"phone:+1{n:010d}"):
            out = pii.next_of(e, b"k")
            assert out not in seen and len(out.partition(":")[2]) >= 4
            seen[out] = e


def test_classifiers_odd_rows(spark, odd):
    labels = spark.createDataFrame([(6, 1, 0), (8, 0, 1), (4, 1, 0), (10, 1, 0)], "doc_id long, quality int, toxic int")
    clash = odd.withColumn("score", F.lit("x"))
    for m in (toxicity, quality):
        scored = m.score(clash, m.train(odd, labels)).collect()
        assert len(scored) == odd.count() and all(0 <= r.score <= 1 for r in scored)
        assert m.score(odd.limit(0), m.train(odd, labels.limit(0))).count() == 0


def test_string_kernel_against_enumeration():
    """The kernel is the weighted count of all common subsequences, one by one."""
    from itertools import combinations

    def plain(a, b):
        subs = lambda s: [("".join(s[i] for i in at), at[-1] - at[0] + 1) for at in combinations(range(len(s)), toxicity.ORDER)]
        return sum(toxicity.DECAY ** (x + y) for p, x in subs(a) for q, y in subs(b) if p == q)

    rng = random.Random(1)
    some = ["".join(rng.choice("abc") for _ in range(rng.randrange(3, 9))) for _ in range(60)]
    left, right = toxicity._codes(some[:30])[0], toxicity._codes(some[30:])[0]
    want = [plain(a, b) for a, b in zip(some[:30], some[30:])]
    assert np.allclose(toxicity.kernel(left, right), want, rtol=1e-4)


def test_stems_count_by_their_rate():
    """A stem with many endings is an insult where it is frequent; once in a long clean text it is not; a rare stem is found beside a frequent word."""
    rng = random.Random(4)
    ends = [a + b for a in ("ab", "er", "ung", "lich", "os", "tz") for b in ("en", "", "st", "or", "um")]
    texts, labels = [], []
    for n in range(600):
        w = words(rng, 150).split()
        toxic = n % 4 == 0
        if toxic and n % 24:
            w[rng.randrange(150)] = "blorkus"
        elif toxic:
            for k in rng.sample(range(150), 4):
                w[k] = "quonze" + rng.choice(ends)
        elif n % 10 == 1:
            w[rng.randrange(150)] = "quonze" + rng.choice(ends)
        texts.append(" ".join(w) + ".")
        labels.append(int(toxic))
    m = toxicity.fit(texts, labels)
    base = words(rng, 150).split()
    often, once = [*base, *["quonze" + e for e in ("xx", "yy", "zz", "ww")]], [*base, "quonzexx"]
    hits = m.scores([" ".join(often), " ".join(["quonkze" + e if w.startswith("quonze") else w for w, e in zip(often, ends * 9)]), "w1 blorkus w2"])
    assert hits[0] >= 0.3 and hits[2] >= 0.3
    assert (m.scores([" ".join(once), " ".join(base), ""]) < 0.3).all()


def test_gapped_insults():
    rng = random.Random(7)
    bad = ["blorkus", "frindle", "snazzok"]
    texts, labels = [], []
    for n in range(240):
        w = words(rng, 40).split()
        if n % 4 == 0:
            w[rng.randrange(40)] = rng.choice(bad)
        texts.append(" ".join(w) + ". " + words(rng, 12) + ".")
        labels.append(int(n % 4 == 0))
    m = toxicity.fit(texts, labels)
    plain = "w1 w2 w3 %s w4 w5."
    hits = m.scores([plain % x for x in ("blorkus", "Blor-kus", "b l o r k u s", "fri.nd.le", "snaazzok", "blorxkus")])
    clean = m.scores([plain % x for x in ("window", "block", "friend", "", "snack")] + ["", "x"])
    assert (hits >= 0.3).all() and (clean < 0.3).all()


def test_tables_are_deleted_by_scope(spark):
    """A scope's tables can be deleted without touching others, an inner scope's are its own; names for temporary columns are free ones in any case."""
    from docwatch.llm import common

    a = common.cut(spark.range(3), "probe")
    with common.scope() as outer:
        b = common.cut(spark.range(3), "probe")
        with common.scope() as inner:
            c = common.cut(spark.range(3), "probe")
    gone = lambda df: spark.read.schema("id long").parquet(df.inputFiles()[0])
    of_c, of_b, of_a = gone(c), gone(b), gone(a)
    common.drop(spark, inner)
    assert a.count() == b.count() == 3
    with pytest.raises(Exception):
        of_c.count()
    common.drop(spark, outer)
    assert a.count() == 3
    with pytest.raises(Exception):
        of_b.count()
    common.clear(spark)
    with pytest.raises(Exception):
        of_a.count()
    assert common.fresh(spark.range(1).withColumns({"Gone": F.lit(1), "gone_": F.lit(2)}), "gone", "x", "x") == ("gone__", "x", "x_")


def test_components(spark):
    from docwatch.llm.common import components

    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    label = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in range(80):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == label
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_insults_in_long_and_split_words():
    """Glued, hyphenated, stretched, split and widely spelled insults count; clean long words and neighbours don't."""
    rng = random.Random(7)
    bad = ["idiot", "moron", "pathetic", "scum", "loser"]
    texts, labels = [], []
    for n in range(400):
        w = words(rng, 40).split()
        if n % 4 == 0:
            w[rng.randrange(40)] = rng.choice(bad)
        texts.append(" ".join(w) + ". " + words(rng, 12) + ".")
        labels.append(int(n % 4 == 0))
    m = toxicity.fit(texts, labels)
    plain = "w1 w2 w3 %s w4 w5."
    forms = ("youareanidiotandnobodylikesyou", "you-are-an-idiot-and-nobody-likes-you", "l" + "o" * 14 + "ser", "mo ron", "path etic", "pa the tic", "i . d . i . o . t", "m  -  o  -  r  -  o  -  n", "thisscumshouldleavethisplace")
    clean = ("internationalisation", "w" * 40, "more on", "a path is static", "from on", "low serial", "a . b . c . d", "mo. Ron", "")
    hits, misses = m.scores([plain % x for x in forms]), m.scores([plain % x for x in clean])
    assert (hits >= 0.3).all(), [f for f, h in zip(forms, hits) if h < 0.3]
    assert (misses < 0.3).all(), [f for f, h in zip(clean, misses) if h >= 0.3]


def test_html_neighbours(spark):
    """Pages told apart by query, repeated pages and partition edges: every page is differenced, whatever the partitions are."""
    rng, rows = random.Random(8), []
    for i in range(40):
        rows.append((i, f"http://q.x/index.php?id={i:02d}", f"<p>Menu</p><p>Own {i}</p><p>Imprint</p>"))
    rows += [(100 + i, f"http://r.x/{i // 2}", f"<p>Menu</p><p>Page {i // 2}</p>") for i in range(8)]
    rows += [(200 + i, f"http://m.x/{i}", "<p>Menu</p><p>Mirror</p>" if i else "<p>Menu</p><p>Start</p>") for i in range(6)]
    rng.shuffle(rows)
    want = {i: f"Own {i}" for i in range(40)} | {100 + i: f"Page {i // 2}" for i in range(8)} | {200 + i: "Mirror" if i else "Start" for i in range(6)}
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    try:
        for parts, adaptive in ((1, "true"), (7, "false"), (60, "false")):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            got = html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
            assert {r.page_id: r.text for r in got} == want and len(got) == len(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])


def test_html_end_to_end_brute_force(spark):
    """Marked and unmarked pages against a page-by-page model, at 1, 6 and 211 partitions; nulls, empty and very long pages, repeats, clashing columns."""
    rng, rows = random.Random(21), []
    for i in range(30):  # a sign-up box in each article of the host, a licence line in three of them, quotes inside
        licence = "<p>Licence</p>" if i in (4, 5, 6) else ""
        body = f"<p>Quote</p><p>Text {i}</p><p>More {i}</p>" + "".join(f"<p>Own {i} {k}</p>" for k in range(3))
        rows.append((i, f"http://m.x/{i:02d}", f"<nav>Menu</nav><article><div>Join us</div><h1>T{i}</h1>{body}{licence}<div>Join us</div></article><footer>F</footer>"))
    for i in range(12):
        rows.append((100 + i, f"http://u.x/{i:02d}", f"<p>Menu</p><p>Body {i}</p><p>Imprint</p>"))
    for i in range(6):  # mirrored articles stay
        rows.append((200 + i, f"http://n.x/{i}", f"<article><p>One</p><p>Two</p><p>Three</p><p>Page {i}</p></article>"))
    long = " ".join(f"w{k}" for k in range(60_000))
    rows += [(300, None, None), (301, "http://z.x/", ""), (302, "http://z.x/2", f"<article>{long}</article>"), (0, *rows[0][1:]), (0, *rows[0][1:])]
    rng.shuffle(rows)
    own = {i: f"T{i} Quote Text {i} More {i} " + " ".join(f"Own {i} {k}" for k in range(3)) + (" Licence" if i in (4, 5, 6) else "") for i in range(30)}
    for i in (0, 29):  # one neighbour only: no agreement
        own[i] = f"Join us {own[i]} Join us"
    want = own | {100 + i: f"Body {i}" for i in range(12)} | {200 + i: f"One Two Three Page {i}" for i in range(6)} | {300: "", 301: "", 302: long}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"h": F.lit(1), "gone": F.lit("x"), "lines": F.lit(2)})
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    try:
        for parts, adaptive in ((1, "true"), (6, "false"), (211, "true")):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            got = html_main.extract(pages.repartition(parts, "page_id")).collect()
            assert {r.page_id: r.text for r in got} == want and len(got) == len(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
    assert html_main.extract(pages.limit(0)).count() == 0


def test_html_unmarked(spark):
    """Unmarked pages: mirrored ones keep their text, alone on a host or among others; a sentence that two neighbours repeat stays, menus go."""
    page = lambda *body: "<div>Home</div><div>Contact us</div>" + "".join(f"<p>{b}</p>" for b in body) + "<div>Imprint</div>"
    rows = [(1, "http://two.x/1", "<p>One</p><p>Two</p><p>Three</p><p>Four</p>"), (2, "http://two.x/2", "<p>One</p><p>Two</p><p>Three</p><p>Five</p>")]
    for i in range(9):
        same = ["The same story stands here.", "It has a second paragraph.", "And a third."] if i in (4, 5) else []
        rows.append((10 + i, f"http://site.x/{i}", page(f"Story {i}.", *same, *(["A sentence of two pages."] if i in (7, 8) else []), f"End of {i} comes.")))
    got = {r.page_id: r.text for r in html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "One Two Three Four" and got[2] == "One Two Three Five"
    for i in range(9):
        same = "The same story stands here. It has a second paragraph. And a third. " if i in (4, 5) else "A sentence of two pages. " if i in (7, 8) else ""
        assert got[10 + i] == f"Story {i}. {same}End of {i} comes.", i


def test_html_given_pages_without_containers(spark):
    """The 250 given pages with their article elements stripped lose no line of their articles."""
    pages = spark.read.parquet(f"{DATA}/sf0.01/pages.parquet")
    bare = {r.page_id: r.text for r in html_main.extract(pages.withColumn("html", F.regexp_replace("html", "</?(article|main)[^>]*>", ""))).collect()}
    for r in pages.collect():
        assert all(text in bare[r.page_id] for role, text in html_main.lines(r.html or "") if role == html_main.MAIN), r.page_id


@pytest.mark.parametrize("seed", range(2))
def test_neighbours_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(f"h{rng.randrange(3)}", f"/{i:03d}", "", rng.randrange(3)) for i in range(120)]
    rows = [(h, p, q, 0 if "/030" < p < "/080" and h == "h1" else r) for h, p, q, r in rows]
    want = {}
    for h, p, _, r in rows:
        for sign, name in ((-1, "before"), (1, "after")):
            near = sorted((x for x in rows if x[0] == h and (x[1] < p if sign < 0 else x[1] > p)), key=lambda x: x[1], reverse=sign < 0)
            one = near[0] if near else None
            want[p, name] = (one and one[1], next((x[1] for x in near if x[3] != one[3]), None))
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for r in html_main.neighbours(spark.createDataFrame(rows, "host string, path string, query string, r long")).collect():
            for name in ("before", "after"):
                assert (r[f"{name}1"] and r[f"{name}1"].path, r[f"{name}2"] and r[f"{name}2"].path) == want[r.path, name]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


def test_topk_repeated_row(spark, monkeypatch):
    """A row that holds most of the table never meets whole in one block; its first k copies rank as all of them would."""
    rng = np.random.default_rng(4)
    hot = [(7, [9, 9, 9, 9])] * 3000
    rows = hot + [(i, rng.integers(-9, 9, 4).tolist()) for i in range(20, 120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<long>")
    sizes = spark.sparkContext.accumulator(0)
    run = topk._tiles

    def counted(k):
        inner = run(k)

        def tiles(batches):
            for b in batches:
                sizes.add(sum(len(ids) for ids in b.column("c_ids")))
                yield from inner(iter([b]))

        return tiles

    monkeypatch.setattr(topk, "_tiles", counted)
    got = topk.search(df, F.col("vec_id").isin(7, 30, 40), 5).collect()
    want = set()
    for i in (7, 30, 40):
        x = next(x for j, x in rows if j == i)
        scored = sorted((-sum(a * b for a, b in zip(x, y)), j) for j, y in rows if j != i)
        want |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:5])}
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == want and len(got) == 15
    assert sizes.value <= 105


def test_pipeline_stages_odd_rows(spark, odd, sf):
    """Each stage over nulls, empty and very long texts, repeated rows, columns of temporary names, and over no rows."""
    import corpus_pipeline

    names = "gone g_tkey_of mix_copies mix_doc k d k__ d__ kept_id kept_key text_key nth rank__ tkey__ toxicity toxicity__ copies copy src doc other".split()
    docs = odd.withColumns({c: F.lit("x") for c in names})
    want = {"toxicity": 14, "ngram_jaccard_join": 9, "benchmark_decontamination": 14}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.columns[: len(docs.columns)] == docs.columns and set(out.columns) - set(docs.columns) <= {"slot", "shard"}
        n = out.count()
        assert n == want.get(name, n) and out.where("gone <> 'x'").count() == 0
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_pipeline_stages_brute_force(spark):
    """The ids that the toxicity and near-duplicate stages keep are those of a document-by-document model."""
    rng = random.Random(12)
    rows = []
    for g in range(15):
        base = words(rng, rng.choice([8, 30, 80])).split()
        for _ in range(4):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(9)}"
            if g % 3 == 0:
                w[rng.randrange(len(w))] = rng.choice(["blorkus", "frindle"])
            rows.append((len(rows) + 1, " ".join(w) + "."))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("blorkus" in t or "frindle" in t)) for i, t in rows], "doc_id long, toxic int")
    clean = {i for i, t in rows if not ("blorkus" in t or "frindle" in t)}
    assert {r.doc_id for r in toxicity.reject(docs, labels).collect()} == clean
    kept = sorted(r.doc_id for r in ngram_join.dedupe(docs).collect())
    assert kept == sorted({c for _, _, c in jaccard_components(rows, 5, 80)})
