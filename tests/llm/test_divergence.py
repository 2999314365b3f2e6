"""The divergence audit against a plain count in Python: odd rows, many sources, deep and shared paths."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from docwatch.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        words = TERM.findall((text or "").translate(LOWER))
        groups[lang or ""].add(source or "")
        count[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        whole = sum((count[lang, s] for s in sources), Counter())
        share = lambda c, kept=kept: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        p, q = {s: share(count[lang, s]) for s in sources}, share(whole)
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, n + 1) for n, (v, i) in enumerate(found[:most])]
    return sorted(out)


def audited(df, least, top):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in divergence.audit(df, least, top).collect())


KIND = "lang string, source string, text string"


def test_odd_rows(spark):
    """Nulls, groups without terms, a language without kept terms, marks and letters of all scripts, clashing columns, an empty table."""
    rows = [("en", "a", "The the THE cat-dog É é"), ("en", "a", None), ("en", "b", "the cat ÉTÉ été\x00x"), ("en", None, "the ſ"), (None, None, "1 2 3 !"), (None, "z", None), ("de", "only", "wort wort"), ("fr", "x", ""), ("fr", "y", "un"), ("en", "c", "12 _ `{")]
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], KIND + ", count int, term string")
    for least in (1, 2):
        assert audited(df, least, 3) == plain(rows, least, 3)
    assert divergence.audit(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, monkeypatch, seed):
    """Many sources, terms with equal rows of counts, ties; portions of few rows and dictionaries of few terms."""
    monkeypatch.setattr(divergence, "ROWS", 7)
    monkeypatch.setattr(divergence, "HELD", 20)
    monkeypatch.setattr(divergence, "BLOCK", 16)
    rng = random.Random(seed)
    rows = []
    for n in range(160):
        lang, source = rng.choice(["en", "en", "de"]), f"s{rng.choice([0, 0, 0, *range(11)])}"
        rows.append((lang, source, " ".join(rng.choice(["w", "v", "Ä"]) + "abcdefghij"[rng.randrange(10)] * rng.randrange(1, 3) for _ in range(rng.randrange(0, 40)))))
    df = spark.createDataFrame(rows, KIND).repartition(5)
    assert audited(df, 3, 4) == plain(rows, 3, 4)


def test_tree_shares_paths():
    """Levels of the tree of four rows: nodes with the terms that pass through each."""
    rank = np.array([[1, 2, -1], [1, 2, 3], [1, 3, -1], [2, -1, -1]])
    count = np.array([[5, 1, -1], [5, 1, 1], [5, 1, -1], [5, -1, -1]])
    levels = divergence.tree(rank, count, np.array([2, 3, 2, 1]), np.array([10, 1, 2, 4]))
    assert [(x.starts.tolist(), x.times.tolist()) for x in levels] == [([0, 3], [13, 4]), ([0, 2], [11, 2]), ([1], [1])]


def test_long_text(spark):
    """A text of several blocks, with a term as long as one."""
    text = "ab " * 500_000 + "x" * (divergence.BLOCK + 10) + " ab"
    rows = [("en", "a", text), ("en", "b", "ab")]
    assert audited(spark.createDataFrame(rows, KIND), 1, 5) == plain(rows, 1, 5)
