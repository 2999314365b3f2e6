"""Alignment of two tokenizers: whole-text encodings and a plain two-pointer walk give the same rows."""

import hashlib
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from docwatch.llm import alignment, queries


@pytest.fixture(scope="module")
def encoder():
    return alignment.Encoder(alignment.FOLDER, alignment.BYTES, alignment.PIECES)


def walked(encoder, text):
    """(ids of A, ids of B, groups, links) of a text, or None where it has no tokens."""
    if not text:
        return None
    a, b = encoder.a.encode(" " + text, add_special_tokens=False).ids, encoder.b.encode(text, num_threads=1)
    of = lambda ids, table: [table[i] for i in ids]
    if b"".join(of(a, encoder.a_bytes)) != (" " + text).encode() or b"".join(of(b, encoder.b_bytes)) != (" " + text).encode():
        return None
    i = j = end_a = end_b = 0
    groups, links, ga, gb = [], [], [a[0]], [b[0]]
    end_a, end_b = len(encoder.a_bytes[a[0]]), len(encoder.b_bytes[b[0]])
    while True:
        links.append((a[i], b[j]))
        if end_a == end_b:
            groups.append((ga, gb))
            if i + 1 == len(a):
                return a, b, groups, links
            i, j, ga, gb = i + 1, j + 1, [a[i + 1]], [b[j + 1]]
            end_a, end_b = end_a + len(encoder.a_bytes[a[i]]), end_b + len(encoder.b_bytes[b[j]])
        elif end_a < end_b:
            i += 1
            ga.append(a[i])
            end_a += len(encoder.a_bytes[a[i]])
        else:
            j += 1
            gb.append(b[j])
            end_b += len(encoder.b_bytes[b[j]])


def plain(encoder, rows):
    per = [walked(encoder, t) for _, t in rows]
    docs = Counter(x for p in per if p for x in set(p[3]))
    highest = defaultdict(int)
    for (a, _), n in docs.items():
        highest[a] = max(highest[a], n)
    out = []
    for (i, _), p in zip(rows, per):
        if p is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in p[2])
        out.append((i, len(p[0]), len(p[1]), len(p[2]), len(p[3]), sum(docs[x] == highest[x[0]] for x in p[3]), sum(docs[x] for x in p[3]), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def test_given_documents(spark, sf, encoder):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op12_tokenizer_alignment(spark, sf)
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]
    assert sorted((tuple(r[c] for c in [*COLUMNS, "groups_sha256"]) for r in got.collect()), key=str) == plain(encoder, rows)


ODD = [
    (1, None), (2, ""), (3, " "), (4, "   "), (5, "\n"), (6, "a "), (7, " a"), (8, "a  b\n c \t d  e"), (9, "▁ stands for a space"), (10, "<|endoftext|> <s></s> <0x41> <unk>"),
    (11, "日本語 のテキスト 😀 👩‍👩‍👧"), (12, "é   x \x00y \x1c z \x85 w"), (13, "same"), (13, "same"), (14, "same"), (None, "same"), (None, None), (15, "it's we'll DON'T 'S"), (16, "x" * 500 + " " + "é" * 300),
    (17, "ends in spaces   "), (18, "a\r\n b\r\n\r\nc"), (19, "12345 6 78.9 $$ -- ... "),
]


def test_odd_texts(spark, encoder):
    """Nulls, white space of all kinds, markers inside texts, repeated rows, and extra columns whose names clash with the operator's."""
    df = spark.createDataFrame([(i, t, 7, "x", [1]) for i, t in ODD], "doc_id long, text string, row int, pairs string, times array<int>")
    got = alignment.align(df).collect()
    assert sorted((tuple(r[c] for c in [*COLUMNS, "groups"]) for r in got), key=str) == plain(encoder, ODD)
    assert alignment.align(df.limit(0)).count() == 0


def test_segments_are_encoded_as_in_the_text(encoder):
    """Tokens of the segments in a row are those of the whole text, for texts of random spaces, letters and marks."""
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice([" ", " ", "  ", "\n", "\t", " ", "　", "a", "the", "ing", "é", "ß", "1", ".", "'s", "日", "\x1f", "-"]) for _ in range(rng.randrange(1, 14)))
        parts = alignment.segments(text)
        assert "".join(" " + p for p in parts) == " " + text
        of, right, tokens = encoder.tokens(parts)
        assert right[of].all()
        of_a, of_b = ([i for x in t.take(pa.array(of)).to_pylist() for i in x] for t in tokens)
        assert of_a == encoder.a.encode(" " + text, add_special_tokens=False).ids, repr(text)
        assert of_b == encoder.b.encode(text, num_threads=1), repr(text)


def test_long_texts_and_small_slices(spark, encoder, monkeypatch):
    """Texts longer than a slice, partial counts in small portions, and few pairs by broadcast give the same rows; whole groups are given as text."""
    monkeypatch.setattr(alignment, "SLICE", 7)
    monkeypatch.setattr(alignment, "KEPT", 5)
    monkeypatch.setattr(alignment, "PARTIAL", 10)
    monkeypatch.setattr(alignment, "HELD", 15)
    rng = random.Random(1)
    rows = [*ODD, *((100 + n, " ".join(rng.choice(["alpha", "beta,", "gämma", "▁" if n == 3 else "delta", "x1"]) for _ in range(rng.randrange(1, 60)))) for n in range(30))]
    got = alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), whole=True).collect()
    digest = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    assert sorted(((*(r[c] for c in COLUMNS), digest(r.groups)) for r in got), key=str) == plain(encoder, rows)
