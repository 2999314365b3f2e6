"""Text expressions: normal forms, hashes, SimHash, differences of scalars, lists and numbers. All inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Distances up to these are "near_identical" and "moderate"; more is "large".
NEAR_IDENTICAL, MODERATE = 3, 12
WORD = r"[\p{L}\p{N}_]+"


def normalize_text(c: Column) -> Column:
    """White space runs as one space, trimmed, lower-cased."""
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def text_hash(c: Column) -> Column:
    """SHA-256 of the normalized text."""
    return F.sha2(normalize_text(c), 256)


def words(c: Column) -> Column:
    """Words of the normalized text; white space is in none of them, so it needn't be collapsed first."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def word_hash(w: Column) -> Column:
    """Low 64 bits of a word's MD5, as a signed number."""
    return F.conv(F.substring(F.md5(w), 17, 16), 16, -10).cast("long")


def from_bits(bits: list[Column]) -> Column:
    """A signed 64-bit number of 64 truth values, lowest first."""
    one = [F.when(b, F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for i, b in enumerate(bits)]
    return reduce(lambda a, b: a.bitwiseOR(b), one)


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def simhash_similarity(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, 0 for all bits different or a missing one."""
    return F.coalesce(F.lit(1.0) - distance(a, b) / F.lit(64.0), F.lit(0.0))


def simhash_tier(a: Column, b: Column) -> Column:
    """near_identical, moderate or large; a missing fingerprint is no evidence of a change."""
    d = distance(a, b)
    return F.when(d.isNull() | (d <= NEAR_IDENTICAL), "near_identical").when(d <= MODERATE, "moderate").otherwise("large")


def scalar_changed(old: Column, new: Column) -> Column:
    """Whether two values differ; strings are compared without space at their ends."""
    return ~F.trim(old).eqNullSafe(F.trim(new))


def list_diff(old: Column, new: Column) -> Column:
    """struct(added, removed), each sorted."""
    a, b = F.coalesce(old, F.array().cast("array<string>")), F.coalesce(new, F.array().cast("array<string>"))
    return F.struct(F.array_sort(F.array_except(b, a)).alias("added"), F.array_sort(F.array_except(a, b)).alias("removed"))


def number_diff(old: Column, new: Column) -> Column:
    """struct(delta, percentage) of two numbers that differ, else null; no percentage of 0 or nothing."""
    percent = F.when(old != 0, F.bround((new - old) / old * 100, 2))
    return F.when(~old.eqNullSafe(new), F.struct((new - old).alias("delta"), percent.alias("percentage")))


def to_number(c: Column) -> Column:
    """A number written with or without thousands commas; null if it is none."""
    return F.regexp_replace(c.cast("string"), ",", "").try_cast("double")


def html_to_text(c: Column) -> Column:
    """Text of a fragment: scripts and styles dropped, tags to spaces, common references decoded, white space collapsed."""
    t = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, "(?s)<[^>]+>", " ")
    for name, sign in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("apos", "'"), ("middot", "·"), ("copy", "©"), ("amp", "&")):
        t = F.replace(t, F.lit(f"&{name};"), F.lit(sign))
    return F.trim(F.regexp_replace(t, r"\s+", " "))
