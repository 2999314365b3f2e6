"""SQL of DuckDB for the likeness of two strings with their words sorted."""

from __future__ import annotations


def words_in_order(text: str) -> str:
    """The words of a text, sorted and joined by a space."""
    return f"array_to_string(list_sort(list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> '')), ' ')"


def common(x: str, y: str) -> str:
    """Length of the longest common subsequence of two strings, of which x has 110 letters at most: a row of bits, one for each letter of x, is updated for each letter of y."""
    full = f"((1::HUGEINT << length({x})::INT) - 1)"
    bits = f"list_transform(string_split({y}, ''), lambda c: coalesce(list_sum(list_transform(range(1, length({x}) + 1), lambda i: CASE WHEN {x}[i] = c THEN 1::HUGEINT << (i - 1)::INT ELSE 0::HUGEINT END)), 0)::HUGEINT)"
    return f"(length({x}) - bit_count(list_reduce(list_concat([{full}], {bits}), lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full}))::INT)"


def ratio(x: str, y: str) -> str:
    """Share (0 to 1) of both strings, words sorted, that their longest common subsequence holds; 0 if one is null or empty."""
    a, b = words_in_order(x), words_in_order(y)
    return f"""(SELECT CASE WHEN coalesce({x}, '') = '' OR coalesce({y}, '') = '' THEN 0 WHEN a = '' AND b = '' THEN 1 WHEN a = '' OR b = '' THEN 0 ELSE 2.0::DOUBLE * {common('a', 'b')} / (length(a) + length(b)) END::DOUBLE
        FROM (SELECT {a} AS a, {b} AS b))"""
