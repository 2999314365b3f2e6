"""Word and shingle fingerprints of whole texts, in numpy, a bounded slice at a time.

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z are lower-cased first. Words get
a 64-bit fingerprint (multilinear in the bytes, then mixed) and a shingle combines the
fingerprints of its words in order. Two different shingles share a fingerprint with a chance of
about 2**-64, which is the only inexactness of anything built on them.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLOCK = 1 << 20  # bytes hashed at once


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_POWER = mix(np.arange(1, 4097, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) | U(1)


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint and start of every word of a slice that cuts no word."""
    solid = ~_SPACE[raw]
    at = np.flatnonzero(solid)
    if not at.size:
        return np.empty(0, U), np.empty(0, np.int64)
    first = np.empty(at.size, bool)
    first[0] = True
    np.not_equal(at[1:], at[:-1] + 1, out=first[1:])
    starts = np.flatnonzero(first)
    length = np.diff(np.append(starts, at.size))
    place = np.arange(at.size) - np.repeat(starts, length)
    factor = _POWER[place & 4095]
    if length.max() > 4096:
        factor = factor + (place >> 12).astype(U) * U(0xD6E8FEB86659FD93)
    value = np.add.reduceat((_LOWER[raw[at]].astype(U) + U(1)) * factor, starts)
    return mix(value + length.astype(U) * U(0xA0761D6478BD642F)), at[starts]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints of all words in order, number of words of each text)."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    ends = np.cumsum(sizes)
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    hashes, places, lo = [], [], 0
    while lo < raw.size:
        hi = min(raw.size, lo + _BLOCK)
        while hi < raw.size and not _SPACE[raw[hi - 1]]:
            step = np.flatnonzero(_SPACE[raw[hi : hi + _BLOCK]])
            hi = hi + int(step[0]) + 1 if step.size else min(raw.size, hi + _BLOCK)
        h, s = _words(raw[lo:hi])
        hashes.append(h)
        places.append(s + lo)
        lo = hi
    h, p = np.concatenate(hashes), np.concatenate(places)
    return h, np.diff(np.searchsorted(p, ends, "left"), prepend=0)


def shingle_sets(words: np.ndarray, counts: np.ndarray, width: int) -> list[np.ndarray]:
    """Per text the sorted distinct shingles of `width` words; fewer words give one shingle of them all, none an empty set."""
    n = words.size
    rolled = np.zeros(max(0, n - width + 1), U)
    for j in range(width):
        rolled = rolled * U(0x2545F4914F6CDD1D) + words[j : j + rolled.size]
    rolled = mix(rolled + U(width))
    out, lo = [], 0
    for c in counts.tolist():
        if c >= width:
            out.append(np.unique(rolled[lo : lo + c - width + 1]))
        elif c:
            v = np.zeros(1, U)
            for j in range(lo, lo + c):
                v = v * U(0x2545F4914F6CDD1D) + words[j : j + 1]
            out.append(mix(v + U(c)))
        else:
            out.append(np.empty(0, U))
        lo += c
    return out


def slices(texts: list[bytes], most: int = 2 << 20):
    """Index ranges of `texts` with at most `most` bytes, or one text."""
    lo, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > most:
            yield lo, i
            lo, total = i, 0
        total += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def text_shingles(texts: list[bytes], width: int):
    """Yield the shingle set of each text in order."""
    for lo, hi in slices(texts):
        words, counts = word_hashes(texts[lo:hi])
        yield from shingle_sets(words, counts, width)


def column_bytes(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column (null: empty)."""
    import pyarrow as pa

    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]
