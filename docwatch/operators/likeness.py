"""Longest common subsequences of many strings at once: columns of letters and words of bits in numpy, for the tasks of Spark jobs."""

from __future__ import annotations

import numpy as np


def in_order(s: str) -> str:
    return " ".join(sorted(s.split()))


def letters(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the strings, one row each, 0 behind their ends; and their lengths."""
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    codes = np.zeros((len(strings), max(int(size.max(initial=0)), 1)), np.uint32)
    codes[np.arange(codes.shape[1]) < size[:, None]] = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, size


def common(x: list[str], y: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each x[k] and y[k]: bits of x, in words of 32 with their carry in the upper half, updated for each letter of y."""
    out = np.zeros(len(x), np.int64)
    longest = max(map(len, x), default=0)
    step = max(1, 2_000_000 // max(1, longest))
    for a in range(0, len(x), step):
        out[a : a + step] = _common(x[a : a + step], y[a : a + step])
    return out


def _common(x: list[str], y: list[str]) -> np.ndarray:
    (cx, n), (cy, m) = letters(x), letters(y)
    known, at = np.unique(np.concatenate([cx.ravel(), cy.ravel()]), return_inverse=True)
    cx, cy = at[: cx.size].reshape(cx.shape), at[cx.size :].reshape(cy.shape)
    rows, words = len(x), (cx.shape[1] + 31) // 32
    if rows > 1 and rows * len(known) * words > 4_000_000:
        half = rows // 2
        return np.concatenate([_common(x[:half], y[:half]), _common(x[half:], y[half:])])
    match = np.zeros((words, len(known), rows), np.uint64)
    row = np.arange(rows)
    for i in range(cx.shape[1]):
        live = i < n
        match[i // 32, cx[live, i], row[live]] |= np.uint64(1 << i % 32)
    low, shift = np.uint64(0xFFFFFFFF), np.uint64(32)
    v = np.full((words, rows), low)
    for j in range(cy.shape[1]):
        live = j < m
        carry = np.zeros(rows, np.uint64)
        for w in range(words):
            u = v[w] & np.where(live, match[w, cy[:, j], row], np.uint64(0))
            total = v[w] + u + carry
            carry = total >> shift
            v[w] = (total & low) | (v[w] & ~u)
    return words * 32 - np.bitwise_count(v).sum(axis=0, dtype=np.int64)


def _bitmaps(a: np.ndarray, b: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits of the tokens in each row of a and of b (below 0: none), and how many tokens of a row of a share a bit with another. The most frequent tokens get a bit of their own."""
    known, at, times = np.unique(np.concatenate([a.ravel(), b.ravel()]), return_inverse=True, return_counts=True)
    none = known < 0
    times[none] = -1
    place = np.empty(len(known), np.int64)
    place[np.argsort(-times, kind="stable")] = np.arange(len(known))
    bits = words * 64
    place = np.where(place < bits - bits // 8, place, bits - bits // 8 + place % (bits // 8))
    out = []
    for part, shape in ((at[: a.size], a.shape), (at[a.size :], b.shape)):
        part = part.reshape(shape)
        held, row = np.zeros((words, shape[0]), np.uint64), np.arange(shape[0])
        for k in range(shape[1]):
            p, live = place[part[:, k]], ~none[part[:, k]]
            held[p[live] // 64, row[live]] |= np.uint64(1) << (p[live] % 64).astype(np.uint64)
        out.append(held)
    return *out, (a >= 0).sum(axis=1) - np.bitwise_count(out[0]).sum(axis=0, dtype=np.int64)


def _numbered(codes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Tokens (letter, how many of it stood before), -1 behind the end."""
    c = codes.astype(np.int64)
    seen = np.zeros_like(c)
    for j in range(1, c.shape[1]):
        seen[:, j] = (c[:, :j] == c[:, j : j + 1]).sum(axis=1)
    return np.where(np.arange(c.shape[1]) < size[:, None], c << 32 | seen, -1)


def _pairs_of_letters(codes: np.ndarray, size: np.ndarray) -> np.ndarray:
    c = codes.astype(np.int64)
    two = c[:, :-1] << 32 | c[:, 1:] if c.shape[1] > 1 else np.full((len(c), 1), -1)
    return np.where(np.arange(two.shape[1]) < size[:, None] - 1, two, -1)


def similar(x: list[str], y: list[str], least: float, block: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) of all pairs whose share (0 to 100) of their longest common subsequence is `least` or more. x are of one length above 0, y too.

    No pair is lost: a common subsequence is no longer than the letters that both hold (repeats counted), and one of l letters among n and m keeps 3 l - 1 - n - m pairs of neighbours at
    least. What passes both bounds is compared exactly. Memory is that of `block` strings of x with all of y.
    """
    (cx, n), (cy, m) = letters(x), letters(y)
    both = int(n[0] + m[0])
    need = int(np.ceil(least * both / 200 - 1e-9))
    bx, by, over = _bitmaps(_numbered(cx, n), _numbered(cy, m), 1)
    gx, gy, lost = _bitmaps(_pairs_of_letters(cx, n), _pairs_of_letters(cy, m), 4)
    found = []
    for a in range(0, len(x), block):
        held = np.bitwise_count(bx[0, a : a + block, None] & by[0])
        i, j = np.nonzero(held >= np.clip(need - over[a : a + block, None], 0, 255).astype(np.uint8))
        i += a
        near = sum(np.bitwise_count(gx[w, i] & gy[w, j]).astype(np.int64) for w in range(4)) + lost[i] >= 3 * need - 1 - both
        i, j = i[near], j[near]
        if len(i):
            score = 200.0 * common([x[k] for k in i], [y[k] for k in j]) / both
            kept = score >= least
            found.append((i[kept], j[kept], score[kept]))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.float64 if k == 2 else np.int64) for k in range(3))
