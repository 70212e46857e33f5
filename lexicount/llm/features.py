"""Hashed character n-grams of whole texts in numpy, for the classifiers."""
from __future__ import annotations

import numpy as np

_SPACES = np.zeros(33, dtype=bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


def text_codes(text: str | None, lower: bool = True) -> np.ndarray:
    """Code points (lower-cased by default) between two separators; each white-space character is a separator (32)."""
    text = (text or "").lower() if lower else text or ""
    c = np.frombuffer((" " + text + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    small = c < 33
    if small.any():
        c = c.copy()
        c[np.flatnonzero(small)[_SPACES[c[small]]]] = 32
    return c


def ngrams(codes: np.ndarray, low: int, high: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, start position) of all n-grams that lie in one word, its bounding separators included."""
    sep = (codes == 32)
    before = np.concatenate([[0], np.cumsum(sep)])
    h = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    buckets, starts = [], []
    acc = h.copy()
    for n in range(1, high + 1):
        if n > len(codes):
            break
        if n > 1:
            acc = acc[:-1] * np.uint64(0x100000001B3) + h[n - 1:]
        if n < low:
            continue
        m = len(acc)
        if n <= 2:
            ok = ~sep[:m] if n == 1 else ~(sep[:m] & sep[1:m + 1])
        else:
            ok = before[n - 1:n - 1 + m] == before[1:m + 1]  # nothing but the ends may be a separator
        at = np.flatnonzero(ok)
        x = acc[at] ^ np.uint64(n)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        buckets.append((x >> np.uint64(64 - bits)).astype(np.int64))
        starts.append(at)
    if not buckets:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(buckets), np.concatenate(starts)


def word_index(codes: np.ndarray) -> np.ndarray:
    """For each position the number (from 0) of the word that covers it or comes next."""
    sep = codes == 32
    ends = np.concatenate([[False], ~sep[:-1] & sep[1:]])  # separators right after a word
    return np.cumsum(ends)
