"""Hashes of word shingles of whole texts, in numpy."""

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_tables(n: int):
    """Powers of the multiplier and of its inverse, kept and grown as longer texts come."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        _powers = tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, p, np.uint64))))
                        for p in (_P, _INVERSE))
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, words being runs without white space."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    inside = np.concatenate(([False], ~_SPACE[data], [False])).view(np.int8)
    edge = np.flatnonzero(np.diff(inside))
    start, end = edge[::2], edge[1::2]
    up, down = _power_tables(len(data) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)])))
    return mixed((total[end] - total[start]) * down[start])


def shingle_hashes(text: str, words: int = 5) -> np.ndarray:
    """Sorted different hashes of all runs of so many words; of all words where there are fewer."""
    w = word_hashes(text)
    n = len(w) - words + 1
    if n < 1:
        n, words = min(1, len(w)), len(w)
    h = np.zeros(n, np.uint64)
    for j in range(words):
        h = h * _Q + w[j:j + n]
    return np.unique(mixed(h + np.uint64(words)))
