"""64-bit hashes of words and of runs of words, vectorised, equal in every task."""

from __future__ import annotations

import numpy as np
import xxhash

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class Hashes(dict):
    """Word (bytes) -> hash; emptied when it holds so many words that memory would grow with the corpus."""

    MOST = 1 << 19

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.MOST:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) < 64:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive items."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = np.full(n, k, np.uint64)
    for j in range(k):
        x = mixed(x * M1 + h[j : j + n])
    return x


BASE = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    x = np.full(n, base, np.uint64)
    if n:
        x[0] = 1
    return np.cumprod(x, dtype=np.uint64)


def ranges(h: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the runs h[start:stop], equal for equal runs wherever they stand."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(BASE, len(h)), dtype=np.uint64)])
    return mixed((total[stop] - total[start]) * powers(INVERSE, len(h) + 1)[start] + (stop - start).astype(np.uint64) * M1)


def heads(*keys: np.ndarray) -> np.ndarray:
    """Where a new group of the sorted ``keys`` begins."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def anchors(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Winnowing: for each run of windows that share their least gram, (first window, last window, that gram's hash).

    The least gram (leftmost of equals) depends on a window's content alone, so equal windows name equal grams at
    equal places in them.
    """
    g = runs(h, gram)
    width = window - gram + 1
    if len(g) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = least(g, width)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(at) - 1]])
    return first, last, g[at[first]]


def least(g: np.ndarray, width: int) -> np.ndarray:
    """The place of the leftmost least value in each stretch of ``width`` values, by doubling stretches."""
    at, size = np.arange(len(g)), 1
    while size < width:
        step = min(size, width - size)
        a, b = at[:-step], at[step:]
        at, size = np.where(g[b] < g[a], b, a), size + step
    return at
