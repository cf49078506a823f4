"""Words and word windows as arrays of hashes."""

from __future__ import annotations

import numpy as np
import xxhash

SPACE = b" \t\n\r\x0b\x0c"      # what separates words; bytes.split() without an argument splits at exactly these
CACHE_WORDS = 200_000
FACTOR = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
MIX = np.uint64(0xBF58476D1CE4E5B9)


class WordHash(dict):
    """64-bit hashes of words, emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of x spread over all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * MIX
    return x ^ (x >> np.uint64(29))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words: a polynomial in FACTOR, by
    doubling, so that its cost is the logarithm of the size."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, width, base, out, done = FACTOR, 1, hashes, None, 0
    left = size
    while left:
        if left & 1:
            # out covers the first ``done`` words of a window; base[i] the next ``width``.
            out = base[:n] if out is None else out * np.uint64(power) + base[done:done + n]
            done += width
        left >>= 1
        if left:
            base = base[:-width] * np.uint64(power) + base[width:]
            power = power * power & MASK
            width *= 2
    return mixed(out)


def repeated_mask(hashes: np.ndarray, size: int) -> np.ndarray:
    """Words inside a window that occurs twice or more."""
    keys = windows(hashes, size)
    mask = np.zeros(len(hashes), bool)
    if len(keys) > 1:
        order = np.sort(keys)
        twice = order[1:][order[1:] == order[:-1]]
        if len(twice):
            mask = covered(np.flatnonzero(np.isin(keys, twice)), size, len(hashes))
    return mask


def covered(starts: np.ndarray, size, n: int) -> np.ndarray:
    """Mask of n words covered by runs of ``size`` from ``starts``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return np.cumsum(edge[:-1]) > 0
