"""Stable 64-bit hashes of words and word runs with numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function (splitmix64)."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """xxh3 of words under a seed, of which a bounded number are kept."""

    def __init__(self, keep: int = 150_000, seed: int = 0) -> None:
        super().__init__()
        self.keep, self.seed = keep, seed

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word, self.seed)
        if len(self) < self.keep:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every `size` consecutive word hashes."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = hashes[:n].copy()
    for i in range(1, size):
        h *= _BASE
        h += hashes[i : i + n]
    return mix(h)
