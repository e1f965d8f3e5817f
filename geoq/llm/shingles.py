"""Word shingles as 64-bit hashes, computed with numpy over whole texts."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words kept per generation of a worker's cache of word hashes.
CACHE_WORDS = 100_000
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


class WordHasher(dict):
    """64-bit hashes of words, bounded: the older generation goes when full."""

    def __init__(self):
        super().__init__()
        self.old: dict = {}

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        value = self.old.get(word)
        if value is None:
            value = xxhash.xxh64_intdigest(word)
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


HASHER = WordHasher()


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased words between ASCII white space."""
    return text.lower().split()


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _Q
    return h ^ (h >> np.uint64(29))


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive words, in text order, with repeats."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    w = HASHER.of(words)
    h = w[:n].copy()
    for j in range(1, k):
        h *= _P
        h ^= w[j:j + n]
    return mix(h + np.uint64(k))


def document_shingles(words: list[bytes], k: int = 5) -> np.ndarray:
    """Distinct ``k``-word shingles, ascending; of fewer words, the whole
    sequence as one; of none, none."""
    return np.unique(shingle_hashes(words, min(k, len(words)))) if words else np.zeros(0, np.uint64)
