"""Hashed words and word shingles of whole texts, a batch at a time."""

from __future__ import annotations

import numpy as np

#: Words that a task remembers; beyond that it forgets all and begins anew.
REMEMBERED = 500_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def normal(word: str) -> str:
    """Lower case without what is neither letter nor digit at either end."""
    word = word.lower()
    a, b = 0, len(word)
    while a < b and not word[a].isalnum():
        a += 1
    while a < b and not word[b - 1].isalnum():
        b -= 1
    return word[a:b]


class WordHash(dict):
    """Word to the 64-bit hash of its normal form; 0 if nothing is left of it."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= REMEMBERED:
            self.clear()
        plain = normal(word.decode("utf-8", "replace"))
        found = self[word] = (xxh64_intdigest(plain.encode()) or 1) if plain else 0
        return found


def hashed(texts: list[bytes], known: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words that have a normal form, and how many each text has."""
    words = [t.split() for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    hashes = np.fromiter((known[w] for row in words for w in row), np.uint64, int(n.sum()))
    doc = np.repeat(np.arange(len(words)), n)
    real = hashes != 0
    return hashes[real], np.bincount(doc[real], minlength=len(words))


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hashes of k words of each text, and how many each text has."""
    n = np.maximum(counts - (k - 1), 0)
    if len(hashes) < k:
        return np.zeros(0, np.uint64), np.zeros_like(n)
    m = len(hashes) - k + 1
    rolled = hashes[:m].copy()
    for j in range(1, k):
        rolled *= MULTIPLIER
        rolled += hashes[j : j + m]
    first = np.cumsum(counts) - counts
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return rolled[at], n


class Member:
    """Which of many hashes belong to a small set: one bit table first, then a search for what passes."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values.astype(np.uint64))
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.values * MULTIPLIER >> np.uint64(44)).astype(np.int64)] = True

    def positions(self, hashes: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.table[(hashes * MULTIPLIER >> np.uint64(44)).astype(np.int64)])
        if not len(maybe) or not len(self.values):
            return maybe[:0]
        at = np.minimum(np.searchsorted(self.values, hashes[maybe]), len(self.values) - 1)
        return maybe[self.values[at] == hashes[maybe]]
