"""Sets of word shingles and their MinHash values."""

from __future__ import annotations

import numpy as np

from tabwright.llm.arrays import Texts, grams, range_hashes, word_hashes, words_of

WORDS = 5


def shingle_rows(texts: Texts, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each row, repeats included, and where each row begins.

    A text of 1 to n - 1 words has one shingle of all its words, a text without words none.
    """
    words = words_of(texts)
    codes = word_hashes(texts.data, words)
    full, begins = grams(codes, words.first, n)
    short = np.flatnonzero((words.counts > 0) & (words.counts < n))
    if not len(short):
        return full, begins
    whole = range_hashes(codes, words.first[short], words.first[short + 1])
    counts = np.diff(begins)
    at = begins[short]
    counts[short] = 1
    return np.insert(full, at, whole), np.concatenate([[0], np.cumsum(counts)])


def seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return (rng.integers(0, 1 << 32, n, dtype=np.uint32),
            rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1))


def minhash(hashes: np.ndarray, begins: np.ndarray, size: int) -> np.ndarray:
    """A (rows, size) table of MinHash values; rows without shingles hold the largest value."""
    counts = np.diff(begins)
    found = np.full((len(counts), size), np.uint32(0xFFFFFFFF), np.uint32)
    filled = np.flatnonzero(counts)
    if len(filled):
        base = (hashes >> np.uint64(32)).astype(np.uint32)
        flips, factors = seeds(size)
        starts, buffer = begins[filled], np.empty_like(base)
        for i in range(size):
            np.bitwise_xor(base, flips[i], out=buffer)
            np.multiply(buffer, factors[i], out=buffer)
            found[filled, i] = np.minimum.reduceat(buffer, starts)
    return found
