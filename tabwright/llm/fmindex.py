"""A compressed FM-index over integer codes, and substring removal with it.

The index keeps the Burrows-Wheeler transform of a shard as a wavelet matrix: one bit vector for each
bit of a code, in 64-bit words with running counts. Backward search narrows a suffix range by one code
at a time; all segments of a shard go through it side by side, as NumPy arrays.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabwright.llm.arrays import Texts, word_hashes, words_of
from tabwright.llm.repeats import Method, covered, repeated_windows, with_or_without_places
from tabwright.llm.rows import map_texts
from tabwright.plans import storage

WINDOW, GRAM = 50, 20


def suffix_order(codes: np.ndarray, depth: int | None = None) -> np.ndarray:
    """The suffixes in order of their first ``depth`` codes (all of them by default), by prefix doubling."""
    n = len(codes)
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    step, order = 1, np.argsort(rank, kind="stable")
    while step < (depth or n):
        following = np.zeros(n, np.int64)
        following[:n - step] = rank[step:] + 1
        key = rank * (n + 1) + following
        order = np.argsort(key, kind="stable")
        new = np.ones(n, bool)
        new[1:] = key[order][1:] != key[order][:-1]
        rank[order] = np.cumsum(new) - 1
        step *= 2
        if new.all():
            break
    return order


class WaveletMatrix:
    """Rank queries over a sequence of codes, most significant bit first."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.size, self.levels = bits, len(values), []
        for level in range(bits - 1, -1, -1):
            bit = ((values >> level) & 1).astype(bool)
            padded = np.zeros(-(-(self.size + 1) // 64) * 64, bool)
            padded[:self.size] = bit
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]])
            self.levels.append((level, packed, before, self.size - int(bit.sum())))
            values = np.concatenate([values[~bit], values[bit]])

    def descend(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the prefix of length ``at`` ends among the entries sorted to each code's leaf."""
        for level, packed, before, zeros in self.levels:
            word = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = before[word] + np.bitwise_count(packed[word] & mask)
            at = np.where((codes >> level) & 1, zeros + ones, at - ones)
        return at


class FMIndex:
    """Backward search over some texts: ``codes`` one after the other, each beginning at ``begins``.

    ``order`` holds a number for each text; a range of suffixes knows the least one of its texts.
    """

    def __init__(self, codes: np.ndarray, begins: np.ndarray, order: np.ndarray, depth: int):
        self.names, plain = np.unique(codes, return_inverse=True)
        counts = np.diff(begins)
        text = np.repeat(np.arange(len(counts)), counts)
        size = len(codes) + len(counts)
        joined = np.zeros(size, np.int64)  # 0 ends each text
        joined[np.arange(len(codes)) + text] = plain + 1
        self.plain = plain + 1
        suffixes = suffix_order(joined, depth)
        self.matrix = WaveletMatrix(joined[suffixes - 1], max(1, int(len(self.names)).bit_length()))
        alphabet = np.arange(len(self.names) + 1)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(joined, minlength=len(alphabet)))])
        self.leaf = self.matrix.descend(alphabet, np.zeros(len(alphabet), np.int64))
        owner = np.repeat(np.arange(len(counts)), counts + 1)
        self.orders, place = np.unique(order, return_inverse=True)
        table = [place.astype(np.int32)[owner][suffixes]]
        while 2 << len(table) - 1 <= size:
            half = 1 << len(table) - 1
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        self.least = table
        self.size = size

    def extend(self, code: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of ``code`` followed by what the ranges stand for."""
        base = self.below[code] - self.leaf[code]
        return base + self.matrix.descend(code, low), base + self.matrix.descend(code, high)

    def least_order(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least order of the texts in each non-empty range."""
        width = (np.frexp((high - low).astype(float))[1] - 1).astype(np.int64)
        found = np.empty(len(low), np.int32)
        for level in np.unique(width):
            here = width == level
            table = self.least[level]
            found[here] = np.minimum(table[low[here]], table[high[here] - (1 << int(level))])
        return self.orders[found]


def earlier_windows(codes: np.ndarray, begins: np.ndarray, order: np.ndarray) -> list[tuple[int, int, int]]:
    """(segment, first window, last window) for the windows that a segment of a smaller order holds too.

    Each segment is streamed backwards against the index. The match grows to the left while some smaller
    text has it; where it can't, a match of WINDOW codes or more is reported, and the search begins anew at
    the last end that a window left of the failure could have.
    """
    index = FMIndex(codes, begins, order, 2 * WINDOW)
    lane = np.arange(len(order))
    end = np.diff(begins)
    at = end.copy()
    low, high = np.zeros(len(lane), np.int64), np.full(len(lane), index.size)
    found = []
    while len(lane):
        fits = at > 0
        code = index.plain[begins[lane] + np.maximum(at - 1, 0)]
        new_low, new_high = index.extend(code, low, high)
        fits &= new_high > new_low
        some = np.flatnonzero(fits)
        fits[some] = index.least_order(new_low[some], new_high[some]) < order[lane[some]]
        low, high, at = np.where(fits, new_low, low), np.where(fits, new_high, high), at - fits
        stop = np.flatnonzero(~fits)
        if len(stop):
            long = stop[end[stop] - at[stop] >= WINDOW]
            found += zip(lane[long].tolist(), at[long].tolist(), (end[long] - WINDOW).tolist())
            end[stop] = np.where(at[stop] > 0, np.minimum(end[stop] - 1, at[stop] - 1 + WINDOW), 0)
            at[stop], low[stop], high[stop] = end[stop], 0, index.size
            alive = end >= WINDOW
            lane, end, at, low, high = lane[alive], end[alive], at[alive], low[alive], high[alive]
    return found


def _word_codes(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    words = words_of(texts)
    return word_hashes(texts.data, words), words.first


WORDS = Method(_word_codes, earlier_windows, WINDOW, GRAM, "earlier")


def without_earlier_passages(docs: DataFrame) -> DataFrame:
    """Remove the words of passages of ``WINDOW`` words that a document with a smaller id has too.

    Gives doc_id, n_words, n_removed, kept_sha256 and kept_text (the kept words joined by a space) for each
    document. Defined cases: a null or empty text has no words; shorter texts lose nothing; documents with
    the same id don't remove each other's words; a null id counts as the largest.
    """
    runs = storage.written(repeated_windows(docs, WORDS), "repeats")
    found = with_or_without_places(docs, runs)

    def start():
        def strip(texts, rows):
            words = words_of(texts)
            removed, digests, kept_texts = [], [], []
            for row, runs in enumerate(rows.column("runs").to_pylist()):
                first, last = words.first[row], words.first[row + 1]
                if runs:
                    gone = covered(runs, last - first, WINDOW)
                    keep = np.flatnonzero(~gone) + first
                    removed.append(int(gone.sum()))
                else:
                    keep = np.arange(first, last)
                    removed.append(0)
                data = texts.data
                kept = b" ".join([data[a:b].tobytes() for a, b in zip(words.starts[keep], words.ends[keep])])
                kept_texts.append(kept.decode())
                digests.append(hashlib.sha256(kept).hexdigest())
            return [rows.column("doc_id"), words.counts, pa.array(removed, pa.int64()), pa.array(digests, pa.string()),
                    pa.array(kept_texts, pa.string())]
        return strip

    return map_texts(found.select("doc_id", "runs", "text"), {
        "doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string",
        "kept_text": "string"}, start)
