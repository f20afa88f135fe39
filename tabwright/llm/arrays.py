"""Words and hashes of whole Arrow text columns as NumPy arrays, without a Python loop over words.

A *word* is a run of bytes other than space and 0x09-0x0D. Nulls count as empty texts. Work goes
through slices of rows of about ``SLICE_BYTES``, so memory follows the longest text, not the batch.
Hashes have 64 bits; equal texts always agree, and different ones are taken to differ.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_CODES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash for each range of ``values`` (64-bit codes), by differences of a running sum."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    found = (total[ends] - total[starts]) * down[starts]
    return mixed(found ^ (ends - starts).astype(np.uint64))


def byte_codes(data: np.ndarray) -> np.ndarray:
    return _CODES[data]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the offsets of the rows in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


@dataclass
class Texts:
    """Some rows of a batch: ``first`` is the first row's place in the batch."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row]:self.offsets[row + 1]].tobytes()


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """Consecutive rows with about ``limit`` bytes in all; a longer text comes alone."""
    data, offsets = text_bytes(column)
    row, last = 0, len(offsets) - 1
    while row < last:
        stop = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        stop = min(max(stop, row + 1), last)
        yield Texts(row, data[offsets[row]:offsets[stop]], offsets[row:stop + 1] - offsets[row])
        row = stop


@dataclass
class Words:
    """Words in row order: byte ranges, the row of each word, and where each row's words begin."""

    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    first: np.ndarray  # one more entry than rows

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(texts: Texts) -> Words:
    data, offsets = texts.data, texts.offsets
    inside = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    begin, last = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | cut[1:-1]
    last[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
    first = np.searchsorted(starts, offsets)
    return Words(starts, ends, np.repeat(np.arange(texts.rows), np.diff(first)), first)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def word_hashes(data: np.ndarray, words: Words) -> np.ndarray:
    return range_hashes(byte_codes(data), words.starts, words.ends)


def grams(codes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n codes inside each row, in order, and where each row's runs begin."""
    up = powers(n)[0]
    size = max(len(codes) - n + 1, 0)
    total = np.zeros(size, np.uint64)
    for j in range(n):
        total += codes[j:j + size] * up[j]
    counts = np.maximum(np.diff(first) - (n - 1), 0)
    begins = np.concatenate([[0], np.cumsum(counts)])
    places = np.arange(begins[-1]) + np.repeat(first[:-1] - begins[:-1], counts)
    return mixed(total[places] + np.uint64(n)), begins


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of every range, one range after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
