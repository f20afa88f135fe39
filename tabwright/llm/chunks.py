"""Encoding whole texts with the tokenizers library, each different chunk about once.

A chunk is white space and the run after it. Where a tokenizer never joins characters across the start of
such a chunk, the ids of a text are those of its chunks one after the other, and there are far fewer
different chunks than chunks.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa

from tabwright.llm.arrays import byte_codes, ragged, range_hashes, text_bytes

SLICE_BYTES, BATCH, JOINED, REMEMBERED = 1 << 21, 1 << 12, 1 << 6, 1 << 19
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def limit_threads(number: int = 2) -> None:
    """Threads of the library in this worker; each one keeps memory of its own. Only the first call counts."""
    os.environ.setdefault("RAYON_NUM_THREADS", str(number))


def white_space_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where ASCII white space follows a character that is no white space, also in Unicode."""
    white = _WHITE[data]
    found = white.copy()
    found[1:] &= ~white[:-1]
    found[:1] = False
    at = np.flatnonzero(found)
    one, two, three = (data[np.maximum(at - k, 0)] for k in (1, 2, 3))
    wide = (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
    wide |= (three == 0xE2) & ((two == 0x80) | (two == 0x81))
    wide |= ((three == 0xE1) & (two == 0x9A)) | ((three == 0xE3) & (two == 0x80))
    found[at[wide]] = False
    return _with_rows(found, offsets)


def _with_rows(found: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    found[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(found)


def space_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where a space follows another character."""
    space = data == 32
    found = space.copy()
    found[1:] &= ~space[:-1]
    return _with_rows(found, offsets)


def split(data: np.ndarray, starts: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """The different chunks, and the number of each chunk in that list."""
    if len(data) >= 1 << 31:
        raise ValueError("a text of 2 GB or more")
    bounds = pa.py_buffer(np.append(starts, len(data)).astype(np.int32))
    coded = pa.StringArray.from_buffers(len(starts), bounds, pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()


class Encoder:
    """Encodes texts chunk by chunk and remembers up to ``REMEMBERED`` (or ``remembered``) chunks by their 64-bit hash.

    Unknown chunks go through the tokenizer joined, since each call and each result costs more than the
    chunk; where ``token_bytes``, the bytes that each id stands for, show that the ids don't end where the
    chunks end, the chunks go one by one. ``check`` gives a table (checks, texts) of what went wrong with some
    texts; where something did, it is asked for each chunk. Workers keep an encoder for the next task; when
    it is full it starts anew, which costs time but changes nothing.
    """

    def __init__(self, tokenize: Callable[[list[str]], list[list[int]]], token_bytes: np.ndarray | None = None,
                 check: Callable[[list[str], list[list[int]]], np.ndarray] | None = None, checks: int = 0,
                 remembered: int | None = None):
        self.tokenize, self.token_bytes, self.check, self.checks = tokenize, token_bytes, check, checks
        self.remembered = remembered or REMEMBERED
        self._forget()

    def _tokenized(self, texts: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of ids of each text (of so many bytes), all ids, and the table of checks."""
        if self.token_bytes is not None and len(texts) > 1:
            parts = ["".join(texts[at:at + JOINED]) for at in range(0, len(texts), JOINED)]
            lists = self.tokenize(parts)
            flat = np.fromiter(chain.from_iterable(lists), np.int32)
            ends = np.concatenate([[0], np.cumsum(self.token_bytes[flat])])
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            at = np.minimum(np.searchsorted(ends, bounds), len(flat))
            if (ends[at] == bounds).all() and not (self.check and self.check(parts, lists).any()):
                return np.diff(at).astype(np.int32), flat, np.zeros((self.checks, len(texts)), bool)
        lists = self.tokenize(texts)
        sizes = np.fromiter(map(len, lists), np.int32, len(lists))
        wrong = self.check(texts, lists) if self.check else np.zeros((0, len(texts)), bool)
        return sizes, np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum())), wrong

    def _forget(self) -> None:
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.begins, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat, self.wrong = np.zeros(0, np.int32), np.zeros((self.checks, 0), bool)

    def _learn(self, hashes: np.ndarray, chunks: pa.StringArray) -> None:
        """Remember chunks in ascending order of their hashes."""
        sizes, flat, wrong = [self.sizes], [self.flat], [self.wrong]
        lengths = np.diff(text_bytes(chunks)[1])
        for at in range(0, len(chunks), BATCH):
            texts = chunks.slice(at, BATCH).to_pylist()
            for held, new in zip((sizes, flat, wrong), self._tokenized(texts, lengths[at:at + BATCH])):
                held.append(new)
        known = len(self.sizes)
        self.sizes, self.flat, self.wrong = np.concatenate(sizes), np.concatenate(flat), np.hstack(wrong)
        self.begins = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
        at = np.searchsorted(self.keys, hashes)
        self.keys = np.insert(self.keys, at, hashes)
        self.place = np.insert(self.place, at, known + np.arange(len(hashes)))

    def _missing(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.arange(len(hashes))
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.flatnonzero(self.keys[at] != hashes)

    def encode(self, data: np.ndarray, offsets: np.ndarray, starts: np.ndarray):
        """Ids of all texts, where each text's begin, and for each text how many chunks fail each check."""
        different, chunk = split(data, starts)
        letters, bounds = text_bytes(different)
        hashes = range_hashes(byte_codes(letters), bounds[:-1], bounds[1:])
        order = np.argsort(hashes)  # sorted keys are found faster
        hashes = hashes[order]
        missing = self._missing(hashes)
        if len(self.keys) + len(missing) > self.remembered:
            self._forget()
            missing = np.arange(len(hashes))
        if len(missing):
            self._learn(hashes[missing], different.take(pa.array(order[missing])))
        place = np.zeros(len(order), np.int64)
        if len(order):
            place[order] = self.place[np.searchsorted(self.keys, hashes)]
        ids, ends = _joined(self.flat, self.begins[place], self.sizes[place].astype(np.int64), chunk)
        first = np.searchsorted(starts, offsets)
        failed = [np.diff(np.concatenate([[0], np.cumsum(w[place][chunk])])[first]) for w in self.wrong]
        return ids, ends[first], failed


def _joined(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``flat`` (int32) with the wanted numbers, one after the other, and where they begin and end."""
    bounds = np.concatenate([[0], np.cumsum(sizes)]) * 4
    parts = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(flat[ragged(begins, sizes)])])
    found = parts.take(pa.array(wanted))
    data, ends = found.buffers()[2], np.frombuffer(found.buffers()[1], np.int64)[:len(wanted) + 1] >> 2
    return np.frombuffer(data, np.int32, int(ends[-1])) if data else np.zeros(0, np.int32), ends


_encoders: dict[str, Encoder] = {}


def kept_encoder(name: str, make: Callable[[], Encoder]) -> Encoder:
    """The worker's encoder of that name."""
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = make()
    return _encoders[name]
