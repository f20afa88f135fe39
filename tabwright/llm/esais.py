"""Suffix and common-prefix arrays of a shard by external induced sorting, and removal of repeated bytes.

Suffixes are S (smaller than the next one) or L. The leftmost S suffixes are put in order first: their
substrings by one induction, then, where names repeat, the string of names by recursion (in memory once it
is short). A second induction yields all suffixes: scanning sorted suffixes in rising order pushes the L
suffix in front of each one to the queue of its first byte, scanning in falling order pushes the S ones.
What is pushed to one bucket is in order already, so the priority queue is a list of runs for each
bucket. A tuple carries the suffix and its common prefix with the one pushed before: one more than the
least common prefix scanned in between. Beyond ``QUEUE_BYTES`` the runs go to an unnamed file of the task,
in the folder where Spark itself spills.
"""

from __future__ import annotations

import hashlib
import os
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabwright.llm.arrays import Texts, byte_codes, mixed, powers, range_hashes
from tabwright.llm.fmindex import suffix_order
from tabwright.llm.repeats import Method, covered, repeated_windows, with_or_without_places
from tabwright.llm.rows import map_texts
from tabwright.plans import storage

WINDOW, GRAM = 200, 32
CAP = np.int32(WINDOW)
QUEUE_BYTES = 64 << 20
NAMES_IN_MEMORY = 1 << 21


class BucketQueue:
    """Suffixes with common prefixes in a first-in first-out run for each bucket, spilled when large."""

    def __init__(self):
        self.limit, self.size, self.file = QUEUE_BYTES, 0, None
        self.held: dict[int, list] = {}

    def push(self, bucket: int, suffixes: np.ndarray, prefixes: np.ndarray) -> None:
        self.held.setdefault(bucket, []).append((suffixes, prefixes))
        self.size += suffixes.nbytes + prefixes.nbytes
        if self.size > self.limit:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
            self.file = tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None)
        self.file.seek(0, os.SEEK_END)
        for bucket, runs in self.held.items():
            kept = []
            for run in runs:
                if isinstance(run[0], np.ndarray):
                    place = self.file.tell()
                    self.file.write(run[0].tobytes())
                    self.file.write(run[1].tobytes())
                    run = (place, len(run[0]))
                kept.append(run)
            self.held[bucket] = kept
        self.size = 0

    def pop(self, bucket: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Everything that waits in the bucket."""
        runs = self.held.pop(bucket, None)
        if not runs:
            return None
        found = []
        for run in runs:
            if not isinstance(run[0], np.ndarray):
                place, n = run
                self.file.seek(place)
                run = (np.frombuffer(self.file.read(8 * n), np.int64), np.frombuffer(self.file.read(4 * n), np.int32))
            else:
                self.size -= run[0].nbytes + run[1].nbytes
            found.append(run)
        return np.concatenate([r[0] for r in found]), np.concatenate([r[1] for r in found])


class _Ranges:
    """Least values of ranges of one array, by a table of powers of two."""

    def __init__(self, values: np.ndarray):
        self.table = [values]
        while 2 << len(self.table) - 1 <= len(values):
            half = 1 << len(self.table) - 1
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least of values[low:high], for non-empty ranges."""
        width = np.frexp((high - low).astype(float))[1] - 1
        found = np.empty(len(low), np.int32)
        for level in np.unique(width):
            here = width == level
            table = self.table[level]
            found[here] = np.minimum(table[low[here]], table[high[here] - (1 << int(level))])
        return found


class Induction:
    """Suffix order of a text whose last code is its only least one, from the order of its leftmost S suffixes."""

    def __init__(self, text: np.ndarray):
        self.text = text
        n = len(text)
        stops = np.append(np.flatnonzero(text[1:] != text[:-1]) + 1, n)
        lengths = np.diff(np.append(0, stops))
        self.left = np.repeat(stops, lengths) - np.arange(n)  # length of the run from here on
        rising = np.append(text[stops[:-1]] > text[stops[:-1] - 1], True)
        self.small = np.repeat(rising, lengths)
        self.starts = np.flatnonzero(self.small[1:] & ~self.small[:-1]) + 1
        self.buckets = np.flatnonzero(np.bincount(text))
        self.narrow = int(self.buckets[-1]) < 1 << 16  # codes of 16 bits are sorted by radix

    def _scan(self, queue, state, suffixes, prefixes, small: bool) -> None:
        """Push the suffixes in front of the scanned ones that are of the wanted type."""
        running, begun = state
        front = suffixes - 1
        at = np.flatnonzero((suffixes > 0) & (self.small[front] == small))
        whole = prefixes.min() if self.prefixed else CAP
        if not len(at):
            np.minimum(running, whole, out=running)
            return
        code = self.text[front[at]]
        order = np.argsort(code.astype(np.uint16) if self.narrow else code, kind="stable")
        at, code = at[order], code[order]
        cuts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        ends = np.append(cuts[1:], len(code))
        if not self.prefixed:
            for bucket, low, high in zip(code[cuts].tolist(), cuts.tolist(), ends.tolist()):
                queue.push(bucket, front[at[low:high]], prefixes[:high - low])
            return
        found = np.empty(len(at), np.int32)
        ranges = _Ranges(prefixes)
        inner = np.ones(len(at), bool)
        inner[cuts] = False
        inner = np.flatnonzero(inner)
        found[inner] = ranges.least(at[inner - 1] + 1, at[inner] + 1)
        here = code[cuts]
        found[cuts] = np.minimum(running[here], np.minimum.accumulate(prefixes)[at[cuts]])
        found += 1
        found[cuts[~begun[here]]] = 0
        np.minimum(found, CAP, out=found)
        begun[here] = True
        np.minimum(running, whole, out=running)
        last = at[ends - 1]
        tail = np.append(np.minimum.accumulate(prefixes[::-1])[::-1], CAP)
        running[here] = tail[last + 1]
        for bucket, low, high in zip(here.tolist(), cuts.tolist(), ends.tolist()):
            queue.push(bucket, front[at[low:high]], found[low:high])

    def run(self, starts: np.ndarray, prefixes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """All suffixes, and the common prefix of each one with the one before (at most CAP).

        Without the prefixes of the start those of the result mean nothing.
        """
        self.prefixed = prefixes is not None
        if prefixes is None:
            prefixes = np.zeros(len(starts), np.int32)
        size = int(self.buckets[-1]) + 1
        bounds = np.searchsorted(self.text[starts], np.append(self.buckets, size))

        def fresh():
            return BucketQueue(), (np.full(size, CAP, np.int32), np.zeros(size, bool))

        none = (np.zeros(0, np.int64), np.zeros(0, np.int32))
        queue, state = fresh()
        large: dict[int, tuple] = {}
        for i, bucket in enumerate(self.buckets.tolist()):
            parts = []
            while got := queue.pop(bucket):
                self._scan(queue, state, *got, small=False)
                parts.append(got)
            large[bucket] = tuple(np.concatenate(x) for x in zip(*parts)) if parts else none
            own, common = starts[bounds[i]:bounds[i + 1]], prefixes[bounds[i]:bounds[i + 1]].copy()
            if len(own):
                before = large[bucket][0]
                common[0] = min(self.left[before[-1]], self.left[own[0]], CAP) if len(before) else 0
                self._scan(queue, state, own, common, small=False)
        queue, state = fresh()
        done = []
        for bucket in self.buckets[::-1].tolist():
            parts = []
            while got := queue.pop(bucket):
                self._scan(queue, state, *got, small=True)
                parts.append(got)
            small = tuple(np.concatenate(x) for x in zip(*parts)) if parts else none
            if bucket == 0:
                small = (np.array([len(self.text) - 1]), np.zeros(1, np.int32))
            own, common = large[bucket]
            if len(own):
                joint = min(self.left[small[0][-1]], self.left[own[-1]], CAP) if len(small[0]) else 0
                self._scan(queue, state, own[::-1], np.append(np.int32(joint), common[:0:-1]), small=True)
            if len(small[0]):
                joint = min(self.left[small[0][-1]], self.left[own[-1]], CAP) if len(own) else 0
                done.append((small[0][::-1], np.append(np.int32(joint), small[1][:0:-1])))
            done.append((own, common))
        return np.concatenate([x[0] for x in done[::-1]]), np.concatenate([x[1] for x in done[::-1]])


def _common(text: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The common prefix, at most CAP, of suffixes, by halving over hashes of ranges."""
    codes = mixed(text.astype(np.uint64) + np.uint64(1))
    up, down = powers(len(text) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(codes * up[:-1], dtype=np.uint64)])
    room = np.minimum(len(text) - np.maximum(one, two), CAP)
    length, step = np.zeros(len(one), np.int64), 1 << int(CAP).bit_length() - 1
    while step:
        wanted = length + step
        fits = wanted <= room
        reach = np.where(fits, wanted, 0)
        same = (total[one + reach] - total[one]) * down[one] == (total[two + reach] - total[two]) * down[two]
        length = np.where(fits & same, wanted, length)
        step >>= 1
    return length.astype(np.int32)


def sorted_suffixes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and common prefixes (at most CAP) of non-negative codes; the last one is 0 and the only 0."""
    work = Induction(text)
    starts = work.starts
    by_code = starts[np.argsort(text[starts], kind="stable")]
    order, _ = work.run(by_code, None)
    leftmost = np.zeros(len(text), bool)
    leftmost[starts] = True
    order = order[leftmost[order]]
    following = np.append(starts[1:] + 1, len(text))
    content = range_hashes(mixed(text.astype(np.uint64) + np.uint64(1)), starts, following)
    place = np.empty(len(text), np.int64)
    place[starts] = np.arange(len(starts))
    ranked = content[place[order]]
    new = np.append(True, ranked[1:] != ranked[:-1])
    if not new.all():
        names = np.empty(len(starts), np.int64)
        names[place[order]] = np.cumsum(new) - 1
        shorter = suffix_order(names) if len(names) <= NAMES_IN_MEMORY else sorted_suffixes(names)[0]
        order = starts[shorter]
    prefixes = np.append(np.int32(0), _common(text, order[:-1], order[1:]))
    return work.run(order, prefixes)


def shared_windows(codes: np.ndarray, begins: np.ndarray, order: np.ndarray) -> list[tuple[int, int, int]]:
    """(segment, first window, last window) for the windows of bytes that are in the shard more than once."""
    counts = np.diff(begins)
    owner = np.repeat(np.arange(len(counts)), counts)
    text = np.ones(len(codes) + len(counts) + 1, np.int64)  # 1 ends a segment, 0 the shard
    text[np.arange(len(codes)) + owner] = codes.astype(np.int64) + 2
    text[-1] = 0
    suffixes, prefixes = sorted_suffixes(text)
    long = prefixes >= WINDOW
    marked = np.zeros(len(text) + 1, bool)
    marked[suffixes[long]] = True
    marked[suffixes[:-1][long[1:]]] = True
    offsets = begins[:-1] + np.arange(len(counts))
    room = np.zeros(len(marked), bool)  # where a window fits into its segment
    room[np.arange(len(codes)) + owner] = np.arange(len(codes)) - begins[owner] + WINDOW <= counts[owner]
    marked &= room
    first = np.flatnonzero(marked & ~np.append(False, marked[:-1]))
    last = np.flatnonzero(marked & ~np.append(marked[1:], False))
    segment = np.searchsorted(offsets, first, "right") - 1
    return list(zip(segment.tolist(), (first - offsets[segment]).tolist(), (last - offsets[segment]).tolist()))


def _byte_codes(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    return byte_codes(texts.data), texts.offsets


BYTES = Method(_byte_codes, shared_windows, WINDOW, GRAM, "anywhere", lambda texts: texts.data)


def without_repeated_bytes(docs: DataFrame) -> DataFrame:
    """Remove each byte of a string of ``WINDOW`` bytes that also starts at any other place.

    Gives doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and kept (the remaining
    bytes) for each document. Defined cases: a null text is empty; shorter texts lose nothing; repeated rows
    are different places, so both lose what they share.
    """
    runs = storage.written(repeated_windows(docs, BYTES), "repeats")
    found = with_or_without_places(docs, runs)

    def start():
        def strip(texts, rows):
            removed, spans, digests, kept = [], [], [], []
            for row, runs in enumerate(rows.column("runs").to_pylist()):
                data = texts.data[texts.offsets[row]:texts.offsets[row + 1]]
                gone = covered(runs or (), len(data), WINDOW)
                removed.append(int(gone.sum()))
                spans.append(int((gone & ~np.append(False, gone[:-1])).sum()) if len(gone) else 0)
                kept.append(data[~gone].tobytes())
                digests.append(hashlib.sha256(kept[-1]).hexdigest())
            return [rows.column("doc_id"), np.diff(texts.offsets), pa.array(removed, pa.int64()),
                    pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary())]
        return strip

    return map_texts(found.select("doc_id", "runs", "text"), {
        "doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint",
        "kept_sha256": "string", "kept": "binary"}, start)
