"""An adaptive context-mixing range coder for token ids, many blocks side by side.

The ids of a record are cut into blocks, at most ``BLOCK_IDS`` long and shorter in a small record, so that a step of the
coder always works on many of them. Every block starts from the record's order-0 table and empty contexts, carries a
checksum and can be read alone with that table. An id is coded in one step from a mixture of three predictions:

* order 2 and order 1: the id that followed the same (hashed) context last time, with the share of times
  this was right;
* order 0: how often the ids occur in the record. The table is part of the record; ids that occur once or that have no
  room in it follow as plain bits.

Each context prediction is weighted by its success in the block so far, renewed every ``SPAN`` steps. All arithmetic is
in integers. The coder keeps 64 bits of range and writes 32-bit words; NumPy arrays hold one block (lane) per entry.
Encoder and decoder take the same steps with the same model, so both follow from the same past.

A record holds whole documents: header, document ids and lengths, block directory, order-0 table, payloads.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK_IDS = 1 << 14
SHORT_IDS = 1 << 10
ID_BITS = 20
TOTAL_BITS = 24
SLOT_BITS = 17
LANES = 4096
SPAN = 32
MAGIC = b"TWIDS\x00\x00\x02"
_SLOTS = 1 << SLOT_BITS
_ROOM = _SLOTS // 2  # ids in the table of order 0
_WHOLE = 1 << TOTAL_BITS
_ORDER0 = 1 << 10
_CONTEXT_BITS = (12, 13)  # the most for the contexts of order 1 and 2
_MIXED = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)

# a context in 32 bits: the id that followed plus 1, times right and times seen, which are halved at the end of their bits
_TIMES_BITS = 5
_COUNTS = np.arange(1 << 2 * _TIMES_BITS)
_COUNT_BITS = np.int32(2 * _TIMES_BITS)


def _counted() -> tuple[np.ndarray, np.ndarray]:
    """For all counts: the share of times right in 1/4096 (0 if never seen), and the counts after a miss and a hit."""
    hits, times = _COUNTS >> _TIMES_BITS, _COUNTS & (1 << _TIMES_BITS) - 1
    share = np.where(times > 0, ((2 * hits + 1) << 12) // (2 * times + 3), 0)
    full = times == (1 << _TIMES_BITS) - 1
    hits, times = np.where(full, hits >> 1, hits), np.where(full, times >> 1, times)
    after = [hits + right << _TIMES_BITS | times + 1 for right in (0, 1)]
    return share.astype(np.int32), np.concatenate(after).astype(np.int32)


_SHARE, _AFTER = _counted()


class _Model:
    """The contexts of all lanes and their weights; arrays hold order 1 of all lanes and then order 2."""

    def __init__(self, lanes: int, steps: int):
        one, two = (min(most, max(steps - 1, 1).bit_length() + order) for order, most in enumerate(_CONTEXT_BITS))
        self.shifts = np.array([[32 - one], [32 - two]], np.uint32)
        lane = np.arange(lanes)
        self.base = np.stack([lane << one, (lanes << one) + (lane << two)])
        self.known = np.zeros((lanes << one) + (lanes << two), np.int32)
        self.hashes = np.empty((2, lanes), np.uint32)
        self.right, self.tried = np.zeros((2, lanes), np.int32), np.zeros((2, lanes), np.int32)
        self.last = self.before = np.zeros(lanes, np.uint32)
        self.step = 0

    def _weigh(self) -> None:
        weights = ((self.right + 1) << 12) // (self.tried + 2)
        self.factors = ((weights << 12) // (_ORDER0 + weights[0] + weights[1])).astype(np.int32)

    def predict(self):
        """The guesses of order 1 and 2 (-1 if none), the range of order 2 and that of both; equal guesses share it."""
        if self.step % SPAN == 0:
            self._weigh()
        self.step += 1
        np.multiply(self.last, _MIXED[0], out=self.hashes[0])
        np.add(self.hashes[0], self.before * _MIXED[1], out=self.hashes[1])
        self.places = (self.base + (self.hashes >> self.shifts)).ravel()
        states = self.known.take(self.places).reshape(2, -1)
        self.counts = states & (1 << _COUNT_BITS) - 1
        self.guesses = (states >> _COUNT_BITS) - 1
        masses = (self.factors * _SHARE.take(self.counts)).astype(np.int64)
        front = masses[0] + masses[1]
        one, two = self.guesses
        return one, two, np.where(one == two, front, masses[1]), front

    def learn(self, ids: np.ndarray) -> None:
        """Take the step's ids (int32)."""
        same = self.guesses == ids
        counts = _AFTER.take(same.astype(np.int32) << _COUNT_BITS | self.counts)
        self.known[self.places] = (ids + 1 << _COUNT_BITS | counts).ravel()
        self.right += same
        self.tried += self.guesses >= 0
        self.before, self.last = self.last, ids.view(np.uint32)


class _Order0:
    """How often the ids of a record occur, in ``_SLOTS`` parts; the last entry (id -1) stands for all others."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, plain_bits: int):
        self.ids, self.counts, self.plain_bits = ids.astype(np.int64), counts.astype(np.int64), plain_bits
        counts = np.append(self.counts, _SLOTS - self.counts.sum())
        below = np.cumsum(counts) - counts
        self.entries = (np.append(self.ids, -1) << SLOT_BITS | below) << SLOT_BITS + 1 | counts

    @classmethod
    def of(cls, ids: np.ndarray) -> _Order0:
        times = np.bincount(ids, minlength=1)
        known = np.flatnonzero(times > 1)
        if len(known) > _ROOM:
            known = np.sort(known[np.argsort(-times[known], kind="stable")[:_ROOM]])
        times = times[known]
        total = int(times.sum())
        # every id has at least one part, at the cost of the others
        left = _SLOTS - min(max(_SLOTS * (len(ids) - total) // max(len(ids), 1), 1), _SLOTS - len(known))
        rare = np.count_nonzero(times * (left - len(known)) < total)
        counts = np.maximum(times * (left - rare) // max(total, 1), 1)
        return cls(known, counts, max(int(ids.max(initial=0)).bit_length(), 1))

    @classmethod
    def from_bytes(cls, data: bytes) -> _Order0:
        values = np.frombuffer(zlib.decompress(data[1:]), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
        gaps, counts = values.reshape(2, -1)
        return cls(np.cumsum(gaps, dtype=np.int64) - 1, counts, data[0])

    def to_bytes(self) -> bytes:
        values = np.concatenate([np.diff(self.ids, prepend=-1), self.counts]).astype("<u4")
        return bytes([self.plain_bits]) + zlib.compress(values.view(np.uint8).reshape(-1, 4).T.tobytes())

    def by_id(self) -> np.ndarray:
        found = np.full(1 << self.plain_bits, self.entries[-1])
        found[self.ids] = self.entries[:-1]
        return found

    def by_slot(self) -> np.ndarray:
        return np.repeat(self.entries, self.entries & 2 * _SLOTS - 1)


def _range(entry: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and width of entries of order 0 in their part of the range."""
    below = entry >> SLOT_BITS + 1 & _SLOTS - 1
    start = below * rest >> SLOT_BITS
    return start, ((below + (entry & 2 * _SLOTS - 1)) * rest >> SLOT_BITS) - start


class _Encoder:
    """Ranges of all lanes; ``put`` codes one step in some of them."""

    def __init__(self, lanes: int, words: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
        self.begin = np.arange(lanes) * words
        self.out, self.at = np.zeros(lanes * words, np.uint32), self.begin.copy()

    def put(self, lanes, start: np.ndarray, size: np.ndarray) -> None:
        unit = self.range[lanes] >> np.uint64(TOTAL_BITS)
        old = self.low[lanes]
        low, width = old + start.view(np.uint64) * unit, size.view(np.uint64) * unit
        over = low < old
        if over.any():
            for at in (self.at[lanes][over] - 1).tolist():
                while self.out[at] == 0xFFFFFFFF:
                    self.out[at] = 0
                    at -= 1
                self.out[at] += 1
        due = width < np.uint64(1 << 32)
        at = self.at[lanes]
        self.out[at] = low >> np.uint64(32)  # counts only where due, else the next word takes its place
        self.at[lanes] = at + due
        shift = due.astype(np.uint64) << np.uint64(5)
        self.low[lanes], self.range[lanes] = low << shift, width << shift

    def finish(self) -> list[bytes]:
        self.out[self.at], self.out[self.at + 1] = self.low >> np.uint64(32), self.low & np.uint64(0xFFFFFFFF)
        return [self.out[a:b + 2].tobytes() for a, b in zip(self.begin, self.at)]


def _encode_lanes(ids: np.ndarray, table: _Order0, longest: int) -> list[bytes]:
    """Payloads of blocks, one for each column."""
    steps, lanes = ids.shape
    coder, model = _Encoder(lanes, 3 * steps // 2 + 8), _Model(lanes, longest)  # at most 24 + 20 bits an id
    entries, spare = table.by_id(), TOTAL_BITS - table.plain_bits
    every = slice(None)
    for found in ids:
        one, two, second, front = model.predict()
        entry = entries.take(found)
        start, width = _range(entry, _WHOLE - front)
        by_two, by_one = (two == found) & (second > 0), (one == found) & (front > second)
        start = np.where(by_two, 0, np.where(by_one, second, start + front))
        width = np.where(by_two, second, np.where(by_one, front - second, width))
        coder.put(every, start, width)
        new = np.flatnonzero((entry < 0) & ~(by_two | by_one))
        if len(new):
            coder.put(new, found[new].astype(np.int64) << spare, np.full(len(new), 1 << spare))
        model.learn(found)
    return coder.finish()


class _Decoder:
    def __init__(self, payloads: list[bytes], steps: int):
        # words past the end only arise for damaged data, which the checksum then reports
        self.words = np.frombuffer(b"".join([*payloads, bytes(8 * steps + 8)]), np.uint32).astype(np.uint64)
        self.at = np.cumsum([0] + [len(p) // 4 for p in payloads[:-1]]) + 2
        self.code = self.words[self.at - 2] << np.uint64(32) | self.words[self.at - 1]
        self.range = np.full(len(payloads), 2**64 - 1, np.uint64)

    def peek(self, lanes) -> tuple[np.ndarray, np.ndarray]:
        unit = self.range[lanes] >> np.uint64(TOTAL_BITS)
        return unit, np.minimum(self.code[lanes] // unit, np.uint64(_WHOLE - 1)).view(np.int64)

    def take(self, lanes, unit: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        code, width = self.code[lanes] - start.view(np.uint64) * unit, size.view(np.uint64) * unit
        due = width < np.uint64(1 << 32)
        at, shift = self.at[lanes], due.astype(np.uint64) << np.uint64(5)
        self.code[lanes], self.range[lanes] = code << shift | self.words.take(at) * due, width << shift
        self.at[lanes] = at + due


def _decode_lanes(payloads: list[bytes], steps: int, table: _Order0, longest: int) -> np.ndarray:
    """The ids of blocks, one for each column."""
    lanes = len(payloads)
    coder, model = _Decoder(payloads, steps), _Model(lanes, longest)
    ids = np.empty((steps, lanes), np.int32)
    slots, spare = table.by_slot(), TOTAL_BITS - table.plain_bits
    every = slice(None)
    for t in range(steps):
        one, two, second, front = model.predict()
        unit, value = coder.peek(every)
        rest = _WHOLE - front
        entry = slots.take(((np.maximum(value - front, 0) + 1 << SLOT_BITS) - 1) // rest)
        start, width = _range(entry, rest)
        by_two, by_context = value < second, value < front
        found = np.where(by_two, two, np.where(by_context, one, entry >> 2 * SLOT_BITS + 1))
        start = np.where(by_two, 0, np.where(by_context, second, start + front))
        width = np.where(by_two, second, np.where(by_context, front - second, width))
        coder.take(every, unit, start, width)
        new = np.flatnonzero(found < 0)
        if len(new):
            unit, value = coder.peek(new)
            plain = value >> spare
            coder.take(new, unit, plain << spare, np.full(len(new), 1 << spare))
            found[new] = plain
        ids[t] = found
        model.learn(ids[t])
    return ids


def _block_sizes(n: int) -> np.ndarray:
    """Lengths of the blocks of a record, equal but for one id."""
    blocks = max(-(-n // BLOCK_IDS), min(LANES, -(-n // SHORT_IDS)))
    return n // max(blocks, 1) + (np.arange(blocks) < n % max(blocks, 1))


def _groups(sizes: np.ndarray):
    """Up to LANES blocks at a time: their numbers, and which places of a table (blocks, steps) hold an id."""
    for at in range(0, len(sizes), LANES):
        part = slice(at, at + LANES)
        yield part, np.arange(sizes[part].max()) < sizes[part, None]


def encode_blocks(ids: np.ndarray) -> tuple[bytes, list[tuple[int, int, bytes]]]:
    """The order-0 table, and (number of ids, crc32, payload) of each block."""
    if len(ids) and int(ids.max()) >= 1 << ID_BITS:
        raise ValueError(f"ids need more than {ID_BITS} bits")
    table, sizes = _Order0.of(ids), _block_sizes(len(ids))
    ends = np.cumsum(sizes)
    found = []
    for part, places in _groups(sizes):
        grid = np.zeros(places.shape, np.int32)
        grid[places] = ids[ends[part][0] - sizes[part][0]:ends[part][-1]]
        payloads = _encode_lanes(np.ascontiguousarray(grid.T), table, int(sizes.max()))
        found += [(int(n), zlib.crc32(row[:n].astype("<u4").tobytes()), p) for n, row, p in zip(sizes[part], grid, payloads)]
    return table.to_bytes(), found


def decode_blocks(table: bytes, blocks: list[tuple[int, int, bytes]]) -> np.ndarray:
    order0, sizes = _Order0.from_bytes(table), np.array([n for n, _, _ in blocks], np.int64)
    found = [np.zeros(0, np.uint32)]
    for part, places in _groups(sizes):
        ids = _decode_lanes([p for _, _, p in blocks[part]], places.shape[1], order0, int(sizes.max()))
        grid = np.ascontiguousarray(ids.T).astype("<u4")
        for i, (row, (n, crc, _)) in enumerate(zip(grid, blocks[part])):
            if zlib.crc32(row[:n].tobytes()) != crc:
                raise ValueError(f"block {part.start + i}: checksum differs")
        found.append(grid[places])
    return np.concatenate(found)


def pack(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A record of whole documents."""
    table, blocks = encode_blocks(ids)
    directory = np.array([(n, crc, len(p)) for n, crc, p in blocks], "<u4").reshape(-1, 3)
    head = MAGIC + struct.pack("<QQQ", len(lengths), len(blocks), len(table))
    body = head + doc_ids.astype("<i8").tobytes() + lengths.astype("<i8").tobytes() + directory.tobytes() + table
    return body + struct.pack("<I", zlib.crc32(body)) + b"".join(p for _, _, p in blocks)


def unpack(record: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, lengths and all ids of a record."""
    at = len(MAGIC) + 24
    if record[:len(MAGIC)] != MAGIC or len(record) < at:
        raise ValueError("not a record of token ids")
    docs, blocks, size = struct.unpack_from("<QQQ", record, len(MAGIC))
    payloads = at + 16 * docs + 12 * blocks + size + 4
    if payloads > len(record) or zlib.crc32(record[:payloads - 4]) != struct.unpack_from("<I", record, payloads - 4)[0]:
        raise ValueError("directory: checksum differs")
    doc_ids = np.frombuffer(record, "<i8", docs, at)
    lengths = np.frombuffer(record, "<i8", docs, at + 8 * docs)
    directory = np.frombuffer(record, "<u4", 3 * blocks, at + 16 * docs).reshape(-1, 3)
    ends = payloads + np.cumsum(directory[:, 2].astype(np.int64))
    found = [(int(n), int(crc), record[e - int(size):e]) for (n, crc, size), e in zip(directory, ends)]
    return doc_ids, lengths, decode_blocks(record[payloads - 4 - size:payloads - 4], found)
