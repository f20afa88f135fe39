"""Benchmark decontamination: which documents hold which test items.

The items of ``benchmark`` are the query set; they go over all documents in blocks of ``BLOCK_CHARS``
characters of text. Items are partitioned by size: class c holds those of up to 2**c shingles, repeats included. For each
class in use the documents are cut into windows of 2 * 2**c shingles that begin every 2**c, so an item
of the class lies whole in some window of a like size, however long the document is. Windows and items
that agree in one of ``HASHES`` MinHash values are candidates; the distinct shingles of the item that
occur anywhere in the document are then counted exactly. An item of which 0.8 is in a window has a
similarity of 0.19 or more with it, which all 64 values miss with probability 2e-6.

Words are compared in lower case without punctuation at their ends. Defined cases: items and documents
without words match nothing; an item of fewer than five words matches where all its words stand in a
row; null ids are kept as they are; repeated rows give repeated rows; no items give no rows.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.arrays import Texts, Words, byte_codes, grams, lower_ascii, range_hashes, slices, words_of
from tabwright.llm.rows import extend_texts, free_name, map_texts
from tabwright.llm.shingles import WORDS, seeds

HASHES = 64
CONTAINMENT = (4, 5)
BLOCK_CHARS = 1 << 24
_EDGE = np.zeros(256, bool)
_EDGE[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
RESULT = {"doc_id": "bigint", "item_id": "bigint", "n_item_shingles": "bigint", "n_found": "bigint",
          "containment": "double"}


def _codes(texts: Texts) -> tuple[np.ndarray, Words]:
    """A hash for each word in lower case, ASCII punctuation at its ends taken off; bare punctuation goes."""
    data = lower_ascii(texts.data)
    words = words_of(texts)
    plain = np.flatnonzero(~_EDGE[data])
    low, high = np.searchsorted(plain, words.starts), np.searchsorted(plain, words.ends)
    kept = high > low
    starts, ends = plain[low[kept]], plain[high[kept] - 1] + 1
    row = words.row[kept]
    first = np.searchsorted(row, np.arange(texts.rows + 1))
    return range_hashes(byte_codes(data), starts, ends), Words(starts, ends, row, first)


class Index:
    """The items of one block: MinHash tables by size class, and their shingles."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [item for item, _ in items]
        self.shingles: list[np.ndarray] = []
        self.length = np.zeros(len(items), np.int64)
        places = np.zeros(len(items), np.int64)
        for texts in slices(pa.array([text for _, text in items], pa.string())):
            codes, words = _codes(texts)
            for row in range(texts.rows):
                own = codes[words.first[row]:words.first[row + 1]]
                n = min(len(own), WORDS)
                self.length[len(self.shingles)] = n
                found = grams(own, np.array([0, len(own)]), n)[0] if n else np.zeros(0, np.uint64)
                places[len(self.shingles)] = len(found)
                self.shingles.append(np.unique(found))
        self.flips, self.factors = seeds(HASHES)
        classes = defaultdict(list)
        for item, found in enumerate(self.shingles):
            if len(found):
                classes[(int(self.length[item]), int(places[item] - 1).bit_length())].append(item)
        self.classes = {}
        for key, members in classes.items():
            values = np.array([[v.min() for v in self._values(self.shingles[m])] for m in members])
            tables = []
            for i in range(HASHES):
                order = np.argsort(values[:, i], kind="stable")
                tables.append((values[order, i], np.array(members)[order]))
            self.classes[key] = tables

    def _values(self, hashes: np.ndarray):
        base = (hashes >> np.uint64(32)).astype(np.uint32)
        for i in range(HASHES):
            yield (base ^ self.flips[i]) * self.factors[i]

    def search(self, codes: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
        """(row, item, shingles of the item found in the row) for the rows that hold an item."""
        found = []
        for n in sorted({n for n, _ in self.classes}):
            hashes, begins = grams(codes, first, n)
            pairs = set()
            for (length, size), tables in self.classes.items():
                if length == n:
                    pairs |= self._candidates(hashes, begins, 1 << size, tables)
            by_row = defaultdict(list)
            for row, item in sorted(pairs):
                by_row[row].append(item)
            for row, items in by_row.items():
                own = np.unique(hashes[begins[row]:begins[row + 1]])
                for item in items:
                    at = np.searchsorted(own, self.shingles[item])
                    at[at == len(own)] = 0
                    both = int((own[at] == self.shingles[item]).sum())
                    if both * CONTAINMENT[1] >= len(self.shingles[item]) * CONTAINMENT[0]:
                        found.append((row, item, both))
        return sorted(found)

    def _candidates(self, hashes, begins, step, tables) -> set[tuple[int, int]]:
        """Windows are pairs of neighbouring steps: the least value of a window is that of its two steps."""
        counts = np.diff(begins)
        rows = np.flatnonzero(counts)
        if not len(rows):
            return set()
        parts = -(-counts[rows] // step)
        last = np.cumsum(parts) - 1
        first = last - parts + 1
        owner = np.repeat(rows, parts)
        starts = np.repeat(begins[rows] - first * step, parts) + np.arange(len(owner)) * step
        final = np.zeros(len(owner), bool)
        final[last] = True
        pairs = set()
        for values, (keys, items) in zip(self._values(hashes), tables):
            least = np.minimum.reduceat(values, starts)
            following = np.append(least[1:], least[-1:])
            window = np.where(final, least, np.minimum(least, following))
            low, high = np.searchsorted(keys, window), np.searchsorted(keys, window, "right")
            for w in np.flatnonzero(high > low):
                pairs.update((int(owner[w]), int(item)) for item in items[low[w]:high[w]])
        return pairs


def blocks_of(items: DataFrame):
    """The items, in blocks that are read one after the other."""
    named = items.select(F.col("item_id").cast("bigint"), "text").where("length(text) > 0")
    total = named.agg(F.sum(F.length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_CHARS))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for block in range(blocks):
        found = named.where(part == block).orderBy("item_id", "text").collect()
        if found:
            yield [(r["item_id"], r["text"]) for r in found]


def uncontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, with their columns, that hold no item."""
    names = docs.columns
    flag = free_name(docs, "contaminated")
    kept = docs
    for block in blocks_of(items):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def start(shared=shared):
            index = Index(shared.value)

            def search(texts, _):
                codes, words = _codes(texts)
                found = np.zeros(texts.rows, bool)
                found[[row for row, _, _ in index.search(codes, words.first)]] = True
                return [pa.array(found)]
            return search

        kept = extend_texts(kept, {flag: "boolean"}, start).where(~F.col(flag)).select(*names)
    return kept


def contained_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each document and item of which at least the share CONTAINMENT is in the document."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text")
    result = None
    for block in blocks_of(items):
        shared = spark.sparkContext.broadcast(block)

        def start(shared=shared):
            index = Index(shared.value)

            def search(texts, rows):
                codes, words = _codes(texts)
                found = index.search(codes, words.first)
                ids = rows.column("doc_id").take(pa.array([r for r, _, _ in found], pa.int64()))
                sizes = [len(index.shingles[i]) for _, i, _ in found]
                return [ids, pa.array([index.ids[i] for _, i, _ in found], pa.int64()),
                        pa.array(sizes, pa.int64()), pa.array([n for _, _, n in found], pa.int64()),
                        pa.array([n / s for (_, _, n), s in zip(found, sizes)], pa.float64())]
            return search

        part = map_texts(texts, RESULT, start)
        result = part if result is None else result.unionAll(part)
    if result is None:
        return spark.createDataFrame([], ", ".join(f"{n} {k}" for n, k in RESULT.items()))
    return result
