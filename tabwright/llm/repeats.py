"""Finding stretches that occur more than once, for any kind of sequence (words, bytes).

A *window* is ``window`` consecutive codes of one text. Its *anchor* is its leftmost ``gram`` of least
hash, so equal windows have equal anchors at the same place. Neighbouring windows with one anchor form a
*segment*; its content is all that has to be compared, and only with segments of the same anchor:

1. Anchors are counted; those that can't repeat are gone before anything large moves.
2. Equal segments are merged by hash. Their copies are decided by that alone.
3. Different segments of one anchor are *contested*. One sample of each is cut out of its text and sent,
   by anchor, to a shard, where an index finds the windows they share.
4. An anchor with more than ``HOT`` different segments would make a large shard. Its segments are cut
   into blocks of windows, and these into windows, that are counted by hash, so such a group is spread
   over the whole cluster.

``kind`` says what a repeat is: ``earlier`` (also starts in a text with a smaller id) or ``anywhere``.
Null ids count as larger than all others. Rows are told apart by (id, key of the text); repeated rows
count as many times as they are there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.arrays import Texts, mixed, powers, ragged, range_hashes, slices
from tabwright.llm.rows import arrow_schema, ddl, lean, map_texts, text_key
from tabwright.plans import storage

HOT = 64
BLOCK_WINDOWS = 32
SHARD_CODES = 1 << 18  # 64-bit codes; twice as many where a shard holds bytes
BROADCAST_ROWS = 250_000
LAST = (1 << 63) - 1

#: A shard: codes of all segments one after the other, where each begins, and each one's least order.
Shard = tuple[np.ndarray, np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Method:
    """How texts become codes, what repeats are, and the index that finds them in a shard.

    ``search`` gets a shard and gives (segment, first window, last window) for the shared windows. A shard
    holds codes, or bytes if ``stored`` gives these.
    """

    codes: Callable[[Texts], tuple[np.ndarray, np.ndarray]]
    search: Callable[[np.ndarray, np.ndarray, np.ndarray], list[tuple[int, int, int]]]
    window: int
    gram: int
    kind: str
    stored: Callable[[Texts], np.ndarray] | None = None  # what a shard gets in place of the codes


def gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """The hash of every run of n codes, also of those that cross texts."""
    size = max(len(codes) - n + 1, 0)
    up, down = powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[:-1], out=total[1:])
    return mixed((total[n:] - total[:size]) * down[:size] ^ np.uint64(n))


def anchors(codes: np.ndarray, first: np.ndarray, window: int, gram: int):
    """For each segment: row, place of the anchor, hash of the anchor, first and last window."""
    hashes = gram_hashes(codes, gram)
    wide = window - gram + 1
    size = len(codes) - window + 1
    if size <= 0:
        return (np.zeros(0, np.int64),) * 5
    bits = np.uint64(max(24, len(codes).bit_length()))
    least = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    step = 1
    while step * 2 <= wide:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < wide:
        least = np.minimum(least[:len(least) - (wide - step)], least[wide - step:])
    place = (least[:size] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    counts = np.maximum(np.diff(first) - window + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    begins = np.concatenate([[0], np.cumsum(counts)])
    starts = np.arange(begins[-1]) + np.repeat(first[:-1] - begins[:-1], counts)
    place = place[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(starts))[:len(head)] - 1
    return row[head], place[head], hashes[place[head]], starts[head], starts[tail]


def _named(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_key().alias("key"), "text")


def anchor_counts(docs: DataFrame, method: Method) -> DataFrame:
    """The anchors that may repeat."""
    def start():
        def find(texts, rows):
            codes, first = method.codes(texts)
            row, _, anchor, _, _ = anchors(codes, first, method.window, method.gram)
            order = rows.column("doc_id").fill_null(LAST).to_numpy()[row]
            return [anchor.view(np.int64), order]
        return find

    found = map_texts(docs.select("doc_id", "text"), {"anchor": "bigint", "order": "bigint"}, start)
    grouped = found.groupBy("anchor")
    if method.kind == "earlier":
        return grouped.agg(F.min("order").alias("low"), F.max("order").alias("high")).where("low < high").select("anchor")
    return grouped.agg(F.count("*").alias("n")).where("n > 1").select("anchor")


SEGMENT = {"doc_id": "bigint", "key": "bigint", "order": "bigint", "anchor": "bigint", "segment": "bigint",
           "start": "bigint", "windows": "bigint"}


def segments(docs: DataFrame, method: Method) -> DataFrame:
    """All segments of all texts: where the first window starts (in codes of the text), and how many there are."""
    def start():
        def find(texts, rows):
            codes, first = method.codes(texts)
            row, place, anchor, low, high = anchors(codes, first, method.window, method.gram)
            content = range_hashes(codes, low, high + method.window)
            segment = mixed(content + (place - low).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            ids = rows.column("doc_id").take(pa.array(row))
            return [ids, rows.column("key").take(pa.array(row)), ids.fill_null(LAST), anchor.view(np.int64),
                    segment.view(np.int64), low - first[row], high - low + 1]
        return find

    return map_texts(_named(docs), SEGMENT, start)


def with_places(docs: DataFrame, places: DataFrame) -> DataFrame:
    """doc_id, key and text of the rows named in ``places`` (unique doc_id, key) and its other columns.

    The ids go to all executors while there are at most ``BROADCAST_ROWS`` of them, so only the texts
    needed are shuffled; beyond that all are.
    """
    rows, few = _named(docs), places.count() <= BROADCAST_ROWS
    ids = places.select(F.col("doc_id").alias("id"), F.col("key").alias("id_key"))
    if few:
        wanted = F.broadcast(ids)
        rows = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["id"]) & (rows["key"] == wanted["id_key"]), "left_semi")
    other = places.withColumnsRenamed({"doc_id": "id", "key": "id_key"})
    same = rows["doc_id"].eqNullSafe(other["id"]) & (rows["key"] == other["id_key"])
    return rows.join(other, same).drop("id", "id_key")


def with_or_without_places(docs: DataFrame, places: DataFrame) -> DataFrame:
    """All rows (doc_id, key, text), with the other columns of ``places`` or nulls."""
    rows, few = _named(docs), places.count() <= BROADCAST_ROWS
    ids = places.select(F.col("doc_id").alias("id"), F.col("key").alias("id_key"))
    other = places.withColumnsRenamed({"doc_id": "id", "key": "id_key"})
    if few:
        wanted = F.broadcast(ids)
        rest = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["id"]) & (rows["key"] == wanted["id_key"]), "left_anti")
        found = with_places(docs, places)
        return found.unionByName(rest, allowMissingColumns=True)
    same = rows["doc_id"].eqNullSafe(other["id"]) & (rows["key"] == other["id_key"])
    return rows.join(other, same, "left").drop("id", "id_key")


CONTENT = {"anchor": "bigint", "segment": "bigint", "order": "bigint", "content": "binary"}
BLOCK = {"anchor": "bigint", "segment": "bigint", "order": "bigint", "hash": "bigint", "at": "bigint",
         "windows": "array<bigint>"}


def _cut(docs: DataFrame, method: Method, wanted: DataFrame, blocks: bool) -> DataFrame:
    """The codes of the wanted segments (anchor, segment, order, sample), or their blocks of windows: the hash of
    the whole stretch and those of its windows."""
    places = wanted.groupBy("sample.doc_id", "sample.key").agg(F.collect_list(F.struct(
        "sample.start", "sample.windows", "anchor", "segment", "order")).alias("places"))
    places = storage.written(places, "places")
    result = BLOCK if blocks else CONTENT
    schema = arrow_schema(result)

    def cut(batches):
        for batch in batches:
            for texts in slices(batch.column("text")):
                codes, first = method.codes(texts)
                lists = batch.column("places").slice(texts.first, texts.rows)
                flat = lists.flatten()
                of = {n: flat.field(i).to_numpy() for i, n in enumerate(("start", "windows", "anchor", "segment", "order"))}
                row = np.repeat(np.arange(texts.rows), lists.value_lengths().to_numpy())
                low = of["start"] + first[row]
                if not blocks:
                    ends = low + of["windows"] + method.window - 1
                    whole = method.stored(texts) if method.stored else codes
                    content = pa.array([whole[a:b].tobytes() for a, b in zip(low, ends)], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(of[n]) for n in ("anchor", "segment", "order")), content], schema=schema)
                    continue
                pieces = -(-of["windows"] // BLOCK_WINDOWS)
                each = np.repeat(np.arange(len(low)), pieces)
                at = ragged(np.zeros(len(low), np.int64), pieces) * BLOCK_WINDOWS
                number = np.minimum(of["windows"][each] - at, BLOCK_WINDOWS)
                first_code = low[each] + at
                stretch = range_hashes(codes, first_code, first_code + number + method.window - 1)
                starts = ragged(first_code, number)
                hashes = range_hashes(codes, starts, starts + method.window)
                cuts = np.concatenate([[0], np.cumsum(number)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(of[n][each]) for n in ("anchor", "segment", "order")),
                     pa.array(stretch.view(np.int64)), pa.array(at),
                     pa.ListArray.from_arrays(cuts, hashes.view(np.int64))], schema=schema)

    # a sample row that is there twice is cut out twice; one is enough
    found = with_places(docs, places).select("text", "places").mapInArrow(lean(cut), ddl(result))
    return found.dropDuplicates([n for n in result if n not in ("content", "windows")])


FOUND = {"segment": "bigint", "anchor": "bigint", "low": "bigint", "high": "bigint"}


def _shards(contents: DataFrame, method: Method) -> DataFrame:
    """anchor, segment and the runs of windows that the shard's index found."""
    schema = arrow_schema(FOUND)
    kind = np.uint8 if method.stored else np.uint64
    width = np.dtype(kind).itemsize

    def chunks(batches) -> Iterator[pa.Table]:
        """Rows sorted by anchor, cut between anchors after about SHARD_CODES codes, whatever a batch holds."""
        limit = (8 if width == 8 else 2) * SHARD_CODES
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = np.cumsum(pc.binary_length(batch.column("content")).to_numpy())
            stops = np.unique(np.append(np.searchsorted(ends, np.arange(1, ends[-1:].sum() // limit + 1) * limit), len(ends)))
            for start, stop in zip(np.append(0, stops), stops):
                part = batch.slice(start, stop - start)
                held.append(part)
                size += int(ends[stop - 1] - (ends[start - 1] if start else 0))
                if size >= limit:
                    table = pa.Table.from_batches(held)
                    anchor = table["anchor"].to_numpy()
                    last = int(np.searchsorted(anchor, anchor[-1]))
                    if last:
                        yield table.slice(0, last)
                        held = table.slice(last).to_batches()
                        size = sum(pc.sum(pc.binary_length(b.column("content"))).as_py() for b in held)
        if held:
            yield pa.Table.from_batches(held)

    def find(batches):
        for table in chunks(batches):
            raw = table["content"].cast(pa.large_binary()).combine_chunks()
            ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1]
            codes = np.frombuffer(raw.buffers()[2], np.uint8)[ends[0]:ends[-1]].view(kind)
            begins = (ends - ends[0]) // width
            found = method.search(codes, begins, table["order"].to_numpy())
            at, low, high = (np.array(x, np.int64) for x in (zip(*found) if found else ((), (), ())))
            yield pa.RecordBatch.from_arrays(
                [pa.array(table["segment"].to_numpy()[at]), pa.array(table["anchor"].to_numpy()[at]),
                 pa.array(low), pa.array(high)], schema=schema)

    dealt = contents.repartition("anchor").sortWithinPartitions("anchor", "segment")
    return dealt.mapInArrow(lean(find), ddl(FOUND))


def _judged(pieces: DataFrame, method: Method, label: str, *more: Column) -> DataFrame:
    """``pieces`` with ``again``: whether their hash occurs in a text of a smaller order, or twice; and with
    ``more`` aggregates of those that occur twice."""
    if method.kind == "earlier":
        known = pieces.groupBy("hash").agg(F.min("order").alias("least"), F.max("order").alias("last")).where("least < last")
        again = F.coalesce(F.col("least") < F.col("order"), F.lit(False))
    else:
        known = pieces.groupBy("hash").agg(F.count("*").alias("times"), *more).where("times > 1")
        again = F.col("times").isNotNull()
    known = storage.written(known, f"{label}-counts")
    return storage.written(pieces.join(known, "hash", "left").withColumn("again", again), label)


def _counted_blocks(blocks: DataFrame, method: Method) -> DataFrame:
    """The same for the segments of hot anchors, from counts: whole blocks of windows first, then the single
    windows of one block of each hash. Other blocks may share some windows with a block that repeats as a
    whole, so one of its copies stays among those that are counted."""
    blocks, alone = storage.written(blocks, "cut-blocks"), ~F.col("again")
    if method.kind == "earlier":  # the first copies are alone anyway
        blocks = _judged(blocks, method, "blocks")
    else:
        place = F.xxhash64("anchor", "segment", "at")  # a number, which is aggregated without sorting
        blocks = _judged(blocks, method, "blocks", F.min(place).alias("one"))
        alone |= place == F.col("one")
    single = _judged(storage.written(blocks.where(alone).select(
        "anchor", "segment", "order", "at", F.posexplode("windows").alias("place", "hash")), "cut-windows"), method, "windows")
    whole = blocks.where("again").select(
        "segment", "anchor", F.col("at").alias("low"), (F.col("at") + F.size("windows") - 1).alias("high"))
    place = F.col("at") + F.col("place")
    return whole.union(single.where("again").select("segment", "anchor", place.alias("low"), place.alias("high")))


def repeated_windows(docs: DataFrame, method: Method) -> DataFrame:
    """doc_id, key and ``runs``: the (first, last) windows that repeat, for each text with any."""
    repeated = storage.written(anchor_counts(docs, method), "anchors")
    hits = storage.written(segments(docs, method).join(repeated, "anchor"), "segments")
    distinct = storage.written(hits.groupBy("anchor", "segment").agg(
        F.min("order").alias("order"), F.count("*").alias("times"),
        F.min(F.struct("doc_id", "key", "start", "windows")).alias("sample")), "distinct")
    rivals = storage.written(distinct.groupBy("anchor").agg(F.count("*").alias("different")).where("different > 1"), "rivals")
    contested = distinct.join(rivals, "anchor")
    contents = _cut(docs, method, contested.where(F.col("different") <= HOT), blocks=False)
    blocks = _cut(docs, method, contested.where(F.col("different") > HOT), blocks=True)
    found = _shards(contents, method).unionByName(_counted_blocks(blocks, method))
    found = storage.written(found.groupBy("anchor", "segment").agg(
        F.collect_list(F.struct("low", "high")).alias("runs")), "runs")
    settled = F.col("order") > F.col("first") if method.kind == "earlier" else F.col("times") > 1
    known = distinct.select("anchor", "segment", F.col("order").alias("first"), "times").join(
        found, ["anchor", "segment"], "left")
    known = storage.written(known.where("runs is not null or times > 1"), "decided")
    whole = F.array(F.struct(F.col("start").alias("low"), (F.col("start") + F.col("windows") - 1).alias("high")))
    moved = F.transform("runs", lambda r: F.struct((r["low"] + F.col("start")).alias("low"), (r["high"] + F.col("start")).alias("high")))
    decided = hits.join(known, ["anchor", "segment"]).select(
        "doc_id", "key", F.when(settled, whole).otherwise(moved).alias("runs")).where("runs is not null")
    return decided.groupBy("doc_id", "key").agg(F.flatten(F.collect_set("runs")).alias("runs"))


def covered(runs, size: int, window: int) -> np.ndarray:
    """Which of ``size`` codes are in one of the windows."""
    change = np.zeros(size + 1, np.int64)
    for run in runs:
        change[run["low"]] += 1
        change[run["high"] + window] -= 1
    return np.cumsum(change)[:-1] > 0
