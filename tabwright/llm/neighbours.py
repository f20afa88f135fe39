"""Near-duplicate vectors by p-stable hashing for the Euclidean distance, verified by exact cosines.

Vectors are normalised, so a cosine c is a distance of sqrt(2 - 2 c). A table hashes floor((a x + b) / ``WIDTH``)
for ``PROJECTIONS`` Gaussian directions a; equal hashes in one of ``TABLES`` tables make two vectors candidates. A
projection agrees with probability 0.88 at cosine 0.9 and 0.63 between orthogonal vectors; all tables miss
a pair of cosine 0.9 exactly with probability 1.2e-4, one of 0.95 with 2e-8. Vectors and directions are rounded to
integers before they are multiplied: their sums are exact in any order, so tasks agree on every hash.

Rows with equal components become one weighted node. A bucket carries nodes with an 8-bit sketch and the length of
its error, from which the cosine is bounded from above; only pairs whose bound reaches the threshold go on to the
exact cosine of the whole vectors. A pair counts in the first table in which it agrees. Buckets of more than
``BLOCK`` nodes are dealt out in blocks of about that many, one group for two blocks; pairs stay inside the tasks,
which give one row for each node: its links and the root of a spanning tree.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing,
nor do vectors of different lengths. Repeated rows link with each other. Null ids count in n_links but not for
component_id, which is null only if the whole component has null ids; such rows have kept = false.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.arrays import mixed
from tabwright.llm.components import components
from tabwright.llm.groups import by_group, whole_groups
from tabwright.llm.rows import arrow_schema, ddl, lean
from tabwright.plans import storage

THRESHOLD = 0.9
TABLES, PROJECTIONS, WIDTH = 64, 16, 3.0
BLOCK = 512
#: Steps of one unit that normalised components and directions are rounded to.
UNIT = 1 << 20
#: Parts into which the rows of a component are dealt when they look up its least id.
PARTS = 32
#: Pairs that are compared at once.
PAIRS = 1 << 15

KEYS = ("place", "bucket", "low", "high")


@functools.cache
def directions(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole-number directions and offsets of all tables for vectors of a length."""
    rng = np.random.default_rng([13, size])
    a = np.rint(rng.standard_normal((size, TABLES * PROJECTIONS)) * UNIT)
    return a, np.rint(rng.random(TABLES * PROJECTIONS) * WIDTH * UNIT) * UNIT


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; first divided by their largest component, so that no square overflows."""
    x = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def buckets(units: np.ndarray) -> np.ndarray:
    """One 32-bit bucket for each row and table."""
    a, b = directions(units.shape[1])
    steps = np.floor((np.rint(units * UNIT) @ a + b) / (WIDTH * UNIT * UNIT)).astype(np.int64).view(np.uint64)
    steps = steps.reshape(len(units), TABLES, PROJECTIONS)
    h = np.zeros((len(units), TABLES), np.uint64)
    for p in range(PROJECTIONS):
        h = mixed(h + steps[:, :, p] + np.uint64(p + 1))
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)


def sketches(units: np.ndarray) -> list[bytes]:
    """8-bit components, their scale, and the length of what they leave out."""
    scale = np.abs(units).max(axis=1, keepdims=True) / 127
    q = np.rint(units / scale)
    error = np.sqrt(((units - q * scale) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-12
    tail = np.stack([scale[:, 0], error], axis=1)
    return [a.tobytes() + b.tobytes() for a, b in zip(q.astype(np.int8), tail)]


def _opened(sketch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The rounded vectors and the lengths of their errors, for sketches of one length."""
    column = sketch.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8)[ends[0]:ends[-1]].reshape(len(column), -1)
    tail = np.ascontiguousarray(raw[:, -16:]).view(np.float64)
    return (raw[:, :-16].view(np.int8) * tail[:, :1]).astype(np.float32), tail[:, 1]


def _close_pairs(x: np.ndarray, error: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs inside the groups whose vectors, each within its error of ``x``, may reach the threshold."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in np.flatnonzero(np.diff(begins) > 1):
        a, b = begins[at], begins[at + 1]
        off = float(error[a:b].max())
        least = THRESHOLD - 2 * off - off * off - 1e-5  # the last for products in 32 bits
        i, j = np.nonzero(x[a:b] @ x[a:b].T >= least)
        later = i < j
        if later.any():
            left.append(i[later] + a)
            right.append(j[later] + a)
    return np.concatenate(left), np.concatenate(right)


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Components of all rows and where each row's begin."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    begins = column.offsets.to_numpy()
    return column.flatten().to_numpy().astype(np.float64), begins - begins[0]


def _valid():
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(sound & F.exists("embedding", lambda x: x != 0), F.lit(False))


def hashed(nodes: DataFrame) -> DataFrame:
    """node, size (of the vector), buckets and sketch."""
    columns = {"node": "bigint", "size": "bigint", "buckets": "array<int>", "sketch": "binary"}
    schema = arrow_schema(columns)

    def work(batches):
        for batch in batches:
            flat, begins = _lists(batch.column("embedding"))
            sizes = np.diff(begins)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                for at in range(0, len(rows), max(1, (1 << 18) // int(size))):
                    part = rows[at:at + max(1, (1 << 18) // int(size))]
                    units = unit(flat[begins[part][:, None] + np.arange(size)])
                    cells = pa.ListArray.from_arrays(
                        np.arange(0, len(part) * TABLES + 1, TABLES, dtype=np.int32), buckets(units).ravel())
                    yield pa.RecordBatch.from_arrays([
                        batch.column("node").take(pa.array(part)), pa.array(np.full(len(part), size, np.int64)),
                        cells, pa.array(sketches(units), pa.binary())], schema=schema)

    return nodes.select("node", "embedding").mapInArrow(lean(work), ddl(columns))


def _partner_rows(table, names, left, right):
    """One row for each node that has a pair, with the partners that stand to its right."""
    used = np.unique(np.concatenate([left, right]))
    order = np.argsort(left, kind="stable")
    cuts = np.searchsorted(left[order], np.append(used, table.num_rows))
    node = table["node"].to_numpy()
    return [*(table[n].to_numpy()[used] for n in names), pa.ListArray.from_arrays(cuts.astype(np.int32), node[right[order]])]


def candidates(signed: DataFrame) -> DataFrame:
    """Pairs whose sketches allow the threshold, as a row for each group and node with its partners."""
    place = (F.col("size") * TABLES + F.col("pos")).alias("place")
    spread = signed.select("node", "size", "sketch", F.posexplode("buckets").alias("pos", "bucket")).select(
        place, "bucket", "node", "sketch")
    full = spread.groupBy("place", "bucket").agg(F.count("*").alias("members")).where(F.col("members") > BLOCK)
    blocks = F.coalesce(F.ceil(F.col("members") / BLOCK), F.lit(1)).cast("bigint")
    members = (
        storage.attach(spread, full, ["place", "bucket"])
        .withColumn("own", F.pmod(F.xxhash64("node", "place"), blocks))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
        .select("place", "bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
                "node", "own", "sketch")
    )
    result = {"place": "bigint", "bucket": "int", "low": "bigint", "high": "bigint", "node": "bigint",
              "partners": "array<bigint>"}
    schema = arrow_schema(result)

    def bound(batches):
        for table, begins in whole_groups(batches, KEYS):
            own, low, high = (table[n].to_numpy() for n in ("own", "low", "high"))
            sketch, size = table["sketch"].combine_chunks(), table["place"].to_numpy()[begins[:-1]] // TABLES
            left, right = [], []
            # groups of one size of vectors are neighbours
            cuts = np.flatnonzero(np.append(True, size[1:] != size[:-1]))
            for first, last in zip(cuts, np.append(cuts[1:], len(size))):
                a, b = begins[first], begins[last]
                i, j = _close_pairs(*_opened(sketch.slice(a, b - a)), begins[first:last + 1] - a)
                i, j = i + a, j + a
                apart = (low[i] == high[i]) | (own[i] != own[j])
                left.append(i[apart])
                right.append(j[apart])
            left, right = np.concatenate(left), np.concatenate(right)
            if len(left):
                yield pa.RecordBatch.from_arrays(_partner_rows(table, (*KEYS, "node"), left, right), schema=schema)

    return by_group(members, KEYS).mapInArrow(lean(bound), ddl(result))


def _first_table(cells: np.ndarray, i: np.ndarray, j: np.ndarray, own: int) -> np.ndarray:
    """Whether this table is the first in which the pairs agree."""
    return np.concatenate([
        (cells[i[a:a + PAIRS]] == cells[j[a:a + PAIRS]]).argmax(axis=1) == own for a in range(0, len(i), PAIRS)]
        or [np.zeros(0, bool)])


def _least_reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place connected with each of n places."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == before).all():
            return label


def verify(pairs: DataFrame, weighted: DataFrame) -> DataFrame:
    """node, links (weight of its partners) and root (of a tree over the links of its group)."""
    result = {"node": "bigint", "links": "bigint", "root": "bigint"}
    schema = arrow_schema(result)

    def check(batches):
        for table, begins in whole_groups(batches, KEYS):
            nodes, weights, tables = (table[n].to_numpy() for n in ("node", "copies", "place"))
            partners = table["partners"].combine_chunks()
            cuts = partners.offsets.to_numpy() - partners.offsets[0].as_py()
            flat = partners.flatten().to_numpy()
            vectors = table["embedding"].combine_chunks()
            out = []
            for a, b in zip(begins[:-1], begins[1:]):
                values, _ = _lists(vectors.slice(a, b - a))
                units = unit(values.reshape(b - a, -1))
                order = np.argsort(nodes[a:b])
                i = np.repeat(np.arange(b - a), np.diff(cuts[a:b + 1]))
                j = order[np.searchsorted(nodes[a:b], flat[cuts[a]:cuts[b]], sorter=order)]
                near = np.concatenate([(units[i[k:k + PAIRS]] * units[j[k:k + PAIRS]]).sum(axis=1) >= THRESHOLD
                                       for k in range(0, len(i), PAIRS)] or [np.zeros(0, bool)])
                i, j = i[near], j[near]
                first = _first_table(buckets(units), i, j, int(tables[a]) % TABLES)
                i, j = i[first], j[first]
                links = np.bincount(i, weights[a + j], b - a) + np.bincount(j, weights[a + i], b - a)
                found = np.flatnonzero(links)
                out.append((nodes[a + found], links[found].astype(np.int64), nodes[a + _least_reached(b - a, i, j)[found]]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=schema)

    return by_group(pairs.join(weighted, "node"), KEYS).mapInArrow(lean(check), ddl(result))


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row."""
    sound = vectors.where(_valid()).select("vec_id", F.xxhash64("embedding").alias("node"), "embedding")
    nodes = storage.written(sound.groupBy("node").agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("least_id"), F.first("embedding").alias("embedding")), "vectors")
    signed = storage.written(hashed(nodes), "hashes")
    pairs = storage.written(candidates(signed), "candidates")
    used = nodes.select("node", "copies", "embedding").join(pairs.select("node").distinct(), "node")
    linked = storage.written(verify(pairs, used), "links")
    roots = storage.written(components(linked.select(F.col("node").alias("a"), F.col("root").alias("b"))), "roots")
    links = linked.groupBy("node").agg(F.sum("links").alias("links"))
    known = roots.join(nodes.select("node", "least_id"), "node").withColumn("part", F.pmod(F.hash("node"), F.lit(PARTS)))
    classes = known.groupBy("root", "part").agg(F.min("least_id").alias("least")).groupBy("root").agg(
        F.min("least").alias("component"))
    classes = storage.written(classes, "components").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    member = known.join(classes, ["root", "part"]).select("node", "component")
    per_node = storage.written(nodes.select("node", "copies", "least_id").join(links, "node", "left").join(
        member, "node", "left").select(
            "node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "least_id").alias("component_id")), "per-node")
    alone = vectors.where(~_valid()).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    found = sound.select("vec_id", "node").join(per_node, "node").select("vec_id", "n_links", "component_id").union(alone)
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
