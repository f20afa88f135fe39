"""Similarity join of documents by the Jaccard coefficient of their five-word shingles.

Equal shingle sets become one node with a weight. Nodes that agree in one of ``BANDS`` bands of
``ROWS`` MinHash values are candidates. Their values are compared in steps of ``STEP``: with a uniform
prior, a pair goes when the posterior probability that its similarity reaches the threshold is below
``TOLERANCE``. What remains is verified on the sets themselves. A pair is looked at only in the first
band in which it agrees. At similarity 0.8 a band is missed with probability 3e-6 for all bands.

Large buckets are dealt out in blocks of about ``BLOCK`` nodes, one group for two blocks, so no task
holds a bucket; pairs stay inside the tasks, which give one row for each node: its links and the root
of a spanning tree. A bucket of m different texts costs m * m / BLOCK rows, since all links count.

Defined cases: a text without words (null, empty) is a class of its own without links; a text of one to
four words has one shingle, all its words. Repeated rows are copies: they share a class and link to
each other. The class id is the least doc_id of the class, null ids not counted.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.arrays import grams, range_hashes
from tabwright.llm.components import components
from tabwright.llm.rows import arrow_schema, ddl, lean, map_texts, text_key
from tabwright.llm.shingles import minhash, shingle_rows
from tabwright.plans import storage

BANDS, ROWS = 24, 4
SIZE = BANDS * ROWS
STEP = 32
TOLERANCE = 1e-6
THRESHOLD = (4, 5)
BLOCK = 512
BROADCAST_ROWS = 250_000


def least_matches(size: int, threshold: float, tolerance: float = TOLERANCE) -> int:
    """The fewest equal values of ``size`` with P(similarity >= threshold) >= tolerance.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail at t is the
    probability of at most m successes in n + 1 trials of probability t.
    """
    tail = 0.0
    for m in range(size + 1):
        tail += math.comb(size + 1, m) * threshold**m * (1 - threshold) ** (size + 1 - m)
        if tail >= tolerance:
            return m
    return size


def _sets(hashes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct hashes in ascending order."""
    row = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[new], np.searchsorted(row[new], np.arange(len(begins)))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, key, node (hash of the shingle set, null without words), size, bands, values."""
    def start():
        def sign(texts, rows):
            hashes, begins = _sets(*shingle_rows(texts))
            values = minhash(hashes, begins, SIZE)
            flat = values.astype(np.uint64).ravel()
            bands, _ = grams(flat, np.arange(0, len(flat) + 1, ROWS), ROWS)
            bands = bands.reshape(-1, BANDS) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            size = np.diff(begins)
            node = range_hashes(hashes, begins[:-1], begins[1:]).view(np.int64)
            lists = pa.ListArray.from_arrays(np.arange(0, bands.size + 1, BANDS, dtype=np.int32),
                                             bands.view(np.int64).ravel())
            return [rows.column("doc_id"), rows.column("key"), pa.array(node, mask=size == 0), pa.array(size),
                    lists, pa.array([v.tobytes() for v in values], pa.binary())]
        return sign

    return map_texts(docs.select("doc_id", text_key().alias("key"), "text"), {
        "doc_id": "bigint", "key": "bigint", "node": "bigint", "size": "bigint",
        "bands": "array<bigint>", "values": "binary"}, start)


def _groups(batches, names):
    """Batches sorted by ``names`` as lists of whole groups: (table columns, group begins)."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        begins = _changes(table, names)
        if len(begins) > 1:
            yield table.slice(0, begins[-1]), np.append(begins[:-1], begins[-1])
            held = table.slice(begins[-1])
        else:
            held = table
    if held is not None and held.num_rows:
        yield held, np.append(_changes(held, names), held.num_rows)


def _changes(table: pa.Table, names) -> np.ndarray:
    new = np.ones(table.num_rows, bool)
    columns = [table[n].to_numpy() for n in names]
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


def _by_group(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys)


def candidates(nodes: DataFrame) -> DataFrame:
    """Pairs left by the Bayesian pruning, as one row for each group and node with its partners."""
    spread = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = storage.written(spread.groupBy("bucket").agg(F.count("*").alias("members"))
                             .where("members > 1"), "buckets")
    blocks = F.ceil(F.col("members") / BLOCK)
    members = (
        spread.join(shared, "bucket")
        .withColumn("own", F.pmod(F.xxhash64("node", "band"), blocks))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("bucket", "band", "node", "own", F.least("own", "other").alias("low"),
                F.greatest("own", "other").alias("high"))
    )
    members = members.join(nodes.select("node", "size", "values"), "node")
    steps = list(range(STEP, SIZE + 1, STEP))
    need = {n: least_matches(n, THRESHOLD[0] / THRESHOLD[1]) for n in steps}
    result = {"bucket": "bigint", "low": "bigint", "high": "bigint", "node": "bigint", "partners": "array<bigint>"}
    schema = arrow_schema(result)

    def prune(batches):
        for table, begins in _groups(batches, ("bucket", "low", "high")):
            values = np.frombuffer(b"".join(table["values"].to_pylist()), np.uint32).reshape(-1, SIZE)
            column = {n: table[n].to_numpy() for n in ("bucket", "band", "own", "low", "high", "node", "size")}
            left, right = [], []
            for a, b in zip(begins[:-1], begins[1:]):
                if b - a < 2:
                    continue
                i, j = np.triu_indices(b - a, 1)
                i, j = i + a, j + a
                fits = np.minimum(column["size"][i], column["size"][j]) * THRESHOLD[1] >= \
                    np.maximum(column["size"][i], column["size"][j]) * THRESHOLD[0]
                if column["low"][a] != column["high"][a]:
                    fits &= column["own"][i] != column["own"][j]
                i, j = i[fits], j[fits]
                equal = np.zeros(len(i), np.int64)
                for n in steps:
                    equal += (values[i, n - STEP:n] == values[j, n - STEP:n]).sum(axis=1)
                    alive = equal >= need[n]
                    i, j, equal = i[alive], j[alive], equal[alive]
                if len(i):
                    same = (values[i] == values[j]).reshape(-1, BANDS, ROWS).all(axis=2)
                    first = same.argmax(axis=1) == column["band"][a]
                    left.append(i[first])
                    right.append(j[first])
            left = np.concatenate(left or [np.zeros(0, np.int64)])
            right = np.concatenate(right or [np.zeros(0, np.int64)])
            used = np.unique(np.concatenate([left, right]))
            order = np.argsort(left, kind="stable")
            cuts = np.searchsorted(left[order], np.append(used, table.num_rows))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(column[n][used].astype(np.int64)) for n in ("bucket", "low", "high", "node")),
                 pa.ListArray.from_arrays(cuts.astype(np.int32), column["node"][right[order]])], schema=schema)

    return _by_group(members, ["bucket", "low", "high"]).mapInArrow(lean(prune), ddl(result))


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and its sorted shingle hashes for the rows (doc_id, key) named in ``wanted``."""
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    rows = docs.select("doc_id", text_key().alias("key"), "text")
    same = rows["doc_id"].eqNullSafe(wanted["doc_id"]) & (rows["key"] == wanted["key"])
    chosen = rows.join(wanted, same).select(wanted["node"], rows["text"])

    def start():
        def collect(texts, found):
            hashes, begins = _sets(*shingle_rows(texts))
            sets = [hashes[a:b].tobytes() for a, b in zip(begins[:-1], begins[1:])]
            return [found.column("node"), pa.array(sets, pa.binary())]
        return collect

    return map_texts(chosen, {"node": "bigint", "shingles": "binary"}, start).dropDuplicates(["node"])


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """node, links (weight of its partners), texts (partners) and root (of a tree over the group's links)."""
    result = {"node": "bigint", "links": "bigint", "texts": "bigint", "root": "bigint"}
    schema = arrow_schema(result)
    up, down = THRESHOLD

    def check(batches):
        for table, begins in _groups(batches, ("bucket", "low", "high")):
            nodes, weights = table["node"].to_numpy(), table["copies"].to_numpy()
            partners = table["partners"].combine_chunks()
            cuts, flat = partners.offsets.to_numpy(), partners.flatten().to_numpy()
            cuts = cuts - cuts[0]
            raw = table["shingles"].to_pylist()
            links, texts = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
            root = nodes.copy()
            for a, b in zip(begins[:-1], begins[1:]):
                place = {node: at for at, node in enumerate(nodes[a:b].tolist(), a)}
                parent = list(range(b - a))

                def top(x):
                    while parent[x] != x:
                        parent[x] = parent[parent[x]]
                        x = parent[x]
                    return x

                sets_of = [np.frombuffer(x, np.uint64) for x in raw[a:b]]
                for i in range(a, b):
                    own = sets_of[i - a]
                    for j in map(place.__getitem__, flat[cuts[i]:cuts[i + 1]].tolist()):
                        other = sets_of[j - a]
                        at = np.searchsorted(own, other)
                        at[at == len(own)] = 0
                        both = int((own[at] == other).sum())
                        if both * down >= (len(own) + len(other) - both) * up:
                            links[i] += weights[j]
                            links[j] += weights[i]
                            texts[i] += 1
                            texts[j] += 1
                            x, y = top(i - a), top(j - a)
                            parent[max(x, y)] = min(x, y)
                root[a:b] = [nodes[a + top(x)] for x in range(b - a)]
            kept = texts > 0
            yield pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in (nodes, links, texts, root)], schema=schema)

    joined = pairs.join(sets, "node")
    return _by_group(joined, ["bucket", "low", "high"]).mapInArrow(lean(check), ddl(result))


def similarity_classes(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, key (of its text), class_id, n_links, n_similar_texts and root.

    ``n_links`` counts the other documents whose similarity is 0.8 or more, copies included;
    ``n_similar_texts`` counts the different shingle sets among them, ``root`` tells classes apart and is
    null without words.
    """
    signed = storage.written(signatures(docs), "signatures")
    nodes = storage.written(
        signed.where("node is not null").groupBy("node").agg(
            F.count("*").alias("copies"), F.min("doc_id").alias("least_id"),
            F.min(F.struct("doc_id", "key")).alias("sample"),
            F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("values").alias("values")),
        "nodes")
    pairs = storage.written(candidates(nodes), "pairs")
    used = pairs.select("node").distinct()
    weighted = storage.written(nodes.select("node", "copies", "sample").join(used, "node"), "used")
    sets = shingle_sets(docs, weighted.select("sample.doc_id", "sample.key", "node"))
    linked = storage.written(verify(pairs, sets.join(weighted.select("node", "copies"), "node")), "links")
    roots = storage.written(components(linked.select(F.col("node").alias("a"), F.col("root").alias("b"))), "roots")
    sums = linked.groupBy("node").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    known = nodes.select("node", "copies", "least_id").join(sums, "node", "left").join(roots, "node", "left")
    known = known.withColumn("root", F.coalesce("root", "node"))
    classes = known.groupBy("root").agg(F.min("least_id").alias("class_id"))
    per_node = storage.written(known.join(classes, "root").select(
        "node", "root", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("texts", F.lit(0)).alias("n_similar_texts")), "classes")
    return signed.select("doc_id", "key", "node").join(per_node, "node", "left").select(
        "doc_id", "key", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("n_similar_texts", F.lit(0)).alias("n_similar_texts"), "root")


def _matching(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Semi or anti join on (doc_id, key), with a broadcast of at most ``BROADCAST_ROWS`` ids."""
    other = rows.select(F.col("doc_id").alias("__id"), F.col("key").alias("__id_key"))
    if rows.count() <= BROADCAST_ROWS:
        other = F.broadcast(other)
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (text_key() == F.col("__id_key"))
    return docs.join(other, same, how)


def one_of_each_class(docs: DataFrame) -> DataFrame:
    """The row of the least doc_id (then text hash) of each class, with its columns; null ids come last.

    Documents without words all stay.
    """
    names = docs.columns
    rows = storage.written(similarity_classes(docs).where("root is not null").groupBy("root", "doc_id", "key").agg(
        F.count("*").alias("times")), "class-rows")
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key")).alias("best"))
    ranked = rows.join(best, "root").withColumn(
        "wins", F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("key") == F.col("best.key")))
    ranked = storage.written(ranked.select("doc_id", "key", "wins", "times"), "class-winners")
    plain = docs.select(*(F.col(n).alias(f"c{i}") for i, n in enumerate(names)), "doc_id", "text")
    kept = _matching(plain, ranked.where(~F.col("wins")), "left_anti")
    repeated = ranked.where("wins and times > 1")
    once = _matching(kept, repeated, "left_semi").withColumn("key", text_key()).dropDuplicates(["doc_id", "key"]).drop("key")
    return _matching(kept, repeated, "left_anti").union(once).select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)))
