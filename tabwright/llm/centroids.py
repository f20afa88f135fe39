"""k-means over quantised vectors with exact sums, where geometry spares most scans.

A vector of ``SIZE`` components becomes the integers floor(64 x). Each vector keeps its cluster, its exact squared
distance and a lower bound of the distance to every other centroid. When centroid j moves from a to b, the distance
of x to it shrinks by at most |b - a| cos(angle between x - m and b - a), m the midpoint: with d and e the
distances to a and b, d - e = 2 (x - m)(b - a) / (d + e), and d + e >= 2 |x - m|. The vectors of a cluster
lie in a sphere round its old centroid; in the plane through that centre, a and b, the sphere is seen from m under
a known angle, which gives the largest cosine. The bound of a cluster is loosened by the largest of these values over
the other centroids, less than by their full drift. A vector that is still nearer to its own centroid
keeps its cluster; the others (ambiguous) are compared with all centroids in exact integers.

A round is one pass over the written vectors in Arrow tasks and one aggregate of their sums; the driver holds the
centroids, their radii and counts only.

Defined cases: vectors that are null, of another length, or hold null or non-finite components are left out. Null
and repeated ids: each row is a vector; equal hashes go by the components, null ids come last in the choice of the
first centroids. Fewer than 16 vectors give as many centroids. Equal distances go to the smaller number. An empty table
gives no row. A component beyond 2^27 after quantising raises, since a squared distance must fit in 64 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.rows import arrow_schema, ddl, lean
from tabwright.plans import storage

CLUSTERS, ROUNDS = 16, 3
SIZE, SCALE = 64, 64
LARGEST = 1 << 27
#: Bounds must differ by this share before they decide: far above the rounding of a few dozen operations.
SLACK = 1e-9

STATE = {"vec_id": "bigint", "q": "array<int>", "cluster": "int", "distance": "bigint", "lower": "double", "scans": "int"}


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and q of the vectors that count."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    inside = F.forall("q", lambda x: F.abs(x) <= LARGEST)
    checked = F.when(inside, F.col("q").cast("array<int>")).otherwise(F.raise_error(F.lit("component too large")))
    return vectors.where((F.size("embedding") == SIZE) & finite).select(
        "vec_id", whole.alias("q")).select("vec_id", checked.alias("q"))


def first_centroids(rows: DataFrame, seed: int = 1, clusters: int = CLUSTERS) -> np.ndarray:
    """The vectors with the least hashes of seed and id."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    best = rows.select(order.alias("hash"), "q").orderBy(F.asc_nulls_last("hash"), "q").limit(clusters).collect()
    return np.array([r["q"] for r in best], np.int64).reshape(len(best), SIZE)


def loosening(centre: np.ndarray, radius: float, old: np.ndarray, new: np.ndarray) -> float:
    """How much nearer a moved centroid can come to any point of a sphere, at most."""
    move, seen = new - old, centre - (old + new) / 2
    drift, far = float(np.linalg.norm(move)), float(np.linalg.norm(seen))
    if drift == 0:
        return 0.0
    if far <= radius * (1 + SLACK):
        return drift
    angle = np.arccos(np.clip(seen @ move / (far * drift), -1, 1)) - np.arcsin(min(radius / far, 1.0))
    return drift * max(0.0, float(np.cos(max(angle, 0.0)))) * (1 + SLACK) + SLACK * drift


def loosenings(old: np.ndarray, new: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """For each cluster the most that its vectors' bound to the other centroids can fall."""
    a, b = old.astype(float), new.astype(float)
    each = range(len(a))
    return np.array([max((loosening(a[i], radii[i], a[j], b[j]) for j in each if j != i), default=0.0) for i in each])


def _squared(q: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centroids."""
    most = max(int(np.abs(q).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if most <= 1 << 22:  # all sums of products are integers below 2^53, in any order
        x, c = q.astype(np.float64), centroids.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((q - c) ** 2).sum(1) for c in centroids], axis=1)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("q").flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, SIZE)


def _assigned(q, cluster, lower, loosen, centroids):
    """cluster, distance, lower, and which rows were compared with all centroids."""
    if loosen is None:
        ambiguous = np.ones(len(q), bool)
        distance = np.zeros(len(q), np.int64)
    else:
        distance = ((q - centroids[cluster]) ** 2).sum(1)
        lower = lower - loosen[cluster]
        ambiguous = np.sqrt(distance) * (1 + SLACK) + SLACK >= lower
    if ambiguous.any():
        every = _squared(q[ambiguous], centroids)
        best = every.argmin(axis=1)
        row = np.arange(len(best))
        cluster[ambiguous], distance[ambiguous] = best, every[row, best]
        every[row, best] = np.iinfo(np.int64).max
        second = every.min(axis=1) if len(centroids) > 1 else np.full(len(best), np.iinfo(np.int64).max)
        lower[ambiguous] = np.sqrt(second.astype(np.float64)) * (1 - SLACK)
    return cluster, distance, lower, ambiguous


def assign(state: DataFrame, centroids: np.ndarray, loosen: np.ndarray | None) -> DataFrame:
    """The next state: every vector with its nearest centroid. Without ``loosen`` all are compared."""
    schema = arrow_schema(STATE)

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            q, n = _matrix(batch), batch.num_rows
            if loosen is None:
                cluster, lower, scans = np.zeros(n, np.int32), np.zeros(n), np.zeros(n, np.int32)
            else:
                cluster, lower, scans = (batch.column(c).to_numpy().copy() for c in ("cluster", "lower", "scans"))
            cluster, distance, lower, scanned = _assigned(q, cluster, lower, loosen, centroids)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id"), batch.column("q"), pa.array(cluster, pa.int32()), pa.array(distance),
                pa.array(lower), pa.array((scans + scanned).astype(np.int32))], schema=schema)

    return state.mapInArrow(lean(work), ddl(STATE))


def totals(state: DataFrame, clusters: int) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """Of each cluster: its count, its radius, and [inertia, sums of the components], added up in Spark."""
    columns = {"cluster": "int", "farthest": "bigint", "sums": "array<bigint>"}
    schema = arrow_schema(columns)

    def work(batches):
        sums, farthest = np.zeros((clusters, SIZE + 2), np.int64), np.zeros(clusters, np.int64)
        for batch in batches:
            q, cluster = _matrix(batch), batch.column("cluster").to_numpy()
            distance = batch.column("distance").to_numpy()
            np.maximum.at(farthest, cluster, distance)
            for c in np.unique(cluster):
                mine = cluster == c
                sums[c] += np.concatenate([[mine.sum(), distance[mine].sum()], q[mine].sum(0)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(clusters), pa.int32()), pa.array(farthest), pa.array(list(sums))], schema=schema)

    parts = state.select("q", "cluster", "distance").mapInArrow(lean(work), ddl(columns))
    rows = parts.select("cluster", "farthest", F.posexplode("sums").alias("place", "value")).groupBy("cluster", "place").agg(
        F.sum("value").alias("value"), F.max("farthest").alias("farthest")).collect()
    table = [[0] * (SIZE + 2) for _ in range(clusters)]
    radii = np.zeros(clusters)
    for r in rows:
        table[r["cluster"]][r["place"]] = r["value"]
        radii[r["cluster"]] = np.sqrt(float(r["farthest"])) * (1 + SLACK) + SLACK
    return np.array([t[0] for t in table]), radii, [t[1:] for t in table]


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and scans.

    ``scans`` counts the passes (rounds + 1 at most) in which the vector was compared with all centroids.
    """
    spark = vectors.sparkSession
    state = storage.written(quantised(vectors), "quantised")
    centroids = first_centroids(state, seed, clusters)
    loosen = None
    for left in range(rounds, -1, -1):
        state = storage.written(assign(state, centroids, loosen), "assigned")
        counts, radii, sums = totals(state, len(centroids))
        if left:
            moved = np.array([[s // int(n) for s in t[1:]] if n else list(c)
                              for n, t, c in zip(counts, sums, centroids)], np.int64).reshape(centroids.shape)
            loosen = loosenings(centroids, moved, radii)
            centroids = moved
    inertia = [t[0] for t in sums]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    report = spark.createDataFrame(
        [(c, i, sum(inertia), d) for c, (i, d) in enumerate(zip(inertia, digests))],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return state.join(F.broadcast(report), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scans")
