"""Centroid clustering, source divergence and embedding near-duplicates against brute force."""

import collections
import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pytest

from brute import SMALL
from compare import connect, differences
from tabwright.llm import centroids, divergence, groups, neighbours, queries

VECTORS = "vec_id long, embedding array<float>, label int, node string, cluster int, q string, copies string, part int"
NAN, INF = float("nan"), float("inf")


def clustered(size, centres, each, noise, seed):
    rng = np.random.default_rng(seed)
    return [(c + noise * rng.standard_normal(size)) for c in rng.standard_normal((centres, size)) * 0.2 for _ in range(each)]


@pytest.fixture(scope="module")
def vector_rows():
    rng = np.random.default_rng(3)
    plain = [r.tolist() for r in clustered(64, 12, 25, 0.02, 1)] + [r.tolist() for r in 0.13 * rng.standard_normal((200, 64))]
    rows = [(i, np.float32(v).tolist()) for i, v in enumerate(plain)]
    first = rows[3][1]
    return rows + [
        (None, first), (None, None), (3, first), (3, first), (900, first), (901, None), (902, []), (903, [0.0] * 64),
        (904, [-0.0] * 64), (905, [NAN] + [0.1] * 63), (906, [INF] + [0.1] * 63), (907, [None] + [0.1] * 63),
        (908, first[:63]), (909, first + [0.5]), (910, [x * 2 for x in first]), (911, [-x for x in first]),
        (912, first[:63]), (913, [1.0]), (914, [2.0]),
    ]


@pytest.fixture(scope="module")
def vectors(spark, vector_rows):
    return spark.createDataFrame([(i, v, 1, "n", 2, "q", "c", 3) for i, v in vector_rows], VECTORS).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], VECTORS)


def brute_clusters(rows, clusters=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [q for _, q in order[:clusters]]
    for left in range(rounds, -1, -1):
        own = []
        for _, q in kept:
            d = [sum((a - b) ** 2 for a, b in zip(q, c)) for c in centres]
            own.append((min(range(len(d)), key=lambda c: (d[c], c)), min(d)))
        if left:
            for c in range(len(centres)):
                mine = [q for (_, q), (o, _) in zip(kept, own) if o == c]
                if mine:
                    centres[c] = [sum(x) // len(mine) for x in zip(*mine)]
    total = collections.Counter()
    for c, d in own:
        total[c] += d
    return collections.Counter(
        (i, c, d, total[c], sum(total.values()), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest())
        for (i, _), (c, d) in zip(kept, own))


def cluster_rows(found):
    return collections.Counter(tuple(r)[:6] for r in found)


def test_clusters_equal_plain_kmeans(vectors, vector_rows, nothing):
    found = centroids.cluster(vectors).collect()
    assert cluster_rows(found) == brute_clusters(vector_rows)
    assert sum(r["scans"] for r in found) < 3 * len(found)  # 4 passes: the bounds spare scans
    assert centroids.cluster(nothing).count() == 0


def test_clusters_with_ties_few_and_large_vectors(spark):
    few = [(i, [float(i % 2)] * 64) for i in range(5)]
    many_ties = [(i, [float((i * 7) % 4)] + [0.0] * 63) for i in range(60)]
    large = [(i, [float((i * 37) % 101) * 1e4] * 64) for i in range(40)]
    for rows in (few, many_ties, large):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        assert cluster_rows(centroids.cluster(df).collect()) == brute_clusters(rows)


def test_loosening_bounds_every_point_of_a_sphere():
    rng = np.random.default_rng(8)
    less = 0
    for _ in range(300):
        centre, old = rng.standard_normal((2, 3)) * 3
        new = old + rng.standard_normal(3)
        radius = float(rng.random() * 2)
        points = rng.standard_normal((400, 3))
        points = centre + radius * points / np.linalg.norm(points, axis=1, keepdims=True) * rng.random((400, 1)) ** 0.2
        fall = np.linalg.norm(points - old, axis=1) - np.linalg.norm(points - new, axis=1)
        bound = centroids.loosening(centre, radius, old, new)
        assert fall.max() <= bound + 1e-9
        less += bound < 0.9 * np.linalg.norm(new - old)
    assert less > 150


def brute_neighbours(rows):
    def sound(v):
        return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)

    n = len(rows)
    units = [np.array(v) / math.sqrt(sum(x * x for x in v)) if sound(v) else None for _, v in rows]
    links, label = [0] * n, list(range(n))
    near = [[j for j in range(n) if j != i and units[i] is not None and units[j] is not None
             and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.9] for i in range(n)]
    for i in range(n):
        links[i] = len(near[i])
    changed = True
    while changed:
        changed = False
        for i in range(n):
            least = min([label[i]] + [label[j] for j in near[i]])
            changed |= least < label[i]
            label[i] = least
    least_id = {}
    for i in range(n):
        if rows[i][0] is not None:
            least_id[label[i]] = min(rows[i][0], least_id.get(label[i], rows[i][0]))
    return collections.Counter(
        (rows[i][0], links[i], least_id.get(label[i]), rows[i][0] is not None and rows[i][0] == least_id[label[i]])
        for i in range(n))


def test_neighbours_equal_all_pairs(vectors, vector_rows, nothing):
    expected = brute_neighbours(vector_rows)
    assert collections.Counter(map(tuple, neighbours.near_duplicates(vectors).collect())) == expected
    assert neighbours.near_duplicates(nothing).count() == 0


def test_neighbours_in_small_blocks(vectors, vector_rows, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 4)
    monkeypatch.setattr(neighbours, "PAIRS", 7)
    assert collections.Counter(map(tuple, neighbours.near_duplicates(vectors).collect())) == brute_neighbours(vector_rows)


def test_neighbours_of_one_component_of_null_ids(spark):
    rows = [(None, [1.0, 0.0]), (None, [1.0, 0.1]), (1, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert collections.Counter(map(tuple, neighbours.near_duplicates(df).collect())) == brute_neighbours(rows)


def test_buckets_find_pairs_close_to_the_threshold():
    rng = np.random.default_rng(4)
    x = neighbours.unit(rng.standard_normal((4000, 64)))
    side = rng.standard_normal((4000, 64))
    side = neighbours.unit(side - (side * x).sum(1, keepdims=True) * x)
    y = 0.9 * x + math.sqrt(1 - 0.81) * side
    a, b = neighbours.buckets(x), neighbours.buckets(y)
    assert (a == b).any(axis=1).mean() >= 0.999
    assert (a[:2000] == a[2000:]).mean() < 0.003  # unrelated vectors seldom share a bucket
    part = np.concatenate([neighbours.buckets(x[i:i + 7]) for i in range(0, 700, 7)])
    assert (part == a[:700]).all()  # batches of any size agree
    q, error = neighbours._opened(pa.array(neighbours.sketches(x), pa.binary())[5:])
    assert (np.linalg.norm(q - x[5:], axis=1) <= error + 1e-6).all() and error.max() < 0.05
    units = np.concatenate([x[:300], y[:300]])
    q, error = neighbours._opened(pa.array(neighbours.sketches(units), pa.binary()))
    i, j = neighbours._close_pairs(q, error, np.array([0, 600]))
    assert {(k, k + 300) for k in range(300)} <= set(zip(i.tolist(), j.tolist()))  # no pair at the threshold is lost
    assert len(i) < 400


def brute_divergence(rows):
    """rows: (text, lang, source)."""
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    docs = [(lang or "", source or "", term.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
            for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = collections.Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = {t for t, n in df.items() if n >= 30}
        counts = {s: collections.Counter() for l, s, _ in docs if l == lang}
        for l, s, words in docs:
            if l == lang:
                counts[s].update(w for w in words if w in kept)
        whole = sum(counts.values(), collections.Counter())

        def share(c, t):
            return 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))

        for s, c in counts.items():
            pairs = [(o, sum(abs(share(c, t) - share(counts[o], t)) for t in kept)) for o in counts if o != s]
            terms = [(t, share(c, t) - share(whole, t)) for t in kept if c[t] > 0 and share(c, t) > share(whole, t)]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, r) for r, (item, value) in enumerate(ranked, 1) if part == "pair" or r <= 50]
    return sorted(out)


@pytest.fixture(scope="module")
def sourced():
    rng = np.random.default_rng(6)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150)] + ["Über", "ÉTÉ", "x1y", "a_b", "\U0001F600q"]
    rows = []
    for lang, sources in (("en", ["a", "b", "c", None, "Z"]), (None, ["a", "é"]), ("", ["a"]), ("de", ["only"]), ("fr", ["a", "b"])):
        for s in sources:
            for _ in range(40 if lang != "fr" else 3):
                pick = rng.zipf(1.3, 60) % len(words)
                rows.append((" ".join(words[i].upper() if rng.random() < 0.2 else words[i] for i in pick), lang, s))
    long = " ".join(words[i] for i in rng.integers(0, len(words), 60_000))
    return rows + [(long, "en", "long"), (None, "en", "silent"), ("", None, None), ("12 34 !?", "xx", "none"), (None, "xx", None),
                   *[("same text here", "en", "a")] * 35]


def test_divergence_equals_plain_python(spark, sourced, monkeypatch):
    docs = spark.createDataFrame([(1, t, l, s, "x", 2) for t, l, s in sourced],
                                 "doc_id long, text string, lang string, source string, term string, n int").repartition(4)
    expected = brute_divergence(sourced)
    assert sorted(map(tuple, divergence.audit(docs).collect())) == expected
    monkeypatch.setattr(divergence, "CELLS", 64)  # many blocks
    monkeypatch.setattr(divergence, "HELD", 500)
    assert sorted(map(tuple, divergence.audit(docs).collect())) == expected
    assert divergence.audit(docs.limit(0)).count() == 0


def test_run_lengths_and_exact_shares():
    rng = np.random.default_rng(2)
    matrix = rng.integers(0, 3, (500, 6))
    order, begins = divergence.run_lengths(matrix)
    assert sorted(order) == list(range(500))
    assert min(len(b) for b in begins) == 3  # the first column sorted has a run for each count
    for s, b in enumerate(begins):
        filled = np.repeat(matrix[order[b], s], np.diff(np.append(b, 500)))
        assert (filled == matrix[order, s]).all()
    huge = np.array([0, 1 << 40], np.int64)
    assert divergence.shares(huge, 1 << 41, 3).tolist() == [1 + 10**9 * (int(c) + 5) // ((1 << 41) + 15) for c in huge]


def test_whole_groups_over_batches(spark):
    rows = [(f"k{i // 7}", i % 3 // 2, i) for i in range(1000)]
    import pyarrow as pa
    table = pa.table({"k": [r[0] for r in rows], "v": [r[2] for r in rows]})
    for size in (1, 3, 7, 50, 2000):
        seen = []
        for part, begins in groups.whole_groups(table.to_batches(max_chunksize=size), ["k"]):
            assert part.num_rows == begins[-1]
            for a, b in zip(begins[:-1], begins[1:]):
                assert len(set(part["k"][a:b].to_pylist())) == 1
                seen.append((part["k"][int(a)].as_py(), b - a))
        assert seen == [(f"k{i}", min(7, 1000 - 7 * i)) for i in range(143)]


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_source_divergence", "op13_embedding_dedup"])
def test_query_equals_sql(name, spark):
    assert differences(queries.queries()[name](spark, SMALL), connect(SMALL), queries.oracle_sql()[name]) == []
