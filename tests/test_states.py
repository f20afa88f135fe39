"""Merged profiles equal the profile of the whole; appends read only what is new."""

import glob
import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

import tabwright as tw

SCHEMA = "id long, x double, skewed double, flag string, same string, none int, mixed double, list array<int>"


def table(n, seed):
    rng = np.random.default_rng(seed)
    return [(int(i), None if i % 5 == 0 else float(rng.normal(1e6, 3)), float(rng.exponential() ** 3),
             None if i % 3 == 0 else "ab"[int(rng.integers(2))], "s", None, -0.0 if i % 2 else 0.0, [1]) for i in range(n)]


def keyed(df):
    return {r["feature"]: r for r in df.collect()}


def test_merged_states_equal_the_whole(spark):
    rows = table(3000, 1)
    parts = [rows[:10], rows[10:1200], rows[1200:], []]
    states = [tw.profile_state(spark.createDataFrame(p, SCHEMA)) for p in parts]
    merged = tw.merge_states(states)
    whole = spark.createDataFrame(rows, SCHEMA)
    assert list(map(tuple, tw.audit_of(merged).drop("metric").collect())) == list(map(tuple, tw.full_audit(whole).drop("metric").collect()))
    exact, found = keyed(tw.profile(whole).stats), keyed(tw.stats_of(merged))
    for name, e in exact.items():
        f = found[name]
        assert (f["count"], f["null_count"], f["nan_count"], f["min_text"], f["max_text"]) == (
            e["count"], e["null_count"], e["nan_count"], e["min_text"], e["max_text"])
        for c in ("mean", "std", "min", "max"):
            assert f[c] == (None if e[c] is None else pytest.approx(e[c], rel=1e-9, abs=1e-9))
    values = np.sort([r[2] for r in rows])
    for share, c in ((0.25, "25%"), (0.5, "50%"), (0.75, "75%")):
        assert abs(np.searchsorted(values, found["skewed"][c]) / 3000 - share) < 0.003
    skews = {m.feature: m.skew for m in tw.measure(whole)}
    from tabwright.operators.states import measured_of
    for m in measured_of(merged):
        assert m.skew == (None if skews[m.feature] is None else pytest.approx(skews[m.feature], rel=1e-8, abs=1e-8))
    distinct = {r["feature"]: r["distinct_estimate"] for r in tw.distinct_of(merged).collect()}
    assert abs(distinct["id"] - 3000) < 150 and (distinct["flag"], distinct["same"], distinct["none"], distinct["mixed"]) == (2, 1, 0, 1)


def test_states_of_odd_parts(spark):
    nan = math.nan
    one, two = spark.createDataFrame([(nan, 1)], "x double, y int"), spark.createDataFrame([(1.0, 2), (None, 2)], "x double, y int")
    merged = keyed(tw.stats_of(tw.merge_states([tw.profile_state(one), tw.profile_state(two)])))
    assert (merged["x"]["count"], merged["x"]["nan_count"], merged["x"]["null_count"]) == (2, 1, 1)
    constant = [tw.profile_state(spark.createDataFrame([(v,)], "y int")) for v in (7, 7)]
    assert [r["issue"] for r in tw.audit_of(tw.merge_states(constant)).collect()] == ["Constant/Zero Variance"]
    other = [tw.profile_state(spark.createDataFrame([(v,)], "y int")) for v in (7, 70)]
    assert [r["issue"] for r in tw.audit_of(tw.merge_states(other)).collect()] == ["None"]


def test_an_append_reads_only_the_new_rows(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = table(600, 3)
    first, second, third = (spark.createDataFrame(rows[a:b], SCHEMA) for a, b in ((0, 200), (200, 350), (350, 600)))
    tw.save_snapshot(first, path, "lines")
    assert tw.append_snapshot(second, path) == 2
    old = [f for f in glob.glob(f"{path}/data/*/*.parquet")]
    kept = {f: open(f, "rb").read() for f in old}
    for f in old:  # of what is stored only the footers can be read now
        data = kept[f]
        size = int.from_bytes(data[-8:-4], "little")
        with open(f, "wb") as out:
            out.write(b"PAR1" + b"\xff" * (len(data) - size - 12) + data[-8 - size:])
    for f in glob.glob(f"{path}/data/*/.*.crc"):
        with open(f, "wb") as out:
            out.write(b"")
    assert tw.append_snapshot(third, path) == 3
    stored = tw.load_snapshot(spark, path)
    assert stored.meta["row_count"] == 600 and len(stored.meta["parts"]) == 3
    whole = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, stored.audit.drop("metric").collect())) == sorted(map(tuple, tw.full_audit(whole).drop("metric").collect()))
    with pytest.raises(Exception):
        stored.data.agg(F.sum("x")).collect()  # the old rows were really gone
    with pytest.raises(ValueError, match="other columns"):
        tw.append_snapshot(third.drop("x"), path)


def test_appends_at_the_same_time_lose_no_rows(spark, tmp_path):
    path = str(tmp_path / "s")
    tw.save_snapshot(spark.createDataFrame([(0,)], "x int"), path)
    with ThreadPoolExecutor(3) as pool:
        versions = list(pool.map(lambda v: tw.append_snapshot(spark.createDataFrame([(v,)], "x int"), path), (1, 2, 3)))
    assert sorted(versions) == [2, 3, 4]
    last = tw.load_snapshot(spark, path)
    assert sorted(r["x"] for r in last.data.collect()) == [0, 1, 2, 3] and last.meta["row_count"] == 4
