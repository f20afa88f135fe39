"""The bootstrap interval of the line chart."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import tabwright as tw
from tabwright.operators import charts


def test_weights_are_poisson_and_independent(spark):
    rows = spark.range(20_000).select(F.explode(F.sequence(F.lit(1), F.lit(12))).alias("__b"), "id")
    df = charts._weighed(rows.withColumn("__row", charts._row_number(rows, ["id"])), 42).select("__b", "id", "__w")
    table = df.toPandas().pivot(index="id", columns="__b", values="__w").to_numpy()
    assert abs(table.mean() - 1) < 0.01 and abs(table.var() - 1) < 0.02
    share = np.bincount(table.ravel(), minlength=5)[:5] / table.size
    assert np.allclose(share, [0.3679, 0.3679, 0.1839, 0.0613, 0.0153], atol=0.004)
    other = np.corrcoef(table.T) - np.eye(12)
    assert np.abs(other).max() < 0.03  # 20,000 rows: a standard error of 0.007
    assert abs(np.corrcoef(table[:-1, 0], table[1:, 0])[0, 1]) < 0.03


def test_interval_is_repeatable_and_close_to_the_normal_one(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(i % 4), "ab"[i % 2], float(rng.normal(10, 2 + i % 4))) for i in range(8000)] + [(9000, None, "a", 1.0), (9001, 1, "b", None)]
    df = spark.createDataFrame(rows, "id long, x int, hue string, y double")
    found = [tw.line(d, "x", "y", "hue", replicates=300, key="id").orderBy("x", "hue").collect() for d in (df, df.repartition(7))]
    for a, b in zip(*found):
        assert a["n"] == b["n"] and [a[c] for c in ("mean", "low", "high")] == pytest.approx([b[c] for c in ("mean", "low", "high")])
    normal = {(r["x"], r["hue"]): r for r in tw.line(df, "x", "y", "hue").collect()}
    assert len(found[0]) == 4 == len(normal)
    for r in found[0]:
        e = normal[r["x"], r["hue"]]
        assert (r["mean"], r["n"]) == (pytest.approx(e["mean"]), e["n"])
        assert (r["high"] - r["low"]) / (e["high"] - e["low"]) == pytest.approx(1, abs=0.2)
    other = tw.line(df, "x", "y", replicates=50, key="id", seed=7).first()
    assert other["low"] < other["mean"] < other["high"]


def test_interval_covers_the_mean_about_as_often_as_it_says(spark):
    rng = np.random.default_rng(2)
    rows = [(g * 60 + i, g, float(rng.exponential(3))) for g in range(300) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, x int, y double")
    hits = tw.line(df, "x", "y", replicates=200, key="id").where("low <= 3 and high >= 3").count()
    assert 0.85 * 300 <= hits <= 0.99 * 300


def test_odd_groups(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("b", 2, 5.0), ("c", 2, 7.0), (None, 3, 1.0)], "id string, x int, y double")
    got = {r["x"]: r for r in tw.line(df, "x", "y", replicates=40, key=["id"]).collect()}
    assert (got[1]["mean"], got[1]["low"], got[1]["high"], got[1]["n"]) == (2.0, 2.0, 2.0, 1)
    assert 5 <= got[2]["low"] <= got[2]["high"] <= 7 and got[3]["mean"] == 1.0
    assert tw.line(df.limit(0), "x", "y", replicates=5, key="id").count() == 0
    for bad in ({"replicates": 0, "key": "id"}, {"replicates": 5}):
        with pytest.raises(ValueError):
            tw.line(df, "x", "y", **bad)
