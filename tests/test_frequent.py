"""Frequent values from summaries: exact where the bound decides, counted in full where it doesn't."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

import tabwright as tw
from tabwright.operators import relational
from tabwright.plans import frequent


def expected(values, top):
    counts = collections.Counter(v for v in values if v is not None)
    return sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:top]


def found(df, top):
    return [tuple(r) for r in tw.value_counts(df, "v", top).collect()]


@pytest.fixture(scope="module")
def mixed():
    """Half of the rows share 30 values, the other half has values of its own."""
    rng = np.random.default_rng(2)
    return [int(x) for x in np.minimum(rng.zipf(1.4, 20_000), 30)] + list(range(1_000, 21_000)) + [None] * 50


def test_near_unique_column_is_not_counted_in_full(spark, mixed, monkeypatch):
    monkeypatch.setattr(relational, "_all_counts", lambda *a: pytest.fail("counted all values"))
    df = spark.createDataFrame([(v,) for v in mixed], "v long").repartition(6)
    assert found(df, 5) == expected(mixed, 5)
    counted = frequent.top_counts(df, F.col("v"), 5, 2_000)
    assert counted.count() <= 30  # all that goes through the shuffle, from each task


def test_values_that_the_bound_does_not_decide_are_counted(spark, mixed):
    df = spark.createDataFrame([(v,) for v in mixed], "v long").repartition(6)
    assert frequent.top_counts(df, F.col("v"), 200, 2_000) is None
    assert found(df, 200) == expected(mixed, 200)
    unique = [(i,) for i in range(30_000)]
    assert frequent.top_counts(spark.createDataFrame(unique, "v long"), F.col("v"), 3) is None
    assert found(spark.createDataFrame(unique, "v long"), 3) == [(0, 1), (1, 1), (2, 1)]


def test_few_values_are_exact_with_ties_zeros_and_nan(spark):
    nan = float("nan")
    rows = [0.0, -0.0, 0.0, 1.0, 1.0, 1.0, 2.0, 2.0, nan, nan, None]
    df = spark.createDataFrame([(v,) for v in rows], "v double")
    top = found(df, 3)
    assert top[:3] == [(0.0, 3), (1.0, 3), (2.0, 2)]
    assert found(df, 10)[3][1] == 2  # NaN
    empty = df.where("v < -5")
    assert found(empty, 3) == [] and tw.mode(empty, "v").count() == 0
    assert tw.mode(df, "v").first()["v"] == 0.0


def test_texts_of_any_length(spark):
    texts = ["a" * 30_000] * 4 + ["b" * 30_000] * 4 + ["c"] * 3 + [""] * 5
    df = spark.createDataFrame([(v,) for v in texts], "v string").repartition(3)
    assert found(df, 3) == expected(texts, 3)


@pytest.mark.parametrize("seed", range(4))
def test_any_mixture_equals_plain_counts(spark, seed):
    rng = np.random.default_rng(seed)
    values = [int(x) for x in rng.zipf(1.1 + seed / 5, 30_000) % (10 ** (seed + 2))]
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(5)
    for top in (1, 7):
        assert found(df, top) == expected(values, top)
        part = frequent.top_counts(df, F.col("v"), top, 100)
        if part is not None:
            assert [tuple(r) for r in part.orderBy(F.desc("count"), "value").limit(top).collect()] == expected(values, top)
