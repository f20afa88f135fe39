"""The plans for large and skewed tables, against brute force on small ones."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabwright.operators import profile, relational, transforms, windows
from tabwright.plans import ordering
from tabwright.plans.ordering import POSITION, RUNNING, number_rows
from tabwright.plans.quantiles import exact_quantiles, grouped_quantiles
from tabwright.plans.skew import find_hot_keys
from tabwright.plans.storage import attach, shared_folder, written


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows under one key, another part under null, many ties, some copies."""
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else None if i % 7 == 0 else f"k{rng.randrange(40)}"
        rows.append((i, key, rng.randrange(12), rng.choice([None, 1.5, 2.5, -4.0, 10.25])))
    rows += [(9999, "hot", 5, 1.0)] * 50
    return spark.createDataFrame(rows, "id bigint, k string, o int, v double").repartition(7)


def bag(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def test_hot_keys_are_found_with_null_as_a_key(skewed):
    hot = find_hot_keys(skewed, ["k"], hot_rows=200)
    assert {r["k"] for r in hot.table.collect()} == {"hot", None}
    assert hot.rows_of(skewed).count() + hot.rest_of(skewed).count() == skewed.count()
    assert find_hot_keys(skewed, ["k"], hot_rows=10**6) is None


def test_row_numbers_by_range_equal_the_plain_window(skewed):
    unique = skewed.dropDuplicates(["id"])
    plain = windows.add_row_number(unique, "k", ["o", "id"])
    split = windows.add_row_number(unique, "k", ["o", "id"], hot_rows=200)
    assert bag(plain, "id", "row_number") == bag(split, "id", "row_number")
    assert plain.dtypes == split.dtypes


def test_row_numbers_with_ties_and_copies_are_complete(skewed):
    split = windows.add_row_number(skewed, "k", "o", hot_rows=200)
    for row in split.groupBy("k").agg(F.count("*").alias("n"), F.max("row_number").alias("top"),
                                      F.count_distinct("row_number").alias("d")).collect():
        assert row["n"] == row["top"] == row["d"]
    sums = Window.partitionBy("k").orderBy("row_number")
    assert split.withColumn("back", F.lag("o").over(sums)).where("back > o").count() == 0


@pytest.mark.parametrize("kind", ["rank", "dense_rank"])
def test_ranks_by_range_equal_the_plain_window(skewed, kind):
    plain = windows.add_rank(skewed, "k", "o", kind)
    split = windows.add_rank(skewed, "k", "o", kind, hot_rows=200)
    assert bag(plain, "id", "k", "o", kind) == bag(split, "id", "k", "o", kind)
    assert plain.dtypes == split.dtypes


@pytest.mark.parametrize("kind,offset", [("lag", 1), ("lead", 3), ("lag", 700), ("lead", 0)])
def test_lag_and_lead_by_range_equal_the_plain_window(skewed, kind, offset):
    unique = skewed.dropDuplicates(["id"])
    name = f"v_{kind}_{offset}"
    plain = windows.add_lag_lead(unique, "k", ["o", "id"], "v", offset, kind)
    split = windows.add_lag_lead(unique, "k", ["o", "id"], "v", offset, kind, hot_rows=200)
    assert bag(plain, "id", name) == bag(split, "id", name)


@pytest.mark.parametrize("target", ["v", "o"])
def test_running_totals_by_range_equal_the_plain_window(skewed, target):
    unique = skewed.dropDuplicates(["id"])
    plain = windows.add_running_total(unique, "k", ["o", "id"], target)
    split = windows.add_running_total(unique, "k", ["o", "id"], target, hot_rows=200)
    assert bag(plain, "id", f"{target}_cumsum") == bag(split, "id", f"{target}_cumsum")
    assert plain.dtypes == split.dtypes


def chain(df, hot_rows=None):
    order = ["o", "id"]
    for name, extra in (("row_number", {}), ("rank", {}), ("dense_rank", {}), ("lag", {"target": "v", "offset": 2}),
                        ("lead", {"target": "row_number"}), ("cumsum", {"target": "v"})):
        df = windows.window_function(df, name, "k", order, hot_rows=hot_rows, **extra)
    return df


def test_functions_over_one_order_place_the_rows_once(skewed, monkeypatch):
    unique = skewed.dropDuplicates(["id"])
    placed, place = [], windows.place
    monkeypatch.setattr(windows, "place", lambda *a: placed.append(a) or place(*a))
    monkeypatch.setattr(ordering, "ROWS_PER_RANGE", 90)
    plain, split = chain(unique), chain(unique, 200)
    assert plain.dtypes == split.dtypes and len(placed) == 1
    assert bag(plain, *plain.columns) == bag(split, *plain.columns)
    again = windows.add_rank(split.where("o > 3"), "k", ["o", "id"], output="r", hot_rows=200)  # another table
    assert len(placed) == 2
    assert bag(again, "id", "r") == bag(windows.add_rank(unique.where("o > 3"), "k", ["o", "id"], output="r"), "id", "r")


@pytest.mark.parametrize("kind", ["rank", "dense_rank"])
def test_ranks_of_equal_values_in_many_ranges(skewed, kind, monkeypatch):
    monkeypatch.setattr(ordering, "ROWS_PER_RANGE", 25)
    plain = windows.add_rank(skewed, "k", "o", kind)
    split = windows.add_rank(skewed, "k", "o", kind, hot_rows=30)
    assert bag(plain, "id", "k", "o", kind) == bag(split, "id", "k", "o", kind)


def test_numbering_without_a_key_across_many_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    done = number_rows(df, [], [F.col("x")], 1000, weight=F.col("x"), rows_per_range=50)
    for row in done.collect():
        assert row[POSITION] == row["x"] + 1
        assert row[RUNNING] == row["x"] * (row["x"] + 1) // 2


def test_label_codes_of_a_long_list(spark):
    df = spark.range(500).select(F.concat(F.lit("v"), (F.col("id") % 300).cast("string")).alias("s"))
    short = transforms.label_codes(df, "s")
    long = transforms.label_codes(df, "s", small=10)
    assert bag(short, "value", "code") == bag(long, "value", "code")
    assert short.count() == 300


@pytest.mark.parametrize("how", ["left", "right", "outer"])
def test_outer_joins_with_hot_keys_equal_the_plain_join(spark, how):
    left = spark.createDataFrame([(1, "a")] * 30 + [(2, "b"), (None, "n"), (5, "e")], "k int, v string")
    right = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z"), (None, "m")] + [(2, "q")] * 40,
                                  "k int, v string")
    plain = relational.join_dataframes(left, right, "k", how)
    split = relational.join_dataframes(left, right, "k", how, hot_rows=20)
    assert plain.columns == split.columns
    key = lambda df: sorted(map(repr, (tuple(r) for r in df.collect())))
    assert key(plain) == key(split)


def test_full_joins_hold_no_pairs_of_a_key(spark, monkeypatch):
    left = spark.range(700).select((F.col("id") % 4).alias("k"), "id").union(spark.range(3).select(F.lit(None).cast("long"), "id"))
    right = spark.range(60).select((F.col("id") % 3 + 2).cast("int").alias("k"), F.col("id").alias("w")).union(spark.range(2).select(F.lit(None), "id"))
    plain = left.join(right, "k", "outer")
    few = relational.join_dataframes(left, right, "k", "outer")
    monkeypatch.setattr(relational, "PAIRS", 300)
    many = relational.join_dataframes(left, right, "k", "outer")
    for found in (few, many):
        assert bag(found, *plain.columns) == bag(plain, *plain.columns)
        assert "FullOuter" not in found._jdf.queryExecution().executedPlan().toString()
    # 2 keys of 175 * 20 pairs, in 12 parts each
    pairs = many.where("id is not null and w is not null")
    sizes = [r["n"] for r in pairs.groupBy("k", F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 7000 and max(sizes) < 2500


@pytest.mark.parametrize("wide", [0, 1])
def test_full_joins_deal_both_sides_of_a_key_in_a_grid(spark, monkeypatch, wide):
    narrow = spark.range(400).select("id", F.when(F.col("id") < 397, F.col("id") % 2 * 9).alias("k"))
    rows = spark.range(390).select(F.col("id").cast("string").alias("w"), F.hex("id").alias("id"), (F.col("id") % 3 * 9).cast("int").alias("k"))
    sides = (narrow, rows) if wide else (rows, narrow)
    dealt, plain = [], type(rows).repartition
    monkeypatch.setattr(relational, "PAIRS", 100)
    monkeypatch.setattr(type(rows), "repartition", lambda self, *a: dealt.append(self.count()) or plain(self, *a))
    found = relational.join_dataframes(*sides, "k", "outer")
    expected = sides[0].join(sides[1], "k", "outer")
    assert found.columns == expected.columns
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, map(tuple, expected.collect())))
    # two keys of about 198 * 130 pairs: blocks of about 10 * 10, so each row goes to 12 to 20 of them, not to 130 or more
    assert len(dealt) == 2 and max(dealt) < 9000
    first = found._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[1]
    assert "hex(" in first  # the wider rows come first


PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.mark.parametrize("direct_rows", [10**6, 100, 1])
def test_quantiles_equal_numpy(spark, direct_rows):
    rng = np.random.default_rng(3)
    table = {"normal": rng.normal(size=5000), "tail": np.exp(rng.normal(size=5000) * 6),
             "ties": np.repeat([1.0, 2.0, 5008.0, 5009.0], 1250),
             "tiny": rng.random(5000) * 1e-12, "huge": rng.choice([-1.7e308, 1.7e308, 0.0, 3.0], 5000),
             "whole": rng.integers(0, 10**9, 5000).astype(float)}
    df = spark.createDataFrame(list(zip(*[v.tolist() for v in table.values()])), list(table))
    found = exact_quantiles(df, list(table), PROBS, direct_rows=direct_rows)
    for name, values in table.items():
        if name == "huge":
            expected = np.sort(values)[[0, 50, 1250, 2500, 3750, 4994, 4999]]
            assert np.isin(found[name], values).all() and found[name][0] == expected[0]
        else:
            assert found[name] == pytest.approx(np.quantile(values, PROBS).tolist(), rel=1e-12)


def test_quantiles_of_odd_columns(spark):
    nan, inf = math.nan, math.inf
    rows = [(None, 1.0, 1.0, -inf), (None, None, nan, 1.0), (None, None, 2.0, 2.0),
            (None, None, 3.0, inf), (None, None, nan, 5.0)]
    df = spark.createDataFrame(rows, "empty double, one double, nans double, infs double")
    for direct_rows in (100, 1):
        found = exact_quantiles(df, df.columns, [0.0, 0.5], direct_rows=direct_rows)
        assert found["empty"] == [None, None]
        assert found["one"] == [1.0, 1.0]
        assert found["nans"] == [1.0, 3.0]  # NaN ranks last
        assert found["infs"] == [-inf, 2.0]
    assert exact_quantiles(df, ["nans"], [0.5, 1.0], nan_as_null=True)["nans"] == [2.0, 3.0]
    assert math.isnan(exact_quantiles(df, ["nans"], [1.0])["nans"][0])


def test_quantiles_of_large_groups(skewed):
    names = ["a", "b", "c"]
    plain = grouped_quantiles(skewed, ["k"], "v", [0.25, 0.5, 0.9], names)
    split = grouped_quantiles(skewed, ["k"], "v", [0.25, 0.5, 0.9], names, hot_rows=100)
    every = grouped_quantiles(skewed, ["k"], "v", [0.25, 0.5, 0.9], names, hot_rows=1)
    rounded = lambda df: bag(df.select("k", *[F.round(n, 9).alias(n) for n in names]), "k", *names)
    assert rounded(plain) == rounded(split) == rounded(every)


def test_written_tables_live_in_the_named_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == folder
    table = written(spark.range(10).withColumn("a.b", F.lit("x")))
    assert table.count() == 10 and table.inputFiles()[0].startswith(f"file://{folder}/")


def test_attach_keeps_null_keys_and_unmatched_rows(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "k string, v int")
    small = spark.createDataFrame([(None, 10), ("a", 20)], "k string, w int")
    assert bag(attach(df, small, ["k"]), "v", "w") == [(1, 10), (2, 20), (3, None)]


def test_sample_is_the_same_for_any_layout(spark):
    df = spark.range(5000)
    first = bag(relational.sample_n(df.repartition(3), 40, "id"), "id")
    assert first == bag(relational.sample_n(df.repartition(11), 40, "id"), "id")
    assert len(first) == 40
    assert first != bag(relational.sample_n(df, 40, "id", seed=1), "id")
    assert relational.sample_n(df, 9000, "id").count() == 5000


def plan_of(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_filters_and_projections_reach_the_scan(spark):
    import tabwright as tw
    df = tw.read_parquet(spark, "/root/testdata/sf0.001/lineitem.parquet")
    kept = tw.select_columns(tw.filter_rows(df, "l_quantity", ">", "25"), ["l_orderkey", "l_quantity"])
    plan = plan_of(kept)
    assert "GreaterThan(l_quantity,25" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_first_row_per_key_is_limited_before_the_shuffle(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = plan_of(relational.drop_duplicates(df, "o_custkey", ["o_orderkey"]))
    assert plan.count("WindowGroupLimit") >= 2


def test_top_n_does_not_sort_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    assert "TakeOrderedAndProject" in plan_of(relational.top_n(df, "o_totalprice"))


def test_quantile_rounds_follow_from_the_number_of_rows(spark, monkeypatch):
    from tabwright.plans import quantiles

    rounds = []
    narrowed = quantiles._narrowed
    monkeypatch.setattr(quantiles, "_narrowed", lambda *a: rounds.append(1) or narrowed(*a))
    values = np.exp(np.linspace(-300, 300, 200_000))
    df = spark.createDataFrame([(float(v), -float(v)) for v in values], "x double, y double").repartition(4)
    found = exact_quantiles(df, ["x", "y"], [0.25, 0.5, 0.75], direct_rows=100)
    assert found["x"] == pytest.approx(np.quantile(values, [0.25, 0.5, 0.75]).tolist(), rel=1e-12)
    assert found["y"] == pytest.approx(np.quantile(-values, [0.25, 0.5, 0.75]).tolist(), rel=1e-12)
    assert len(rounds) <= 2


def test_wide_tables_are_measured_in_two_scans(spark):
    wide = spark.range(50).select("id", *[(F.col("id") * i).alias(f"n{i}") for i in range(60)], F.lit("a").alias("s"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("measure", "")
    profile.measure(wide)
    jobs = tracker.getJobIdsForGroup("measure")
    spark.sparkContext.setJobGroup("correlate", "")
    profile.correlation_matrix(wide.drop("s"))
    more = tracker.getJobIdsForGroup("correlate")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 6 and len(more) <= 6
