"""Hot and null keys, equal rows, heavy tails, writers at the same time: what large tables bring."""

import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

import tabwright as tw
from tabwright.plans import storage
from tabwright.plans.skew import find_hot_keys


def largest_share(df) -> float:
    sizes = [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    return max(sizes) / sum(sizes)


@pytest.fixture()
def plain_shuffles(spark):
    """Eight shuffle partitions that nothing merges, splits or replaces by a broadcast."""
    settings = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.enabled": "false",
                "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("how", ["left", "right", "outer"])
def test_null_keys_stay_out_of_the_shuffle(spark, plain_shuffles, how):
    many = spark.range(0, 40_000, 1, 8).select(F.when(F.col("id") % 4 == 0, F.col("id") % 100).alias("k"), "id")
    few = spark.range(100).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).union(spark.range(3).select(F.lit(None).cast("long"), "id"))
    # adaptive execution splits a preserved side; here the hot side isn't, or both are
    left, right = (few, many) if how == "left" else (many, few)
    joined = tw.join_dataframes(left, right, "k", how, hot_rows=5000)
    plain = left.join(right, "k", how)
    assert joined.exceptAll(plain.select(joined.columns)).count() == 0 and joined.count() == plain.count()
    assert largest_share(joined) < 0.4


def test_equal_rows_are_spread(spark, plain_shuffles):
    same = spark.range(0, 50_000, 1, 4).select(F.lit(1).alias("k"), F.lit(7).alias("o"))
    assert largest_share(tw.sort_data(same, "o")) < 0.3
    numbered = tw.add_row_number(same, "k", "o", hot_rows=1000)
    ends = numbered.agg(F.min("row_number"), F.max("row_number"), F.count_distinct("row_number")).first()
    assert tuple(ends) == (1, 50_000, 50_000)


def test_sorting_reads_only_the_columns_wanted(spark, tmp_path):
    spark.range(100).select("id", (F.col("id") * 2).alias("x"), F.lit("t").alias("s")).write.parquet(str(tmp_path / "t"))
    plan = tw.sort_data(spark.read.parquet(str(tmp_path / "t")), "x").select("x")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<x:bigint>" in plan


def test_ties_go_the_same_way_with_and_without_a_hot_key(spark):
    rows = spark.range(3000).select((F.col("id") % 2).alias("k"), (F.col("id") % 5).alias("o"), "id")
    for name, extra in (("row_number", {}), ("lag", {"target": "id"}), ("cumsum", {"target": "id"})):
        plain = tw.window_function(rows, name, "k", "o", **extra)
        hot = tw.window_function(rows, name, "k", "o", hot_rows=10, **extra)
        assert plain.exceptAll(hot).count() == 0, name


def test_hot_keys_have_a_fixed_threshold(spark):
    rows = spark.range(20_000).select((F.col("id") % 500).alias("k"))
    hot = find_hot_keys(rows, ["k"], hot_rows=39)
    assert hot.table.count() == 500 and hot.covers_all
    assert find_hot_keys(rows, ["k"], hot_rows=40) is None


def test_density_of_a_heavy_tail(spark):
    data = np.random.default_rng(4).lognormal(0, 2.5, 100_000)
    found = tw.kde(spark.createDataFrame([(float(v),) for v in data], "x double"), "x", grid=60).orderBy("point").collect()
    width = data.std(ddof=1) * len(data) ** -0.2
    top = max(r["density"] for r in found)
    for r in found:
        exact = np.exp(-0.5 * ((r["x"] - data) / width) ** 2).sum() / (len(data) * width * math.sqrt(2 * math.pi))
        assert abs(r["density"] - exact) < 1e-6 * top


def test_scatter_gives_every_point(spark):
    df = spark.range(15_000).select("id", (F.col("id") % 7).alias("y"))
    assert tw.scatter(df, "id", "y").count() == 15_000
    assert tw.scatter(df, "id", "y", rows=100, key="id").count() == 100


def test_two_writers_get_two_whole_versions(spark, tmp_path):
    path = str(tmp_path / "snapshots")
    tables = [spark.range(n).withColumn("v", F.col("id") * 1.5) for n in (10, 20, 30, 40)]
    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(lambda t: tw.save_snapshot(t, path, f"n{t.count()}"), tables))
    assert sorted(versions) == [1, 2, 3, 4]
    for version, table in zip(versions, tables):
        found = tw.load_snapshot(spark, path, version)
        assert found.data.count() == table.count() == found.meta["row_count"]
        assert found.meta["context"] == f"n{table.count()}"
    with pytest.raises(ValueError):
        tw.load_snapshot(spark, path, 0)


def test_literals_fit_the_column_or_raise_before_a_job(spark):
    df = spark.createDataFrame([(1, "5", True, "x"), (2, None, False, "y")], "n int, t string, b boolean, s string")
    assert tw.filter_rows(df, "t", "==", 5).count() == 1
    assert tw.filter_rows(df, "b", "==", "true").count() == 1
    assert tw.replace_values(df, "t", 5, 6).first()["t"] == "6"
    for call in (lambda: tw.replace_values(df, "n", "x", 1), lambda: tw.filter_rows(df, "n", ">", "many"),
                 lambda: tw.filter_rows(df, "b", "==", "perhaps"), lambda: tw.replace_values(df, "n", 1, "x")):
        with pytest.raises(ValueError):
            call()


def test_intermediates_need_a_folder_and_can_be_removed(spark, tmp_path):
    written, path = storage.written_at(spark.range(5), "probe")
    assert written.count() == 5
    files, target = storage.file_system(spark, path)
    assert files.exists(target) and storage.may_broadcast(spark, path, 5)
    assert not storage.may_broadcast(spark, path, storage.BROADCAST_ROWS + 1)
    assert path in storage._paths


def test_long_texts_get_codes_instead_of_columns(spark):
    df = spark.range(300).select("id", F.concat(F.lit("text "), F.lpad("id", 4, "0")).alias("t"))
    cleaned = tw.auto_clean(df, max_levels=50, keep=["id"])
    assert cleaned.columns == ["id", "t"]
    assert all(r["t"] == r["id"] for r in cleaned.collect())
