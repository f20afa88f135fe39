"""Tables laid out by key need no shuffle; states of parts answer for any parts together."""

import re

import pytest
from pyspark.sql import functions as F

import tabwright as tw

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def exchanges(df) -> int:
    return len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|BroadcastExchange", df._jdf.queryExecution().executedPlan().toString()))


@pytest.fixture()
def laid_out(spark, tmp_path):
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet").withColumnRenamed("o_custkey", "custkey")
    customers = spark.read.parquet(f"{FOLDER}/customer.parquet").withColumnRenamed("c_custkey", "custkey")
    return (orders, customers, tw.write_layout(orders, "lo", str(tmp_path / "o"), "custkey", 4, ["o_orderdate", "o_orderkey"]),
            tw.write_layout(customers, "lc", str(tmp_path / "c"), ["custkey"], 4))


def same(a, b):
    return a.columns == b.columns and a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_joins_and_windows_without_a_shuffle(spark, laid_out, no_broadcast):
    orders, customers, o, c = laid_out
    joined = tw.join_dataframes(o, c, "custkey", "inner")
    assert exchanges(joined) == 0 < exchanges(tw.join_dataframes(orders, customers, "custkey", "inner"))
    assert same(joined, tw.join_dataframes(orders, customers, "custkey", "inner"))
    order = ["o_orderdate", "o_orderkey"]
    windows = [lambda d: tw.add_row_number(d, "custkey", order), lambda d: tw.add_rank(d, "custkey", "o_orderdate", "rank"),
               lambda d: tw.add_lag_lead(d, "custkey", order, "o_totalprice", 1, "lag"),
               lambda d: tw.add_running_total(d, "custkey", order, "o_totalprice")]
    for window in windows:
        assert exchanges(window(o)) == 0 < exchanges(window(orders))
    assert same(windows[0](o), windows[0](orders))
    grouped = tw.group_and_aggregate(o, "custkey", {"o_totalprice": "max"})
    assert exchanges(grouped) == 0


def test_layout_is_kept_by_the_catalogue_and_checked(spark, laid_out, tmp_path):
    assert tw.read_layout(spark, "lo").count() == laid_out[0].count()
    assert tw.buckets_for(spark, f"{FOLDER}/orders.parquet") == 1
    assert tw.buckets_for(spark, f"{FOLDER}/orders.parquet", 1 << 12) > 1
    again = tw.write_layout(laid_out[1].limit(5), "lo", str(tmp_path / "n"), "custkey", 2)
    assert again.count() == 5
    for keys, buckets in (([], 2), ("custkey", 0), ("missing", 2)):
        with pytest.raises(ValueError):
            tw.write_layout(laid_out[0], "bad", str(tmp_path / "b"), keys, buckets)


def test_states_answer_for_any_parts(spark):
    rows = [(p, i % (50 * (p + 1)), None if i % 9 == 0 else float(i % 7) * (-0.0 if i % 2 else 1), "x") for p in range(4) for i in range(2000)]
    rows += [(None, 1, None, "y"), (9, 5, None, "x")]
    df = spark.createDataFrame(rows, "part int, whole int, number double, text string")
    states = tw.distinct_states(df, "part")
    assert states.count() == 6 * 3
    table = {None: df, "low": df.where("part < 2"), "gap": df.where("part is null"), "one": df.where("part = 9")}
    chosen = {None: states, "low": states.where("part < 2"), "gap": states.where("part is null"), "one": states.where("part = 9")}
    for label, part in table.items():
        exact = {r["feature"]: r["unique_count"] for r in tw.unique_count(part.drop("part")).collect()}
        for r in tw.unique_of(chosen[label]).collect():
            assert r["low"] <= exact[r["feature"]] <= r["high"] and r["rows"] == part.count()
            assert abs(r["unique_estimate"] - exact[r["feature"]]) <= 0.03 * exact[r["feature"]]
    by_part = {(r["part"], r["feature"]): r["unique_estimate"] for r in tw.unique_of(states, "part").collect()}
    assert by_part[None, "text"] == 1 and by_part[9, "number"] == 1 and by_part[0, "whole"] == 50
    assert tw.unique_of(tw.distinct_states(df.limit(0), "part")).count() == 0
