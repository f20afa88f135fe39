"""Hand-written frames for the cases the tables do not have, and metamorphic checks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import tabwright as tw


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.createDataFrame(
        [(1, -2.0), (2, -1.0), (3, 0.0), (4, None), (5, math.nan), (6, 10.0)], "i int, x double")


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(1, "a"), (2, "12"), (3, ""), (4, None)], "i int, s string")


def values(df, name, key="i"):
    return [r[name] for r in df.orderBy(key).collect()]


def same(found, expected):
    assert len(found) == len(expected)
    for a, b in zip(found, expected):
        if b is None or isinstance(b, (str, bool)):
            assert a == b
        elif math.isnan(b):
            assert math.isnan(a)
        else:
            assert a == pytest.approx(b)


# columns

def test_cast_gives_null_or_raises_when_strict(texts):
    assert values(tw.cast_column(texts, "s", "int"), "s") == [None, 12, None, None]
    with pytest.raises(Exception):
        tw.cast_column(texts, "s", "int", strict=True).collect()
    with pytest.raises(ValueError):
        tw.cast_column(texts, "s", "date")


def test_unknown_arguments_raise(numbers, texts):
    for call in (
        lambda: tw.filter_rows(numbers, "x", "~", 1),
        lambda: tw.filter_rows(numbers, "x", ">", "abc"),
        lambda: tw.filter_rows(numbers, "none", ">", 1),
        lambda: tw.add_or_modify_column(numbers, "x", "cube"),
        lambda: tw.text_column(texts, "s", "title"),
        lambda: tw.join_dataframes(numbers, texts, "i", "sideways"),
        lambda: tw.join_dataframes(numbers, texts, [], "inner"),
        lambda: tw.group_and_aggregate(numbers, "i", {}),
        lambda: tw.group_and_aggregate(numbers, "i", {"x": "product"}),
        lambda: tw.window_function(numbers, "ntile", "i", "x"),
        lambda: tw.window_function(numbers, "lag", "i", "x"),
        lambda: tw.add_rank(numbers, "i", "x", "percent_rank"),
        lambda: tw.transform(numbers, "x", "cube"),
        lambda: tw.transform(texts, "s", "log"),
        lambda: tw.transform(numbers, "x", "log", speed=3),
        lambda: tw.fill_nulls(numbers, "x", "guess"),
        lambda: tw.correlation_matrix(numbers, ["x"]),
        lambda: tw.fit_pca(numbers, ["x"]),
        lambda: tw.chart(numbers, "pie", "i", "x"),
        lambda: tw.scatter(numbers, "i", "x", rows=1),
        lambda: tw.histogram(texts, "s"),
        lambda: tw.write_csv(numbers, "/nowhere", "replace"),
        lambda: tw.scrub_pii(texts, mode="row"),
        lambda: tw.sort_data(numbers, []),
    ):
        with pytest.raises(ValueError):
            call()


def test_names_with_dots_and_blanks(spark):
    df = spark.createDataFrame([(1, 2.0, "a"), (1, 3.0, "b")], "`a.b` int, `Email Addr` double, `c d` string")
    assert tw.select_columns(df, ["a.b"]).columns == ["a.b"]
    assert tw.filter_rows(df, "Email Addr", ">", "2.5").count() == 1
    assert [r[1] for r in tw.group_and_aggregate(df, "a.b", {"Email Addr": "sum"}).collect()] == [5.0]
    assert tw.add_row_number(df, "a.b", "Email Addr", hot_rows=0).count() == 2
    assert {r["feature"] for r in tw.full_audit(df).collect()} == {"a.b"}
    assert tw.transform(df, "Email Addr", "fill_median").count() == 2
    assert tw.drop_duplicates(df, "a.b", ["c d"]).count() == 1


def test_replace_and_conditional_with_null(texts, numbers):
    assert values(tw.replace_values(texts, "s", "a", None), "s") == [None, "12", "", None]
    assert values(tw.replace_values(texts, "s", None, "z"), "s") == ["a", "12", "", "z"]
    assert values(tw.conditional_column(numbers, "c", "x", 0), "c")[:4] == ["Low", "Low", "Low", "Low"]


def test_drop_nulls_keeps_nan_unless_asked(numbers):
    assert tw.drop_nulls(numbers).count() == 5
    assert tw.drop_nulls(numbers, nan_as_null=True).count() == 4


def test_edits_and_text(numbers, texts):
    same(values(tw.add_or_modify_column(numbers, "x", "reciprocal", "y"), "y"),
         [-0.5, -1.0, None, None, math.nan, 0.1])
    same(values(tw.add_or_modify_column(numbers, "x", "log"), "x"),
         [None, None, 0.0, None, math.nan, math.log(11)])
    assert values(tw.text_column(texts, "s", "length"), "s_length") == [1, 2, 0, None]
    assert values(tw.text_column(texts, "s", "reverse"), "s") == ["a", "21", "", None]


# relational

def test_joins_on_null_and_repeated_keys(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, l string")
    right = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z"), (None, "w")], "k int, r string")
    sizes = {how: tw.join_dataframes(left, right, "k", how).count()
             for how in ("inner", "left", "right", "outer", "cross", "semi", "anti")}
    assert sizes == {"inner": 4, "left": 6, "right": 6, "outer": 8, "cross": 4, "semi": 2, "anti": 2}


def test_modes_break_ties_low_and_skip_nulls(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (None, None), (None, None), (None, None)],
                               "n int, s string")
    assert tw.mode(df, "n").first()[0] == 1
    found = {r["feature"]: r for r in tw.modes(df, ["n", "s"]).collect()}
    assert (found["s"]["top"], found["s"]["freq"], found["s"]["unique"]) == ("a", 1, 2)
    assert tw.mode(df.where("n > 5"), "n").first() is None


def test_unique_counts_null_once(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (None,)], "n int")
    assert tw.unique_count(df).first()["unique_count"] == 2
    assert tw.unique_count(df, approximate=True).first()["unique_count"] == 2
    assert tw.unique_count(df.limit(0)).first()["unique_count"] == 0


def test_sort_null_order_and_previews(spark):
    df = spark.createDataFrame([(3,), (None,), (1,)], "n int")
    assert [r[0] for r in tw.sort_data(df, "n").collect()] == [None, 1, 3]
    assert [r[0] for r in tw.sort_data(df, "n", False).collect()] == [3, 1, None]
    assert [r[0] for r in tw.preview(df, 2, "n").collect()] == [None, 1]
    assert tw.shape(df).first()["row_count"] == 3


def test_duplicates_keep_the_lowest_row(spark):
    df = spark.createDataFrame([("a", 2, 5.0), ("a", 1, 9.0), ("b", 3, 1.0), ("b", 3, 1.0)],
                               "k string, o int, v double").repartition(4)
    assert sorted(map(tuple, tw.drop_duplicates(df, "k").collect())) == [("a", 1, 9.0), ("b", 3, 1.0)]
    assert tw.drop_duplicates(df).count() == 3
    last = tw.drop_duplicates(df, "k", [F.col("o").desc()])
    assert sorted(r["o"] for r in last.collect()) == [2, 3]


# transforms

def test_transforms_on_edge_values(numbers):
    nan = math.nan
    cases = {
        ("sqrt", ()): [0.0, 0.0, 0.0, None, nan, math.sqrt(10)],
        ("sqrt", (("clip", False),)): [math.sqrt(2), 1.0, 0.0, None, nan, math.sqrt(10)],
        ("log", ()): [math.log(2), math.log(3), math.log(4), None, nan, math.log(14)],
        ("log", (("shift", False),)): [None, None, 0.0, None, nan, math.log(11)],
        ("square", ()): [4.0, 1.0, 0.0, None, nan, 100.0],
        ("abs", ()): [2.0, 1.0, 0.0, None, nan, 10.0],
        ("reciprocal", ()): [-0.5, -1.0, None, None, nan, 0.1],
        ("fill_zero", ()): [-2.0, -1.0, 0.0, 0.0, nan, 10.0],
        ("fill_mean", (("nan_as_null", True),)): [-2.0, -1.0, 0.0, 1.75, 1.75, 10.0],
        ("fill_median", (("nan_as_null", True),)): [-2.0, -1.0, 0.0, -0.5, -0.5, 10.0],
        ("minmax_scale", (("nan_as_null", True),)): [0.0, 1 / 12, 1 / 6, None, None, 1.0],
        ("fill_value", (("value", 7.0),)): [-2.0, -1.0, 0.0, 7.0, nan, 10.0],
    }
    for (kind, options), expected in cases.items():
        same(values(tw.transform(numbers, "x", kind, **dict(options)), "x"), expected)


def test_transforms_leave_constant_empty_and_null_columns(spark):
    constant = spark.createDataFrame([(1, 5.0), (2, 5.0)], "i int, x double")
    nulls = spark.createDataFrame([(1, None), (2, None)], "i int, x double")
    for kind in ("standard_scale", "minmax_scale", "binning_5"):
        assert values(tw.transform(constant, "x", kind), "x") == [5.0, 5.0]
    for kind in tw.TRANSFORMS:
        options = {"value": 1.0} if kind == "fill_value" else {}
        filled = {"fill_zero": 0.0, "fill_value": 1.0}
        if kind not in ("drop_nulls", "drop_duplicates"):
            found = values(tw.transform(nulls, "x", kind, **options), "x")
            assert found == [filled.get(kind)] * 2, kind
        assert tw.transform(nulls.limit(0), "x", kind, **options).count() == 0


def test_bins_are_closed_on_the_right(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(6)] + [(9, None)], "i int, x double")
    assert values(tw.transform(df, "x", "binning_5"), "x") == [
        "Bin 1", "Bin 1", "Bin 2", "Bin 3", "Bin 4", "Bin 5", None]


def test_median_of_ints_is_not_cut(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "i int, x int")
    assert values(tw.fill_nulls(df, "x", "median"), "x") == [1.0, 2.0, 1.5]
    assert values(tw.fill_nulls(df, "x", "mean"), "x") == [1.0, 2.0, 1.5]
    assert values(tw.fill_nulls(df, "x", "median", accuracy=1000), "x")[2] in (1.0, 2.0)


def test_fit_is_reusable_and_scales(spark):
    train = spark.createDataFrame([(1, 0.0), (2, 10.0)], "i int, x double")
    other = spark.createDataFrame([(1, 5.0), (2, 20.0)], "i int, x double")
    fitted = tw.fit(train, "x", "minmax_scale")
    assert values(fitted.apply(other), "x") == [0.5, 2.0]
    scaled = tw.transform(spark.range(100).selectExpr("id as i", "cast(id as double) as x"),
                          "x", "standard_scale").agg(F.avg("x"), F.stddev("x")).first()
    assert scaled[0] == pytest.approx(0, abs=1e-12) and scaled[1] == pytest.approx(1)


def test_label_codes_follow_the_sorted_values(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "b")], "i int, s string")
    assert values(tw.transform(df, "s", "label_encode"), "s") == [1, 0, None, 1]
    assert tw.transform(df, "s", "label_encode").columns == ["i", "s"]
    assert tw.transform(df, "s", "label_encode", "code").columns == ["i", "s", "code"]


# profile

def test_audit_texts_and_clean_row(spark):
    rows = [(None if i < 9 else 1.0 * i, "x", 1000.0 if i == 0 else 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "a double, b string, c double")
    found = {(r["feature"], r["issue"]): (r["severity"], r["action"]) for r in tw.full_audit(df).collect()}
    assert found[("a", "Missing Values")] == ("45.0% Null", "Drop Column")
    assert found[("b", "Constant/Zero Variance")] == ("Danger", "🗑️ Drop this column")
    assert found[("c", "High Skew")][0] == "Skewness: 4.13"
    strict = {(r["feature"], r["issue"]): r["severity"] for r in tw.full_audit(df, tw.STRICT).collect()}
    assert strict[("a", "Missing Values")] == "45.0% Null" and strict[("c", "High Skew")] == "Skewness: 4.13"
    clean = tw.missing_audit(df.select("b")).collect()
    assert [tuple(r)[:4] for r in clean] == [("All", "None", "Clean", "Ready")]
    badges = {r["feature"]: r["badge"] for r in tw.audit_severity(tw.full_audit(df)).collect()}
    assert badges == {"a": "danger", "b": "success", "c": "danger"}
    assert [r["feature"] for r in tw.critical_audit(tw.full_audit(df)).collect()] == ["a", "c"]
    assert tuple(tw.scorecard(df).first()) == (20, 1, 1)


def test_constant_rule_counts_null_as_a_value(spark):
    df = spark.createDataFrame(
        [(1, None, 1.0, math.nan, 2**60), (1, None, None, math.nan, 2**60 + 1)],
        "same int, nulls string, half double, nans double, big bigint")
    found = {m.feature: m.is_constant for m in tw.measure(df)}
    assert found == {"same": True, "nulls": True, "half": False, "nans": True, "big": False}


def test_profile_of_odd_tables(spark):
    nested = spark.createDataFrame([(1, [1, 2], {"a": 1}), (2, None, None)],
                                   "i int, a array<int>, m map<string,int>")
    by_name = {m.feature: m for m in tw.measure(nested)}
    assert by_name["m"].null_count == 1 and not by_name["a"].is_constant
    empty = spark.createDataFrame([], "x double, s string")
    assert {r["issue"] for r in tw.full_audit(empty).collect()} == {"Constant/Zero Variance"}
    assert tw.profile(empty).rows == 0
    one = spark.createDataFrame([(1.0,)], "x double")
    assert tw.feature_stats(one, top=True).first()["50%"] == 1.0
    wide = spark.range(50).select(*[(F.col("id") * i).alias(f"c{i}") for i in range(30)])
    assert [m.feature for m in tw.measure(wide)] == wide.columns
    assert {m.mean for m in tw.measure(wide)} == {24.5 * i for i in range(30)}


def test_nan_is_counted_and_can_be_left_out(numbers):
    raw, cleaned = tw.measure(numbers, ["x"])[0], tw.measure(numbers, ["x"], nan_as_null=True)[0]
    assert raw.nan_count == 1 and raw.null_count == 1 and math.isnan(raw.mean)
    assert cleaned.mean == pytest.approx(1.75) and cleaned.null_count == 2


def test_correlation_of_200_columns_hands_on_one_matrix_per_task(spark, monkeypatch):
    from tabwright.operators import profile

    rng = np.random.default_rng(9)
    table = rng.normal(size=(300, 200)) + rng.normal(size=(300, 1))
    rows = [[None if j < 5 and (i + j) % 4 == 0 else float(v) for j, v in enumerate(row)] for i, row in enumerate(table)]
    df = spark.createDataFrame(rows, ", ".join(f"c{j} double" for j in range(200))).repartition(3)
    widths, gram = [], profile._gram
    monkeypatch.setattr(profile, "_gram", lambda d, cells, n: widths.append(len(cells)) or gram(d, cells, n))
    found = {(r["x"], r["y"]): r["corr"] for r in tw.correlation_matrix(df).collect()}
    assert len(found) == 200 * 200
    assert widths == [1 + 200 + 5 + 200]  # a task hands on the products of that many cells, not rows
    values = np.array([[math.nan if v is None else v for v in row] for row in rows])
    for i, j in [(0, 1), (0, 199), (3, 3), (150, 2), (198, 199), (77, 78)]:
        both = ~np.isnan(values[:, i]) & ~np.isnan(values[:, j])
        assert found[f"c{i}", f"c{j}"] == pytest.approx(np.corrcoef(values[both, i], values[both, j])[0, 1], abs=1e-12)


def test_correlation_equals_numpy_pair_by_pair(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(400, 7)) * [1, 10, 1e6, 1e-6, 1, 1, 1] + [0, 5, 1e9, 0, 0, 0, 3]
    data[:, 4] += data[:, 0]
    data[:, 6] = 3.0
    rows = data.tolist()
    for i in range(400):
        if i % 3 == 0:
            rows[i][1] = None
        if i % 4 == 1:
            rows[i][4] = None
    df = spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(7)))
    found = {(r["x"], r["y"]): r["corr"] for r in tw.correlation_matrix(df).collect()}
    assert len(found) == 49
    table = np.array([[math.nan if v is None else v for v in row] for row in rows])
    for i in range(7):
        for j in range(7):
            if 6 in (i, j):
                assert found[f"c{i}", f"c{j}"] is None
                continue
            both = ~np.isnan(table[:, i]) & ~np.isnan(table[:, j])
            expected = np.corrcoef(table[both, i], table[both, j])[0, 1]
            assert found[f"c{i}", f"c{j}"] == pytest.approx(expected, abs=1e-6)


# masking and encoding

def test_pii_by_name_and_density(spark):
    rows = [(1, "x@y.org or call" if i < 2 else "none", "n", None) for i in range(10)]
    df = spark.createDataFrame(rows, "i int, body string, IP_Address string, Email string")
    found = tw.find_pii(df)
    assert (found.by_name, found.by_density) == (["IP_Address", "Email"], ["body"])
    masked = tw.scrub_pii(df)
    assert {tuple(r) for r in masked.collect()} == {(1, "[REDACTED_EMAIL]", "[REDACTED]", "[REDACTED]")}
    cells = {r["body"] for r in tw.scrub_pii(df, mode="cell").collect()}
    assert cells == {"[REDACTED_EMAIL] or call", "none"}
    assert tw.find_pii(df.limit(0)).by_density == []
    tenth = spark.createDataFrame([("a@b",)] + [("c",)] * 9, "t string")
    assert tw.find_pii(tenth).by_density == []  # exactly a tenth is not more than a tenth


def test_encoders(spark):
    df = spark.createDataFrame([(1, "n", "x", True), (2, "y", "z", None), (3, None, "w", False),
                                (4, "y", None, True)], "i int, b string, c string, f boolean")
    encoded = tw.fit_encoding(df).apply(df).orderBy("i")
    assert encoded.columns == ["i", "b", "f", "c_x", "c_z"]
    assert [tuple(r) for r in encoded.collect()] == [
        (1, 0, 1, 1, 0), (2, 1, None, 0, 1), (3, None, 0, 0, 0), (4, 1, 1, 0, 0)]
    assert tw.binary_encode(df).columns == df.columns
    assert tw.one_hot(df, ["b"]).columns == ["i", "c", "f", "b_y"]
    coded = tw.one_hot(df, ["c"], max_levels=2)
    assert coded.columns == df.columns and {r["c"] for r in coded.collect()} >= {0, 1, 2}
    log = {r["detail"] for r in tw.encoding_log(df).collect()}
    assert log == {"Binary Encoded 'b': 'n'->0, 'y'->1", "Binary Encoded 'f': 'false'->0, 'true'->1",
                   "One-Hot Encoded: c"}
    numbers = df.select("i")
    assert tw.encoding_log(numbers).first()["detail"] == "No categorical columns required encoding."


def test_auto_clean_leaves_no_nulls_and_no_text(spark):
    df = tw.generate_sales(spark)
    cleaned = tw.auto_clean(df)
    assert all(f.dataType.typeName() != "string" for f in cleaned.schema.fields)
    assert tw.drop_nulls(cleaned).count() == 1000
    assert {"Product_Category_Home", "Region_EMEA"} <= set(cleaned.columns)
    assert cleaned.agg(F.max("Sales_Amount")).first()[0] == pytest.approx(math.log1p(99000.0))


# charts and models

def test_histogram_and_distribution_keep_every_row(spark):
    df = spark.range(1000).select((F.col("id") % 37).cast("double").alias("x"), F.lit("c").alias("s"))
    assert tw.histogram(df, "x").agg(F.sum("count")).first()[0] == 1000
    assert tw.histogram(df, "x", 7).count() == 7
    expected = np.histogram(np.arange(1000) % 37.0, bins=7)[0].tolist()
    assert [r["count"] for r in tw.histogram(df, "x", 7).orderBy("bin").collect()] == expected
    auto = np.histogram_bin_edges(np.arange(1000) % 37.0, "auto")
    assert tw.histogram(df, "x").orderBy("bin").first()["high"] == pytest.approx(auto[1])
    assert tw.distribution(df, "s").first()["count"] == 1000
    one = tw.histogram(df.limit(5).select(F.lit(3.0).alias("x")), "x").collect()
    assert [(r["low"], r["high"], r["count"]) for r in one] == [(2.5, 3.5, 5)]
    assert tw.histogram(df.limit(0), "x").count() == 0


def test_density_curve_is_close_to_the_exact_one(spark):
    data = np.random.default_rng(1).gamma(2.0, 3.0, 3000)
    df = spark.createDataFrame([(float(v),) for v in data], "x double")
    found = tw.kde(df, "x").orderBy("point").collect()
    width = data.std(ddof=1) * len(data) ** -0.2
    for row in found[::20]:
        exact = np.exp(-0.5 * ((row["x"] - data) / width) ** 2).sum() / (
            len(data) * width * math.sqrt(2 * math.pi))
        assert row["density"] == pytest.approx(exact, rel=1e-5, abs=1e-9)
    assert len(found) == 200 and found[0]["x"] == pytest.approx(data.min())


def test_box_and_line_and_violin(spark):
    df = spark.createDataFrame([("a", float(v), "p" if v % 2 else "q") for v in range(11)]
                               + [("a", 100.0, "p"), ("b", 1.0, "q"), (None, 5.0, "p"), ("a", None, "p")],
                               "x string, y double, h string")
    box = {r["x"]: r for r in tw.box(df, "x", "y").collect()}
    assert set(box) == {"a", "b"}
    values = np.append(np.arange(11.0), 100.0)
    assert box["a"]["median"] == np.quantile(values, 0.5)
    assert (box["a"]["whisker_low"], box["a"]["whisker_high"], box["a"]["outliers"]) == (0.0, 10.0, 1)
    line = {r["x"]: r for r in tw.line(df, "x", "y").collect()}
    assert line["b"]["low"] is None and line["a"]["low"] < line["a"]["mean"] < line["a"]["high"]
    sides = {(r["h"], r["side"]) for r in tw.violin(df, "x", "y", "h").collect()}
    assert sides == {("p", "left"), ("q", "right")}
    assert tw.chart(df, "bar", "x", "y").count() == 2
    assert tw.regression_line(df.select(F.lit(1.0).alias("a"), "y"), "a", "y").first()["slope"] is None


def test_components_equal_numpy(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(300, 4))
    data[:, 1] += 2 * data[:, 0]
    data[:, 3] = 1.0
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(data.tolist())] + [(999, None, 1.0, 1.0, 1.0)],
                               "i int, a double, b double, c double, d double")
    fitted = tw.fit_pca(df, ["a", "b", "c", "d"])
    spread = data.std(axis=0)
    scaled = (data - data.mean(axis=0)) / np.where(spread > 0, spread, 1)
    _, s, vt = np.linalg.svd(scaled, full_matrices=False)
    assert fitted.explained == pytest.approx((s**2 / (s**2).sum())[:2].tolist(), abs=1e-9)
    expected = vt[:2] * np.sign(vt[:2][[0, 1], np.abs(vt[:2]).argmax(axis=1)])[:, None]
    scores = np.array([list(r)[1:] for r in fitted.apply(df, ["i"]).orderBy("i").collect()])
    assert scores.shape == (300, 2)
    assert np.abs(scores) == pytest.approx(np.abs(scaled @ expected.T), abs=1e-7)
    with pytest.raises(ValueError):
        tw.pca(df.limit(0), ["a", "b"])


def test_components_take_one_pass_after_the_means(spark, monkeypatch):
    from tabwright.operators import models

    rng = np.random.default_rng(8)
    data = rng.normal(size=(400, 3)) @ rng.normal(size=(3, 5)) + rng.normal(size=(400, 5)) * 0.1 + [1e6, 0, -50, 3, 1]
    df = spark.createDataFrame(data.tolist(), list("abcde"))
    passes, gram = [], models._gram
    monkeypatch.setattr(models, "_gram", lambda *a: passes.append(a) or gram(*a))
    fitted = tw.fit_pca(df, list("abcde"), k=5)
    values, vectors = np.linalg.eigh(np.corrcoef(data.T))
    assert len(passes) == 1 and np.allclose(fitted.explained, values[::-1] / 5)
    assert np.allclose(np.abs(fitted.loadings), np.abs(vectors.T[::-1]))
    with pytest.raises(ValueError):
        tw.fit_pca(df.limit(1), ["a", "b"])


def test_split_is_stable_and_models_learn(spark):
    df = spark.range(2000).select("id", (F.col("id") % 10).alias("f"),
                                  F.when(F.col("id") % 10 < 5, "low").otherwise("high").alias("y"),
                                  (F.col("id") % 10 * 2.0).alias("z"))
    train, test = tw.split_by_key(df, "id")
    assert train.count() + test.count() == 2000 and 300 < test.count() < 500
    assert test.join(train, "id").count() == 0
    predicted = tw.train_baseline(df.select("id", "f", "y"), "y", "id", trees=5)
    report = {r["class"]: r for r in tw.classification_report(predicted, "label", "prediction").collect()}
    assert report["accuracy"]["f1"] == 1.0 and report["macro avg"]["support"] == test.count()
    numbers = tw.train_baseline(df.select("id", "f", "z"), "z", "id", "regression", trees=5)
    assert tw.mse(numbers, "label", "prediction").first()[0] < 0.5


def test_report_with_a_class_never_predicted(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "a"), ("b", "a"), ("b", "c")], "y string, p string")
    report = {r["class"]: r for r in tw.classification_report(df, "y", "p").collect()}
    assert tuple(report["b"])[1:] == (0.0, 0.0, 0.0, 2)
    assert report["c"]["support"] == 0 and report["a"]["precision"] == pytest.approx(2 / 3)
    assert report["accuracy"]["f1"] == 0.5 and report["accuracy"]["precision"] is None


# sources

def test_csv_bad_cells_become_null(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\noops,y\n3,\n")
    df = tw.read_csv(spark, str(tmp_path / "t.csv"), "a int, b string")
    assert sorted(map(tuple, df.collect()), key=repr) == [(1, "x"), (3, None), (None, "y")]
    assert dict(tw.read_csv(spark, str(tmp_path / "t.csv")).dtypes)["a"] == "string"


def test_write_modes(spark, tmp_path):
    df, path = spark.range(3).repartition(3), str(tmp_path / "out")
    tw.write_csv(df, path, single_file=True)
    assert len(list((tmp_path / "out").glob("part-*"))) == 1
    with pytest.raises(Exception):
        tw.write_csv(df, path, "error")
    tw.write_csv(df, path, "ignore")
    tw.write_csv(df, path, "append")
    assert tw.read_csv(spark, path).count() == 6


def test_snapshots_keep_every_version(spark, tmp_path):
    path = str(tmp_path / "snap")
    df = spark.createDataFrame([(1, "a@b.cd"), (None, "c@d.ef")], "x int, contact string")
    with pytest.raises(ValueError):
        tw.load_snapshot(spark, path)
    assert tw.save_snapshot(df, path, "demo", mask_pii=True) == 1
    second = tw.transform_snapshot(spark, path, "x", "fill_zero")
    assert second.version == 2 and second.meta["context"] == "demo" and second.meta["row_count"] == 2
    assert sorted(r["x"] for r in second.data.collect()) == [0, 1]
    first = tw.load_snapshot(spark, path, 1)
    assert sorted(r["x"] is None for r in first.data.collect()) == [False, True]
    assert {r["contact"] for r in first.data.collect()} == {"[REDACTED_EMAIL]"}
    assert {r["feature"] for r in second.stats.collect()} == {"x", "contact"}
    with pytest.raises(ValueError):
        tw.load_snapshot(spark, path, 7)


def test_demo_table(spark):
    df = tw.generate_sales(spark)
    assert df.count() == 1000 and df.where("Sales_Amount = 99000").count() == 11
    assert df.where("Customer_Age is null").count() == 101
    assert df.exceptAll(tw.generate_sales(spark).repartition(5)).count() == 0
    stats = df.agg(F.avg("Marketing_Spend"), F.stddev("Marketing_Spend"), F.min("Customer_Age"),
                   F.max("Customer_Age"), F.count_distinct("Region")).first()
    assert 95 < stats[0] < 105 and 26 < stats[1] < 34 and stats[2] >= 18 and stats[3] <= 79
    assert stats[4] == 4
    issues = {(r["feature"], r["issue"]) for r in tw.full_audit(df).collect()}
    assert issues == {("Customer_Age", "Missing Values"), ("Sales_Amount", "High Skew")}


def test_schema_and_types(spark, numbers):
    assert [tuple(r) for r in tw.schema_info(numbers).collect()] == [
        ("i", "IntegerType()", True), ("x", "DoubleType()", True)]
    df = spark.createDataFrame([], "a int, b decimal(9,2), c date, d boolean, e string")
    assert {r["column"]: (r["kind"], r["encodable"]) for r in tw.type_split(df).collect()} == {
        "a": ("numeric", False), "b": ("numeric", False), "c": ("categorical", False),
        "d": ("categorical", True), "e": ("categorical", True)}
