"""Fits that are saved, loaded and applied elsewhere; unreadable cells of CSV files."""

import datetime
import decimal
import math

import pytest
from pyspark.sql import functions as F

import tabwright as tw
from tabwright.operators.transforms import Fitted


@pytest.fixture()
def rows(spark):
    return spark.createDataFrame(
        [(i, None if i % 4 == 0 else float(i * i), "abc"[i % 3] if i % 7 else None, f"u{i}", "x" if i % 2 else "y") for i in range(60)],
        "id int, v double, flag string, code string, side string")


def same(a, b):
    return a.schema == b.schema and sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


@pytest.mark.parametrize("name, kind, options", [
    ("v", "fill_median", {}), ("v", "standard_scale", {"ddof": 0}), ("v", "minmax_scale", {}), ("v", "cap_outliers_iqr", {}),
    ("v", "log", {"shift": False}), ("v", "binning", {"bins": 7}), ("flag", "fill_mode", {}), ("flag", "label_encode", {}),
    ("v", "fill_value", {"value": 3.5}),
])
def test_each_transform_survives_a_round_trip(spark, rows, tmp_path, name, kind, options):
    fit = tw.fit(rows.where("id < 40"), name, kind, **options)
    loaded = tw.load_fit(spark, tw.save_fit(spark, fit, str(tmp_path / "f")))
    assert len(loaded) == 1 and same(tw.apply_fit(rows, loaded), fit.apply(rows))


def test_cleaning_survives_and_new_values_have_a_defined_result(spark, rows, tmp_path):
    first = rows.where("id < 40")
    fit = tw.fit_clean(first, max_levels=10, keep=["id"])
    assert same(fit.apply(first), tw.auto_clean(first, max_levels=10, keep=["id"]))
    loaded = tw.load_fit(spark, tw.save_fit(spark, [fit], str(tmp_path / "f")))
    assert same(tw.apply_fit(rows, loaded), fit.apply(rows))
    odd = spark.createDataFrame([(100, None, "new", "u1000", "z", 1)], "id int, v double, flag string, code string, side string, more int")
    got = tw.apply_fit(odd, loaded).first()
    assert got["side"] is None and got["code"] is None and (got["flag_b"], got["flag_c"], got["more"]) == (0, 0, 1)
    assert got["v"] is not None
    with pytest.raises(ValueError):
        tw.apply_fit(rows.drop("v"), loaded)


def test_masks_and_an_empty_cleaning(spark, tmp_path):
    df = spark.createDataFrame([("a@b.c", "n", 1), ("d", "m", 2)], "contact string, user_name string, x int")
    fit = tw.fit_clean(df, mask_pii=True)
    (loaded,) = tw.load_fit(spark, tw.save_fit(spark, fit, str(tmp_path / "a")))
    assert same(loaded.apply(df), fit.apply(df)) and loaded.masks == fit.masks
    plain = spark.createDataFrame([(1,), (2,)], "x int")
    (loaded,) = tw.load_fit(spark, tw.save_fit(spark, tw.fit_clean(plain), str(tmp_path / "b")))
    assert isinstance(loaded, tw.Cleaning) and same(loaded.apply(plain), plain)
    (loaded,) = tw.load_fit(spark, tw.save_fit(spark, tw.fit_encoding(df.drop("x")), str(tmp_path / "c")))
    assert isinstance(loaded, tw.Encoding)


def test_values_of_all_types_come_back(spark, tmp_path):
    values = {"a": 1, "b": -0.1, "c": math.inf, "d": "ä\n'", "e": True, "f": None, "g": decimal.Decimal("1.20"),
              "h": datetime.datetime(2024, 2, 29, 1, 2, 3, 4), "i": datetime.date(2024, 2, 29), "j": ""}
    (loaded,) = tw.load_fit(spark, tw.save_fit(spark, Fitted("abs", "x", values, {}), str(tmp_path / "f")))
    assert loaded.params == values and [type(v) for v in loaded.params.values()] == [type(v) for v in values.values()]
    with pytest.raises(ValueError, match="cannot store"):
        tw.save_fit(spark, Fitted("abs", "x", {"a": object()}, {}), str(tmp_path / "g"))


def test_bad_cells_of_odd_files(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('id,v,flag,day\n1,1.5,true,2024-02-29\n2,"1,5",yes,2024-02-30\n3,,,\nx,NaN,false," 2024-01-01"\n99999999999,1e3,no,soon\n')
    table, account = tw.read_csv_checked(spark, str(path), "id int, v double, flag boolean, day date")
    bad = sorted((r["column"], r["text"]) for r in account.collect())
    assert ("v", "1,5") in bad and ("id", "x") in bad and ("id", "99999999999") in bad and ("day", "2024-02-30") in bad and ("day", "soon") in bad
    assert not [b for b in bad if b[1] in ("", "1.5", "true", "1e3")]
    nulls = table.select([F.count_if(F.col(c).isNull()).alias(c) for c in table.columns]).first().asDict()
    counts = {r["column"]: r["bad_cells"] for r in tw.bad_cell_counts(account).collect()}
    assert nulls == {c: counts.get(c, 0) + 1 - (c == "id") for c in table.columns}  # the third row has three empty cells
    keys = {r["text"]: r["row_key"] for r in account.collect()}
    assert keys["99999999999"] == keys["soon"] != keys["x"]
    texts, none = tw.read_csv_checked(spark, str(path), "id string, v string, flag string, day string")
    assert none.count() == 0 and texts.count() == 5
    audit = {r["feature"]: r["bad_cells"] for r in tw.missing_audit_checked(table, account).collect()}
    assert audit == counts | {"flag": 0}  # its empty cells are missing, not unreadable
