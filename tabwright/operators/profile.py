"""Profiling: statistics, quality audit, correlation.

One pass over the table measures every column: blocks of columns are aggregated
at the same time and each column is read once. What comes back is a row per
column, from which the (small) result tables are made. These operators run
their aggregates when called.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import astuple, dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.schema import (
    as_list, categorical_columns, column, is_floating, is_numeric, is_scalar, numeric_columns,
    present, require, scalar_columns, type_of,
)
from tabwright.operators.relational import modes
from tabwright.plans.jobs import run_together
from tabwright.plans.quantiles import enclosing_values, exact_quantiles

SKEW_LIMIT = 1.5
ROUNDING = 1e-13
QUARTILES = {"25%": 0.25, "50%": 0.5, "75%": 0.75}


@dataclass(frozen=True)
class AuditRules:
    """Thresholds and wording of an audit."""

    drop_above: float
    percent_digits: int
    keep_zeros: bool
    missing_many: str
    missing_numeric: str
    missing_other: str
    high_skew: str


# Thresholds and texts of the two audits.
STANDARD = AuditRules(
    drop_above=40, percent_digits=1, keep_zeros=True,
    missing_many="Drop Column",
    missing_numeric="Impute with Median/Mean",
    missing_other="Impute with Mode",
    high_skew="Log Transform/Cap",
)
STRICT = AuditRules(
    drop_above=20, percent_digits=2, keep_zeros=False,
    missing_many="⚠️ Consider dropping column or heavy imputation",
    missing_numeric="💡 Fill with Mean/Median/Mode",
    missing_other="💡 Fill with Mean/Median/Mode",
    high_skew="💡 Apply Log/Sqrt Transform",
)
DROP_CONSTANT = "🗑️ Drop this column"
MISSING, SKEW, CONSTANT = "Missing Values", "High Skew", "Constant/Zero Variance"
CLEAN = ("All", "None", "Clean", "Ready", None)

_AUDIT_SCHEMA = "feature string, issue string, severity string, action string, metric double"
_METRIC_SCHEMA = ("feature string, is_numeric boolean, rows bigint, count bigint, "
                  "null_count bigint, nan_count bigint, mean double, std double, skew double, "
                  "min double, max double, min_text string, max_text string, is_constant boolean")


@dataclass(frozen=True)
class Measured:
    """What one pass finds out about a column. Numbers have min and max, the rest their texts."""

    feature: str
    is_numeric: bool
    rows: int
    count: int
    null_count: int
    nan_count: int
    mean: float | None
    std: float | None
    skew: float | None
    min: float | None
    max: float | None
    min_text: str | None
    max_text: str | None
    is_constant: bool

    @property
    def null_percent(self) -> float:
        return self.null_count / self.rows * 100 if self.rows else 0.0


def measure(df: DataFrame, names: Sequence[str] | None = None, nan_as_null: bool = False,
            adjusted_skew: bool = False) -> list[Measured]:
    """One ``Measured`` per column, in the order of the names."""
    names = as_list(names) or df.columns
    require(df, *names)
    numbers = [n for n in names if is_numeric(type_of(df, n))]
    others = [n for n in names if n not in numbers]
    parts = run_together(df.sparkSession, lambda work: work(), [
        *([lambda: _number_measures(df, numbers, nan_as_null)] if numbers else []),
        *([lambda: _other_measures(df, others)] if others else [])])
    got = {name: row for part in parts for name, row in part.items()}
    return [_measured(df, n, got[n], adjusted_skew) for n in names]


def _number_measures(df: DataFrame, names: Sequence[str], nan_as_null: bool) -> dict[str, dict]:
    """The measures of all numeric columns from one scan: cells turned into rows, one grouped aggregate.

    Its expressions are the same few however many columns there are, and combine in the map tasks.
    """
    cells = []
    for i, name in enumerate(names):
        dtype, value = type_of(df, name), present(df, name, nan_as_null)
        nan = F.isnan(column(name)) if is_floating(dtype) else F.lit(False)
        whole = value.cast("bigint") if isinstance(dtype, T.IntegralType) else F.lit(None).cast("bigint")
        cells.append(F.struct(F.lit(i).alias("i"), value.cast("double").alias("x"), whole.alias("w"), nan.alias("nan")))
    x = F.col("x")
    found = df.select(F.inline(F.array(*cells))).groupBy("i").agg(
        F.count(F.lit(1)).alias("rows"), F.count(x).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"),
        F.coalesce(F.min("w") == F.max("w"), F.min(x) == F.max(x)).alias("same"),
        F.count_if("nan").alias("nan"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        F.skewness(x).alias("skew")).collect()
    got = {names[r["i"]]: r.asDict() for r in found}
    return {n: got.get(n, {"rows": 0, "n": 0, "same": None}) for n in names}


def _other_measures(df: DataFrame, names: Sequence[str]) -> dict[str, dict]:
    """The measures of the other columns from one scan."""
    exprs = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(names):
        value = column(name)
        exprs.append(F.count(value).alias(f"n{i}"))
        if is_scalar(type_of(df, name)):
            low, high = F.min(value), F.max(value)
            exprs += [low.cast("string").alias(f"low{i}"), high.cast("string").alias(f"high{i}"),
                      (low == high).alias(f"same{i}")]
    row = df.agg(*exprs).first().asDict()
    return {name: {"rows": row["rows"], "n": row[f"n{i}"], "low": row.get(f"low{i}"),
                   "high": row.get(f"high{i}"), "same": row.get(f"same{i}")} for i, name in enumerate(names)}


def _measured(df: DataFrame, name: str, got: dict, adjusted_skew: bool) -> Measured:
    dtype = type_of(df, name)
    numeric, n, rows = is_numeric(dtype), got["n"], got["rows"]
    low, high, skew = got.get("low"), got.get("high"), got.get("skew")
    if skew is not None and adjusted_skew:
        skew = skew * math.sqrt(n * (n - 1)) / (n - 2) if n > 2 else None
    # at most one distinct value, with null as one of them; only scalars are compared
    constant = is_scalar(dtype) and (n == 0 or (n == rows and bool(got["same"])))
    bounds = (low, high, None, None) if numeric else (None, None, low, high)
    return Measured(name, numeric, rows, n, rows - n, got.get("nan", 0), got.get("mean"),
                    got.get("std"), skew, *bounds, constant)


def column_metrics(df: DataFrame, names: Sequence[str] | None = None, nan_as_null: bool = False,
                   adjusted_skew: bool = False) -> DataFrame:
    """``measure`` as a table, one row per column."""
    found = measure(df, names, nan_as_null, adjusted_skew)
    return df.sparkSession.createDataFrame([astuple(m) for m in found], _METRIC_SCHEMA)


def type_split(df: DataFrame, observed: bool = False) -> DataFrame:
    """(column, kind, encodable): numeric or categorical, and whether the encoders take it.

    ``observed=True`` counts the distinct values of each encodable column: levels, and the flags
    binary (two levels) and constant (at most one).
    """
    encodable = categorical_columns(df, encodable_only=True)
    rows = [(f.name, "numeric" if is_numeric(f.dataType) else "categorical", f.name in encodable)
            for f in df.schema.fields]
    split = df.sparkSession.createDataFrame(rows, "column string, kind string, encodable boolean")
    if not observed:
        return split
    levels = {r["feature"]: r["unique"] for r in modes(df, encodable).collect()} if encodable else {}
    counted = df.sparkSession.createDataFrame(
        [(n, levels.get(n, 0), levels.get(n, 0) == 2, levels.get(n, 0) <= 1) for n in encodable],
        "column string, levels bigint, binary boolean, constant boolean")
    return split.join(counted, "column", "left")


def describe_data(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """count, mean, stddev, min, max: (feature, statistic, value, text).

    ``value`` holds numbers, ``text`` the bounds of non-numeric columns.
    """
    return _long(df, measure(df, as_list(names) or scalar_columns(df)), {})


def summary_data(df: DataFrame, names: Sequence[str] | None = None,
                 accuracy: int | None = None) -> DataFrame:
    """As ``describe_data`` with 25 %, 50 % and 75 %, exact unless ``accuracy`` is given."""
    return _long(df, *_measured_with_quartiles(df, as_list(names) or scalar_columns(df), accuracy, False))


Quartiles = dict[str, list[float | None]]


def _measured_with_quartiles(df: DataFrame, names: Sequence[str] | None, accuracy: int | None,
                             nan_as_null: bool) -> tuple[list[Measured], Quartiles]:
    """The measures and quartiles of the columns: measures and sketches in scans at the same time, then one scan."""
    numbers = [n for n in as_list(names) or df.columns if is_numeric(type_of(df, n))]
    probs = list(QUARTILES.values())
    found, enclosed = run_together(df.sparkSession, lambda work: work(), [
        lambda: measure(df, names, nan_as_null),
        lambda: {} if accuracy or not numbers else enclosing_values(df, numbers, probs, nan_as_null)])
    if not accuracy:
        known = {m.feature: (m.count, m.min, m.max) for m in found if m.is_numeric}
        quartiles = exact_quantiles(df, list(known), probs, known, nan_as_null, enclosed=enclosed)
    else:
        row = df.agg(F.count(F.lit(1)), *[
            F.percentile_approx(present(df, n, nan_as_null).cast("double"), probs, accuracy).alias(str(i))
            for i, n in enumerate(numbers)]).first()
        quartiles = {n: row[str(i)] or [None] * len(probs) for i, n in enumerate(numbers)}
    empty: list[float | None] = [None] * len(probs)
    return found, {m.feature: quartiles.get(m.feature, empty) for m in found}


def _long(df: DataFrame, found: Sequence[Measured], quartiles: Quartiles) -> DataFrame:
    rows = []
    for m in found:
        rows += [(m.feature, "count", float(m.count), None), (m.feature, "mean", m.mean, None),
                 (m.feature, "stddev", m.std, None), (m.feature, "min", m.min, m.min_text)]
        rows += [(m.feature, label, value, None)
                 for label, value in zip(QUARTILES, quartiles.get(m.feature, []))]
        rows.append((m.feature, "max", m.max, m.max_text))
    return df.sparkSession.createDataFrame(
        rows, "feature string, statistic string, value double, text string")


def _stats(df: DataFrame, found: Sequence[Measured], quartiles: Quartiles) -> DataFrame:
    rows = [(m.feature, m.count, m.null_count, m.nan_count, m.mean, m.std, m.min,
             *quartiles[m.feature], m.max, m.min_text, m.max_text) for m in found]
    return df.sparkSession.createDataFrame(
        rows, "feature string, count bigint, null_count bigint, nan_count bigint, mean double, "
              "std double, min double, `25%` double, `50%` double, `75%` double, max double, "
              "min_text string, max_text string")


def feature_stats(df: DataFrame, top: bool = False, accuracy: int | None = None,
                  nan_as_null: bool = False) -> DataFrame:
    """One row per column with its statistics; ``top=True`` adds unique, top and freq.

    unique, top and freq are given for non-numeric columns, as text.
    """
    others = [n for n in scalar_columns(df) if not is_numeric(type_of(df, n))] if top else []
    (found, quartiles), best = run_together(df.sparkSession, lambda work: work(), [
        lambda: _measured_with_quartiles(df, None, accuracy, nan_as_null),
        lambda: modes(df, others) if others else None])
    stats = _stats(df, found, quartiles)
    if not top:
        return stats
    if others:
        return stats.join(best, "feature", "left")
    return stats.withColumns({"unique": F.lit(None).cast("bigint"),
                              "top": F.lit(None).cast("string"),
                              "freq": F.lit(None).cast("bigint")})


def _missing_row(m: Measured, rules: AuditRules, drop_above: float) -> tuple | None:
    percent = m.null_percent
    shown = round(percent, rules.percent_digits)
    if not (percent > 0 if rules.keep_zeros else shown > 0):
        return None
    text = f"{percent:.{rules.percent_digits}f}" if rules.keep_zeros else str(shown)
    if (percent if rules.keep_zeros else shown) > drop_above:
        action = rules.missing_many
    else:
        action = rules.missing_numeric if m.is_numeric else rules.missing_other
    return m.feature, MISSING, f"{text}% Null", action, percent


def _skew_row(m: Measured, rules: AuditRules) -> tuple | None:
    if m.skew is None or math.isnan(m.skew) or abs(m.skew) <= SKEW_LIMIT:
        return None
    text = f"{m.skew:.2f}" if rules.keep_zeros else str(round(m.skew, 2))
    return m.feature, SKEW, f"Skewness: {text}", rules.high_skew, m.skew


def _constant_row(m: Measured) -> tuple | None:
    return (m.feature, CONSTANT, "Danger", DROP_CONSTANT, 1.0) if m.is_constant else None


def _audit(df: DataFrame, candidates: Sequence[tuple | None]) -> DataFrame:
    """Audit rows, or the single clean row when there are none."""
    rows = [c for c in candidates if c is not None] or [CLEAN]
    return df.sparkSession.createDataFrame(rows, _AUDIT_SCHEMA)


def missing_audit(df: DataFrame, rules: AuditRules = STANDARD, drop_above: float | None = None,
                  nan_as_null: bool = False) -> DataFrame:
    """Columns with nulls, their share and what to do about it."""
    limit = rules.drop_above if drop_above is None else drop_above
    return _audit(df, [_missing_row(m, rules, limit) for m in measure(df, None, nan_as_null)])


def skew_audit(df: DataFrame, rules: AuditRules = STANDARD, nan_as_null: bool = False,
               adjusted: bool = False) -> DataFrame:
    """Numeric columns with |skewness| > 1.5; ``adjusted`` uses the sample-corrected form."""
    names = numeric_columns(df)
    found = measure(df, names, nan_as_null, adjusted) if names else []
    return _audit(df, [_skew_row(m, rules) for m in found])


def constant_audit(df: DataFrame) -> DataFrame:
    """Columns with at most one distinct value, null counted as one.

    Decided from count, min and max, so it needs no distinct count.
    """
    return _audit(df, [_constant_row(m) for m in measure(df)])


def full_audit(df: DataFrame, rules: AuditRules = STANDARD, drop_above: float | None = None,
               nan_as_null: bool = False, adjusted_skew: bool = False) -> DataFrame:
    """Missing values, skew and constant columns from a single pass over the table."""
    return _full(df, measure(df, None, nan_as_null, adjusted_skew), rules, drop_above)


def _full(df: DataFrame, found: Sequence[Measured], rules: AuditRules,
          drop_above: float | None = None) -> DataFrame:
    limit = rules.drop_above if drop_above is None else drop_above
    return _audit(df, [row for m in found for row in (
        _missing_row(m, rules, limit), _skew_row(m, rules), _constant_row(m))])


def audit_severity(audit: DataFrame) -> DataFrame:
    """Add the badge: it reads the number shown in the severity text, sign included."""
    shown = F.regexp_extract("severity", r"-?[0-9]+(\.[0-9]+)?", 0).try_cast("double")
    is_null, is_skew = F.col("severity").contains("Null"), F.col("severity").contains("Skewness")
    badge = (F.when(is_skew & (shown > 2), "danger")
             .when(is_null & (shown > 20), "danger")
             .when(is_null & (shown > 0), "warning")
             .otherwise("success"))
    return audit.withColumn("badge", badge)


def scorecard(df: DataFrame, rules: AuditRules = STANDARD) -> DataFrame:
    """Rows, columns with missing values, columns with high skew."""
    found = measure(df)
    row = (found[0].rows if found else 0,
           sum(_missing_row(m, rules, rules.drop_above) is not None for m in found),
           sum(_skew_row(m, rules) is not None for m in found))
    return df.sparkSession.createDataFrame(
        [row], "rows bigint, missing_features bigint, skewed_features bigint")


def critical_audit(audit: DataFrame, limit: int = 15) -> DataFrame:
    """The worst missing-value and skew findings, at most ``limit``."""
    marked = audit_severity(audit).where(F.col("badge").isin("warning", "danger"))
    wanted = marked.where(F.col("severity").contains("Null") | F.col("severity").contains("Skew"))
    return wanted.orderBy(F.desc("metric"), F.asc("feature")).limit(limit)


def correlation_matrix(df: DataFrame, names: Sequence[str] | None = None,
                       nan_as_null: bool = False) -> DataFrame:
    """Pearson for every pair of numeric columns over rows with both: (x, y, corr).

    A first scan finds means and nulls. A second one turns each row into a
    vector: 1, the values with the mean subtracted (nulls as zero), a presence
    flag for each column with nulls, and squares if there is one. The matrix
    of sums of products of this vector holds all sums of all pairs; every task
    adds up its own, so that a task hands on a matrix, however many rows it has.
    Null for a constant column.
    """
    names = as_list(names) or numeric_columns(df)
    require(df, *names)
    if len(names) < 2:
        raise ValueError("a correlation needs at least two numeric columns")
    found = _number_measures(df, names, nan_as_null)
    got = [found[n] for n in names]
    varying = [bool(g["n"]) and g["low"] != g["high"] for g in got]
    partial = [i for i, g in enumerate(got) if g["n"] < g["rows"] and varying[i]]
    raw = [present(df, n, nan_as_null).cast("double") for n in names]
    centred = [F.coalesce(x - F.lit(g["mean"]), F.lit(0.0)) if v else F.lit(0.0) for x, g, v in zip(raw, got, varying)]
    cells = [F.lit(1.0), *centred, *[raw[i].isNotNull().cast("double") for i in partial]]
    if partial:
        cells += [u * u for u in centred]
    sums = _gram(df, cells, got[0]["rows"]) if any(varying) else None
    mask = {i: 1 + len(names) + k for k, i in enumerate(partial)}

    def moments(i: int, j: int) -> tuple[float, float]:
        """Sum and sum of squares of column i over the rows in which column j has a value."""
        if j not in mask:
            return sums[1 + i, 0], sums[1 + i, 1 + i]
        return sums[1 + i, mask[j]], sums[1 + len(names) + len(partial) + i, mask[j]]

    rows = []
    for i in range(len(names)):
        for j in range(i, len(names)):
            value = None
            if varying[i] and varying[j]:
                value = _pearson(sums[mask.get(i, 0), mask.get(j, 0)], sums[1 + i, 1 + j], *moments(i, j), *moments(j, i))
            rows += [(names[x], names[y], value) for x, y in dict.fromkeys([(i, j), (j, i)])]
    return df.sparkSession.createDataFrame(rows, "x string, y string, corr double")


def _gram(df: DataFrame, cells: Sequence[Column], rows: int) -> np.ndarray:
    """The sums of all products of two cells of a row."""
    vectors = MLUtils.convertVectorColumnsFromML(df.select(array_to_vector(F.array(*cells)).alias("v")), "v")
    return RowMatrix(vectors, rows, len(cells)).computeGramianMatrix().toArray()


def _pearson(n: float, xy: float, x: float, xx: float, y: float, yy: float) -> float | None:
    if not n:
        return None
    spread_x, spread_y = xx - x ** 2 / n, yy - y ** 2 / n
    # below this share of the squares a spread is rounding: constant on these rows
    if not (spread_x > ROUNDING * xx and spread_y > ROUNDING * yy):
        return None
    return float((xy - x * y / n) / (math.sqrt(spread_x) * math.sqrt(spread_y)))


@dataclass(frozen=True)
class Profile:
    """What a profile of one table consists of."""

    stats: DataFrame
    audit: DataFrame
    numeric: list[str]
    categorical: list[str]
    rows: int
    columns: int


def profile(df: DataFrame, rules: AuditRules = STANDARD, accuracy: int | None = None,
            nan_as_null: bool = False) -> Profile:
    """Statistics, audit, column lists and shape from one shared pass (plus the quartiles)."""
    found, quartiles = _measured_with_quartiles(df, None, accuracy, nan_as_null)
    stats = _stats(df, found, quartiles)
    return Profile(stats, _full(df, found, rules), numeric_columns(df), categorical_columns(df),
                   found[0].rows if found else 0, len(df.columns))
