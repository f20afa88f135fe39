"""Column transforms: fit a few numbers with one aggregate, then apply a column expression.

``fit`` returns a ``Fitted`` whose parameters can be reused on other tables;
``transform`` does both. Unknown names raise.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.functions import numeric
from tabwright.functions.schema import (
    column, columns, is_floating, is_numeric, present, quoted, require, type_of,
)
from tabwright.operators.columns import drop_nulls
from tabwright.operators.relational import drop_duplicates, mode
from tabwright.plans.ordering import POSITION, number_rows
from tabwright.plans.quantiles import exact_quantiles
from tabwright.plans.storage import BROADCAST_ROWS, written

Params = dict[str, Any]
_CODE = "__code"


@dataclass(frozen=True)
class Fitted:
    """A transform with its fitted numbers; ``lookup`` is set for label codes only."""

    kind: str
    name: str
    params: Params = field(default_factory=dict)
    options: Params = field(default_factory=dict)
    lookup: DataFrame | None = None

    def apply(self, df: DataFrame, output: str | None = None) -> DataFrame:
        require(df, self.name)
        output = output or self.name
        if self.lookup is not None:
            return attach_codes(df, self.name, self.lookup, output)
        value = present(df, self.name, self.options.get("nan_as_null", False))
        result = _KINDS[self.kind].apply(value, self.params, self.options)
        return df.withColumn(output, result)


@dataclass(frozen=True)
class _Kind:
    apply: Callable[[Column, Params, Params], Column]
    fit: Callable[[DataFrame, str, Params], Params] | None = None
    numeric_only: bool = True


def _aggregate(**builders: Callable[[Column], Column]):
    """A fit that runs one aggregate and keeps its results by name."""
    def fit(df: DataFrame, name: str, options: Params) -> Params:
        value = present(df, name, options.get("nan_as_null", False)).cast("double")
        return df.agg(*[b(value).alias(k) for k, b in builders.items()]).first().asDict()
    return fit


def _quantiles(*probs: float):
    def fit(df: DataFrame, name: str, options: Params) -> Params:
        nan_as_null = options.get("nan_as_null", False)
        accuracy = options.get("accuracy")
        if accuracy:
            value = present(df, name, nan_as_null).cast("double")
            found = df.agg(F.percentile_approx(value, list(probs), accuracy)).first()[0]
            found = found or [None] * len(probs)
        else:
            found = exact_quantiles(df, [name], probs, nan_as_null=nan_as_null)[name]
        return dict(zip((f"q{round(p * 100)}" for p in probs), found))
    return fit


def _fit_scale(df: DataFrame, name: str, options: Params) -> Params:
    spread = F.stddev_pop if options.get("ddof", 1) == 0 else F.stddev_samp
    return _aggregate(mean=F.avg, std=spread)(df, name, options)


def _fit_mode(df: DataFrame, name: str, options: Params) -> Params:
    values = df.select(present(df, name, options.get("nan_as_null", False)).alias("v"))
    row = mode(values, "v").first()
    return {"fill": None if row is None else row[0]}


def _apply_log(c: Column, p: Params, o: Params) -> Column:
    low = p.get("low")
    if low is not None and low <= 0:
        return numeric.log1p(c.cast("double"), F.lit(1.0 - low))
    return numeric.log1p(c)


def _apply_scale(c: Column, p: Params, o: Params) -> Column:
    if not p["std"]:
        return c
    return (c.cast("double") - F.lit(p["mean"])) / F.lit(p["std"])


def _apply_minmax(c: Column, p: Params, o: Params) -> Column:
    if p["low"] == p["high"]:
        return c
    return (c.cast("double") - F.lit(p["low"])) / F.lit(p["high"] - p["low"])


def _apply_fill(key: str):
    def apply(c: Column, p: Params, o: Params) -> Column:
        # to double first: 1.7 filled into an int column would be cut to 1
        return c if p[key] is None else F.coalesce(c.cast("double"), F.lit(float(p[key])))
    return apply


def _apply_constant(c: Column, p: Params, o: Params) -> Column:
    value = o.get("value", 0)
    if value is None:
        raise ValueError("give a fill value that is not None")
    return F.coalesce(c, F.lit(value))


def _apply_cap(c: Column, p: Params, o: Params) -> Column:
    if p["q25"] is None:
        return c
    margin = 1.5 * (p["q75"] - p["q25"])
    low, high = F.lit(p["q25"] - margin), F.lit(p["q75"] + margin)
    value = c.cast("double")
    return F.when(value < low, low).when(value > high, high).otherwise(value)


def _apply_bins(c: Column, p: Params, o: Params) -> Column:
    """Equal-width bins, closed on the right, the lowest value in the first one."""
    bins = o.get("bins", 5)
    low, high = p["low"], p["high"]
    if low is None or low == high:
        return c
    width = (high - low) / bins
    value = c.cast("double")
    label = F.when(value.isNull(), F.lit(None).cast("string"))
    for i in range(1, bins):
        label = label.when(value <= F.lit(low + width * i), F.lit(f"Bin {i}"))
    return label.otherwise(F.lit(f"Bin {bins}"))


def _plain(expression: Callable[[Column], Column]):
    return _Kind(lambda c, p, o: expression(c))


_BOUNDS = _aggregate(low=F.min, high=F.max)

_KINDS: Mapping[str, _Kind] = {
    "log": _Kind(_apply_log, lambda df, name, o:
                 _aggregate(low=F.min)(df, name, o) if o.get("shift", True) else {}),
    "sqrt": _Kind(lambda c, p, o: numeric.sqrt_clipped(c) if o.get("clip", True)
                  else numeric.sqrt_of_abs(c)),
    "square": _plain(numeric.square),
    "abs": _plain(F.abs),
    "reciprocal": _plain(numeric.reciprocal),
    "standard_scale": _Kind(_apply_scale, _fit_scale),
    "minmax_scale": _Kind(_apply_minmax, _BOUNDS),
    "fill_mean": _Kind(_apply_fill("mean"), _aggregate(mean=F.avg)),
    "fill_median": _Kind(_apply_fill("q50"), _quantiles(0.5)),
    "fill_mode": _Kind(lambda c, p, o: c if p["fill"] is None else F.coalesce(c, F.lit(p["fill"])),
                       _fit_mode, numeric_only=False),
    "fill_zero": _Kind(_apply_constant),
    "fill_value": _Kind(_apply_constant, numeric_only=False),
    "cap_outliers_iqr": _Kind(_apply_cap, _quantiles(0.25, 0.75)),
    "binning": _Kind(_apply_bins, _BOUNDS),
    "binning_5": _Kind(_apply_bins, _BOUNDS),
}
_OPTIONS = {"nan_as_null", "shift", "clip", "ddof", "accuracy", "bins", "value"}
ROW_KINDS = ("drop_nulls", "drop_duplicates")
TRANSFORMS = (*_KINDS, "label_encode", *ROW_KINDS)


def fit(df: DataFrame, name: str, kind: str, **options: Any) -> Fitted:
    """Fit one transform on one column.

    Options: ``nan_as_null``; ``shift=False`` for a log without shift;
    ``clip=False`` for the root of the absolute value; ``ddof=0`` for the
    population deviation; ``accuracy`` for approximate quantiles; ``bins``;
    ``value`` for a constant fill.
    """
    require(df, name)
    unknown = set(options) - _OPTIONS
    if unknown:
        raise ValueError(f"unknown option {', '.join(sorted(unknown))}")
    if kind == "label_encode":
        return Fitted(kind, name, {}, options, label_codes(df, name))
    if kind not in _KINDS:
        raise ValueError(f"unknown transform {kind!r}; use one of {', '.join(TRANSFORMS)}")
    chosen = _KINDS[kind]
    if chosen.numeric_only and not is_numeric(type_of(df, name)):
        raise ValueError(f"{kind} needs a numeric column, {name} is {type_of(df, name).simpleString()}")
    if kind == "fill_value" and "value" not in options:
        raise ValueError("fill_value needs value=")
    if options.get("bins", 5) < 1:
        raise ValueError("bins must be at least 1")
    params = chosen.fit(df, name, options) if chosen.fit else {}
    return Fitted(kind, name, params, options)


def transform(df: DataFrame, name: str, kind: str, output: str | None = None,
              **options: Any) -> DataFrame:
    """Fit on the table and apply to it; also the row transforms drop_nulls and drop_duplicates."""
    if kind in ROW_KINDS:
        require(df, name)
        return drop_nulls(df, name) if kind == "drop_nulls" else drop_duplicates(df)
    return fit(df, name, kind, **options).apply(df, output)


def fill_nulls(df: DataFrame, name: str, strategy: str = "mean", value: Any = None,
               **options: Any) -> DataFrame:
    """Fill by mean, median, mode, zero or a custom value."""
    if strategy not in ("mean", "median", "mode", "zero", "custom"):
        raise ValueError(f"unknown strategy {strategy!r}")
    if strategy == "custom":
        return transform(df, name, "fill_value", value=value, **options)
    return transform(df, name, f"fill_{strategy}", **options)


def label_codes(df: DataFrame, name: str, small: int = BROADCAST_ROWS) -> DataFrame:
    """(value, code): codes 0, 1, 2, ... along the sorted distinct non-null values.

    A long list of values is numbered across range partitions, a short one in one task.
    """
    value = column(name)
    if is_floating(type_of(df, name)):
        value = value + F.lit(0.0)  # -0.0 and 0.0 are one value
    distinct = written(df.where(value.isNotNull()).select(value.alias("value")).distinct(), "levels")
    count = distinct.count()
    if count <= small:
        code = F.row_number().over(Window.orderBy("value")).cast("bigint") - 1
        return distinct.select("value", code.alias("code"))
    numbered = number_rows(distinct, [], [F.col("value")], count)
    return written(numbered.select("value", (F.col(POSITION) - 1).alias("code")), "codes")


def attach_codes(df: DataFrame, name: str, lookup: DataFrame, output: str) -> DataFrame:
    # Catalyst and adaptive execution know the size in bytes, which a row count says little about
    codes = lookup.select(F.col("value").alias("__value"), F.col("code").alias(_CODE))
    joined = df.join(codes, df[quoted(name)] == codes["__value"], "left")
    kept = [n for n in df.columns if n != output]
    if output in df.columns:
        picked = [F.col(_CODE).alias(n) if n == output else column(n) for n in df.columns]
    else:
        picked = [*columns(kept), F.col(_CODE).alias(output)]
    return joined.select(*picked)
