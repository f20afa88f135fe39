"""Projections, row filters and column edits. All of them stay lazy and shuffle nothing."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from datetime import date, datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions import numeric, text
from tabwright.functions.schema import (
    as_list, column, columns, is_numeric, present, require, type_of,
)

# The accepted names.
CAST_TARGETS = {
    "int": T.IntegerType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
}
COMPARISONS = {
    ">": operator.gt,
    "<": operator.lt,
    ">=": operator.ge,
    "<=": operator.le,
    "==": operator.eq,
    "!=": operator.ne,
}
EDITS = {
    "log": numeric.log1p,
    "sqrt": numeric.sqrt_of_abs,
    "square": numeric.square,
    "abs": F.abs,
    "reciprocal": numeric.reciprocal,
}


def _lookup(table: dict[str, Any], name: str, what: str) -> Any:
    if name not in table:
        raise ValueError(f"unknown {what} {name!r}; use one of {', '.join(table)}")
    return table[name]


def select_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    require(df, *names)
    return df.select(*columns(names))


def drop_column(df: DataFrame, name: str) -> DataFrame:
    require(df, name)
    return df.drop(name)


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    require(df, old)
    return df.withColumnRenamed(old, new)


def cast_column(df: DataFrame, name: str, target: str, strict: bool = False) -> DataFrame:
    """Cast in place; text that does not fit becomes null unless ``strict``."""
    require(df, name)
    dtype = _lookup(CAST_TARGETS, target.lower(), "type")
    value = column(name)
    return df.withColumn(name, value.cast(dtype) if strict else value.try_cast(dtype))


def conditional_column(df: DataFrame, new_name: str, name: str, threshold: Any,
                       true_value: Any = "High", false_value: Any = "Low") -> DataFrame:
    """``true_value`` above the threshold, ``false_value`` otherwise and for null."""
    require(df, name)
    choice = F.when(column(name) > F.lit(threshold), F.lit(true_value)).otherwise(F.lit(false_value))
    return df.withColumn(new_name, choice)


def replace_values(df: DataFrame, name: str, old: Any, new: Any) -> DataFrame:
    """Replace exact matches; ``new`` may be None. A null is matched by ``old=None``.

    Both values are read by the column's type; one that does not fit raises ``ValueError``.
    """
    value = column(name)
    matched = value.eqNullSafe(typed_literal(df, name, old))
    replacement = F.lit(None).cast(type_of(df, name)) if new is None else typed_literal(df, name, new)
    return df.withColumn(name, F.when(matched, replacement).otherwise(value))


def add_or_modify_column(df: DataFrame, name: str, edit: str, output: str | None = None) -> DataFrame:
    require(df, name)
    expression = _lookup(EDITS, edit, "expression")
    return df.withColumn(output or name, expression(column(name)))


def text_column(df: DataFrame, name: str, function: str) -> DataFrame:
    """upper, lower and reverse in place; length into ``{name}_length``."""
    require(df, name)
    if function == "length":
        return df.withColumn(f"{name}_length", F.length(column(name)))
    expression = _lookup({**text.IN_PLACE, "length": F.length}, function, "text function")
    return df.withColumn(name, expression(column(name)))


def contains_at(df: DataFrame, name: str, output: str | None = None) -> DataFrame:
    require(df, name)
    return df.withColumn(output or f"{name}_has_at", text.has_at_sign(column(name)))


def typed_literal(df: DataFrame, name: str, value: Any) -> Column:
    """A literal of the column's own kind; a value that is none raises ``ValueError`` before any job.

    The literal is converted, never the column. A number for a text column becomes its text.
    """
    dtype = type_of(df, name)
    number = isinstance(value, (int, float, Decimal)) and not isinstance(value, bool)
    if value is None or isinstance(value, Column):
        return F.lit(value)
    if isinstance(dtype, T.StringType):
        return F.lit(str(value))
    if isinstance(dtype, T.BooleanType):
        text_value = str(value).strip().lower()
        if text_value not in _TRUTH:
            raise ValueError(f"{value!r} is no truth value, but column {name} is boolean")
        return F.lit(_TRUTH[text_value])
    if not is_numeric(dtype):
        if number or isinstance(value, bool):
            raise ValueError(f"{value!r} does not fit column {name} of type {dtype.simpleString()}")
        if isinstance(value, str):
            return _parsed(value, name, dtype)
        return F.lit(value)
    if isinstance(value, bool) or number:
        return F.lit(int(value) if isinstance(value, bool) else value)
    if not isinstance(value, str):
        raise ValueError(f"{value!r} is no number, but column {name} is numeric")
    try:
        return F.lit(int(value)) if value.strip().lstrip("+-").isdigit() else F.lit(float(value))
    except ValueError:
        raise ValueError(f"{value!r} is no number, but column {name} is numeric") from None


_TRUTH = {"true": True, "1": True, "false": False, "0": False}


def _parsed(value: str, name: str, dtype: T.DataType) -> Column:
    """Text as a date or time of the column's type."""
    forms = {T.DateType: date, T.TimestampType: datetime, T.TimestampNTZType: datetime}
    form = forms.get(type(dtype))
    try:
        return F.lit(form.fromisoformat(value.strip())).cast(dtype) if form else F.lit(value).cast(dtype)
    except ValueError:
        raise ValueError(f"{value!r} does not fit column {name} of type {dtype.simpleString()}") from None


def filter_rows(df: DataFrame, name: str, comparison: str, value: Any) -> DataFrame:
    """Keep rows where ``column <comparison> value``; null never passes.

    A value given as text is read by the column's declared type, so the filter
    compares like with like and reaches the Parquet scan.
    """
    compare = _lookup(COMPARISONS, comparison, "comparison")
    return df.where(compare(column(name), typed_literal(df, name, value)))


def drop_nulls(df: DataFrame, subset: str | Sequence[str] | None = None,
               nan_as_null: bool = False) -> DataFrame:
    """Drop rows with a null in any of the columns; NaN stays unless asked."""
    names = as_list(subset) or df.columns
    require(df, *names)
    for name in names:
        df = df.where(present(df, name, nan_as_null).isNotNull())
    return df
