"""Per-value column expressions without any fitting (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log1p(c: Column, shift: Column | None = None) -> Column:
    """``ln(1 + x)``; with ``shift`` it is added first. Null where undefined."""
    moved = c if shift is None else c + shift
    return F.log1p(moved.cast("double"))


def sqrt_of_abs(c: Column) -> Column:
    return F.sqrt(F.abs(c.cast("double")))


def sqrt_clipped(c: Column) -> Column:
    """Square root with negatives as zero; null stays null (``greatest`` would skip it)."""
    return F.sqrt(F.when(c < 0, F.lit(0.0)).otherwise(c.cast("double")))


def square(c: Column) -> Column:
    return F.pow(c.cast("double"), F.lit(2.0))


def reciprocal(c: Column) -> Column:
    """``1 / x``, null for zero."""
    return F.try_divide(F.lit(1.0), c.cast("double"))

