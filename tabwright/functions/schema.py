"""Column addressing and the type rules every operator shares."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def column(name: str) -> Column:
    """A column by its exact name; dots and blanks are part of the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(names: Iterable[str]) -> list[Column]:
    return [column(name) for name in names]


def as_list(names: str | Sequence[str] | None) -> list[str]:
    if names is None:
        return []
    return [names] if isinstance(names, str) else list(names)


def require(df: DataFrame, *names: str) -> None:
    """Raise ``ValueError`` for names the table does not have."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"no such column: {', '.join(missing)}; have {', '.join(df.columns)}")


def type_of(df: DataFrame, name: str) -> T.DataType:
    require(df, name)
    return df.schema[name].dataType


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_encodable(dtype: T.DataType) -> bool:
    """Categorical columns the encoders turn into numbers."""
    return isinstance(dtype, (T.StringType, T.BooleanType))


def is_scalar(dtype: T.DataType) -> bool:
    """Types with an order and a plain text form."""
    return is_numeric(dtype) or isinstance(
        dtype, (T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    )


def is_hashable(dtype: T.DataType) -> bool:
    """Types that may be grouped on and hashed (no map anywhere inside)."""
    if isinstance(dtype, (T.MapType, T.VariantType)):
        return False
    if isinstance(dtype, T.ArrayType):
        return is_hashable(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return all(is_hashable(field.dataType) for field in dtype.fields)
    return True


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def categorical_columns(df: DataFrame, encodable_only: bool = False) -> list[str]:
    """Everything that is not numeric, or only text and booleans."""
    if encodable_only:
        return [f.name for f in df.schema.fields if is_encodable(f.dataType)]
    return [f.name for f in df.schema.fields if not is_numeric(f.dataType)]


def scalar_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_scalar(f.dataType)]


def present(df: DataFrame, name: str, nan_as_null: bool = False) -> Column:
    """The column, with NaN turned into null on request."""
    value = column(name)
    if nan_as_null and is_floating(type_of(df, name)):
        return F.when(~F.isnan(value), value)
    return value


def row_hash(df: DataFrame) -> Column:
    """A hash over the whole row, used only to separate rows with equal sort keys."""
    names = [f.name for f in df.schema.fields if is_hashable(f.dataType)]
    return F.xxhash64(*columns(names))


def same_key(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    """Join condition in which null equals null."""
    condition = F.lit(True)
    for ours, theirs in pairs:
        condition = condition & left[quoted(ours)].eqNullSafe(right[quoted(theirs)])
    return condition


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
