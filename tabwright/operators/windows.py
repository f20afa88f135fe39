"""Window functions over a partition key and an order.

A plain window gives each key to one task. When a key holds too many rows for
that, its rows take the way of ``plans.ordering`` and only the others use the
plain window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.functions.schema import as_list, column, columns, require, row_hash, type_of
from tabwright.plans.ordering import POSITION, RUNNING, Placed, place
from tabwright.plans.skew import find_hot_keys

Names = str | Sequence[str]


@dataclass(frozen=True)
class _Way:
    """What the functions before left for the next one with the same keys and order: the placed rows of the
    hot keys, and the other rows."""

    keys: list[str]
    order: list[str]
    hot_rows: int | None
    placed: Placed
    rest: DataFrame | None


#: For results of functions by the way for hot keys, as long as they are in use.
_ways: WeakKeyDictionary[DataFrame, _Way] = WeakKeyDictionary()


def _split(df: DataFrame, keys: list[str], order: list[str], hot_rows: int | None, output: str,
           plain: Callable[[DataFrame], DataFrame], large: Callable[[Placed], DataFrame]) -> DataFrame:
    """Add ``output`` by the plain window, and by ``large`` for the rows of hot keys.

    Several functions over the same keys and order, each on the result of the one before, place the rows
    once; ties then go by the hash of the row as it was at the first.
    """
    way = _ways.get(df)
    if way is None or (way.keys, way.order, way.hot_rows) != (keys, order, hot_rows):
        hot = find_hot_keys(df, keys, hot_rows)
        if hot is None:
            return plain(df)
        placed = place(hot.rows_of(df), keys, _ordered(df, order), hot.rows)
        way = _Way(keys, order, hot_rows, replace(placed, order=tuple(order)), None if hot.covers_all else hot.rest_of(df))
    done = way.placed.with_rows(large(way.placed), output)
    rest = None if way.rest is None else plain(way.rest)
    names = list(dict.fromkeys([*df.columns, output]))
    result = done.rows.select(*columns(names))
    if rest is not None:
        result = result.unionByName(rest)
    if output not in keys + order:
        _ways[result] = replace(way, placed=done, rest=rest)
    return result


def _checked(df: DataFrame, partition_by: Names, order_by: Names, *others: str):
    keys, order = as_list(partition_by), as_list(order_by)
    if not keys or not order:
        raise ValueError("a window needs partition and order columns")
    require(df, *keys, *order, *others)
    return keys, order


def _ordered(df: DataFrame, order: list[str]) -> list[Column]:
    """The order of every window here: ties go by the hash of the row, however many rows a key has."""
    return columns(order) + [row_hash(df)]


def add_row_number(df: DataFrame, partition_by: Names, order_by: Names,
                   output: str = "row_number", hot_rows: int | None = None) -> DataFrame:
    """1, 2, 3, ... along ascending order (bigint: a hot key may pass two billion rows)."""
    keys, order = _checked(df, partition_by, order_by)
    window = Window.partitionBy(*columns(keys)).orderBy(*_ordered(df, order))

    def large(placed: Placed) -> DataFrame:
        return placed.numbered().withColumn(output, F.col(POSITION)).drop(POSITION)

    def plain(rows: DataFrame) -> DataFrame:
        return rows.withColumn(output, F.row_number().over(window).cast("bigint"))

    return _split(df, keys, order, hot_rows, output, plain, large)


def add_rank(df: DataFrame, partition_by: Names, order_by: Names, kind: str = "rank",
             output: str | None = None, hot_rows: int | None = None) -> DataFrame:
    """``rank`` or ``dense_rank`` along *descending* order."""
    keys, order = _checked(df, partition_by, order_by)
    functions = {"rank": F.rank, "dense_rank": F.dense_rank}
    if kind not in functions:
        raise ValueError(f"unknown rank {kind!r}; use rank or dense_rank")
    output = output or kind
    down = [column(o).desc() for o in order]
    window = Window.partitionBy(*columns(keys)).orderBy(*down)

    def large(placed: Placed) -> DataFrame:
        return placed.ranked_down(kind, output)

    def plain(rows: DataFrame) -> DataFrame:
        return rows.withColumn(output, functions[kind]().over(window).cast("bigint"))

    return _split(df, keys, order, hot_rows, output, plain, large)


def add_lag_lead(df: DataFrame, partition_by: Names, order_by: Names, target: str,
                 offset: int = 1, kind: str = "lag", hot_rows: int | None = None) -> DataFrame:
    """Value ``offset`` rows before or after, in ``{target}_{kind}_{offset}``."""
    keys, order = _checked(df, partition_by, order_by, target)
    functions = {"lag": F.lag, "lead": F.lead}
    if kind not in functions:
        raise ValueError(f"unknown function {kind!r}; use lag or lead")
    output = f"{target}_{kind}_{offset}"
    window = Window.partitionBy(*columns(keys)).orderBy(*_ordered(df, order))

    def large(placed: Placed) -> DataFrame:
        return placed.shifted(target, offset if kind == "lag" else -offset, output)

    def plain(rows: DataFrame) -> DataFrame:
        return rows.withColumn(output, functions[kind](column(target), offset).over(window))

    return _split(df, keys, order, hot_rows, output, plain, large)


def add_running_total(df: DataFrame, partition_by: Names, order_by: Names, target: str,
                      hot_rows: int | None = None) -> DataFrame:
    """Cumulative sum up to the current row, in ``{target}_cumsum``."""
    keys, order = _checked(df, partition_by, order_by, target)
    output = f"{target}_cumsum"
    window = (Window.partitionBy(*columns(keys)).orderBy(*_ordered(df, order))
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))

    def plain(rows: DataFrame) -> DataFrame:
        return rows.withColumn(output, F.sum(column(target)).over(window))

    def large(placed: Placed) -> DataFrame:
        total = F.col(RUNNING).cast(type_of(plain(df), output))
        return placed.numbered(column(target), target).withColumn(output, total).drop(POSITION, RUNNING)

    return _split(df, keys, order, hot_rows, output, plain, large)


def window_function(df: DataFrame, function: str, partition_by: Names, order_by: Names,
                    target: str | None = None, offset: int = 1,
                    hot_rows: int | None = None) -> DataFrame:
    """The six window functions by name."""
    if function in ("lag", "lead", "cumsum") and not target:
        raise ValueError(f"{function} needs a target column")
    if function == "row_number":
        return add_row_number(df, partition_by, order_by, hot_rows=hot_rows)
    if function in ("rank", "dense_rank"):
        return add_rank(df, partition_by, order_by, function, hot_rows=hot_rows)
    if function in ("lag", "lead"):
        return add_lag_lead(df, partition_by, order_by, target, offset, function, hot_rows)
    if function == "cumsum":
        return add_running_total(df, partition_by, order_by, target, hot_rows)
    raise ValueError(f"unknown window function {function!r}")
