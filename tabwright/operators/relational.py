"""Joins, grouping, distinct, value counts, sorting and sampling."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.functions.schema import (
    as_list, column, columns, is_floating, is_hashable, present, require, type_of,
)
from tabwright.plans.frequent import top_counts
from tabwright.plans.jobs import aggregate_blocks, run_together
from tabwright.plans.skew import find_hot_keys
from tabwright.plans.storage import may_broadcast, written_at

# Pairs of rows that one task should make from one key of an outer join.
PAIRS = 1 << 22
MOST_TASKS = 4096

# Accepted names and the suffix of the result column.
AGGREGATES = {
    "sum": (F.sum, "sum"),
    "avg": (F.avg, "avg"),
    "mean": (F.avg, "avg"),
    "count": (F.count, "count"),
    "min": (F.min, "min"),
    "max": (F.max, "max"),
    "stddev": (F.stddev_samp, "stddev"),
}
JOINS = {
    "inner": "inner", "cross": "inner",
    "left": "left", "left_outer": "left", "leftouter": "left",
    "right": "right", "right_outer": "right", "rightouter": "right",
    "outer": "outer", "full": "outer", "full_outer": "outer", "fullouter": "outer",
    "semi": "semi", "left_semi": "semi", "leftsemi": "semi",
    "anti": "anti", "left_anti": "anti", "leftanti": "anti",
}


def join_dataframes(left: DataFrame, right: DataFrame, on: str | Sequence[str],
                    how: str = "inner", hot_rows: int | None = None) -> DataFrame:
    """Equi-join on shared column names; the key appears once, null keys never match.

    ``cross`` with a key pairs the rows within each key, as an inner join does;
    there is no Cartesian product. Broadcast or sort-merge is Catalyst's
    choice. The adaptive skew join can split a hot key on either side of an
    inner join, but only on the preserved side of an outer one, and nowhere in
    a full one. So when the other side has a hot key, an outer join is put
    together from the inner join and the unmatched rows. Spark's own full join
    holds all pairs of a key in memory, so a full join is always put together;
    a key with more than ``PAIRS`` pairs is dealt to several tasks there.
    """
    keys = as_list(on)
    if not keys:
        raise ValueError("a join needs at least one key")
    require(left, *keys)
    require(right, *keys)
    if how not in JOINS:
        raise ValueError(f"unknown join {how!r}; use one of {', '.join(JOINS)}")
    kind = JOINS[how]
    if kind == "inner":
        return left.join(right, keys, "inner")
    if kind in ("semi", "anti"):
        # distinct keys combine on the map side and reuse the join's own partitioning
        return left.join(right.select(*columns(keys)).distinct(), keys, f"left_{kind}")
    sides = {"left": [right], "right": [left], "outer": [left, right]}[kind]
    hot = run_together(left.sparkSession, lambda side: find_hot_keys(side.select(*columns(keys)), keys, hot_rows), sides)
    if kind != "outer" and not any(hot):
        return left.join(right, keys, kind)
    # both sides may use one name for a non-key column: join under other names, rename at the end
    names = keys + [n for side in (left, right) for n in side.columns if n not in keys]
    right = right.withColumnsRenamed(
        {n: f"__right_{i}" for i, n in enumerate(right.columns) if n not in keys})
    # rows without a key match nothing, so they stay out of the shuffles
    missing = reduce(or_, [column(k).isNull() for k in keys])
    known_left, known_right = left.where(~missing), right.where(~missing)
    spread = _many_pairs(known_left, known_right, keys) if kind == "outer" else None
    if spread is None and not any(hot):
        result = left.join(right, keys, "left")
    else:
        result = spread or known_left.join(known_right, keys, "inner")
        if kind in ("left", "outer"):
            for rest in (join_dataframes(known_left, known_right, keys, "anti"), left.where(missing)):
                result = result.unionByName(rest, allowMissingColumns=True)
    if kind in ("right", "outer"):
        for rest in (join_dataframes(known_right, known_left, keys, "anti"), right.where(missing)):
            result = result.unionByName(rest, allowMissingColumns=True)
    return result.toDF(*names)


def _many_pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame | None:
    """The inner join of rows with keys, in tasks of about ``PAIRS`` pairs; None if no key has more.

    Both sides of such a key are dealt out by a random number, in a grid whose blocks have as many rows of either
    side as far as there are so many; a row goes to all blocks of its line, so few copies of rows are shuffled.
    """
    counted = [side.groupBy(*columns(keys)).agg(F.count(F.lit(1)).alias(n)) for side, n in ((left, "__l"), (right, "__r"))]
    pairs = F.col("__l").cast("double") * F.col("__r")
    parts = F.least(F.ceil(pairs / PAIRS), F.greatest("__l", "__r"))
    lines = F.least(F.greatest(F.round(F.sqrt(parts * F.col("__l") / F.col("__r"))).cast("bigint"), F.lit(1)), "__l", parts)
    many, path = written_at(counted[0].join(counted[1], keys).where(pairs > PAIRS).select(
        *columns(keys), lines.alias("__lines"), F.least(F.ceil(parts / lines), "__r").alias("__rows")), "pairs")
    number, tasks = many.agg(F.count(F.lit(1)), F.sum(F.col("__lines") * F.col("__rows"))).first()
    if not number:
        return None
    many = F.broadcast(many) if may_broadcast(left.sparkSession, path, number) else many
    tasks = min(tasks, MOST_TASKS)

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        one = F.floor(F.rand(11) * F.col(own))
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(other, F.lit(1)) - 1))
        drawn = side.join(many, keys, "left").withColumn(own, F.coalesce(one, F.lit(0).cast("bigint"))).withColumn(other, every)
        return drawn.repartition(tasks, *columns(keys), "__lines", "__rows")

    blocks = ["__lines", "__rows"]
    first, second = dealt(left, *blocks), dealt(right, *blocks[::-1])
    if _width(left) >= _width(right):
        return first.hint("merge").join(second, keys + blocks).drop(*blocks)
    # a merge reads the columns of its second side anew for each pair, so the wider rows come first
    own = {k: f"__key_{i}" for i, k in enumerate(keys)}
    second = second.withColumnsRenamed(own | {b: f"{b}_r" for b in blocks})
    same = [column(k) == column(own[k]) for k in keys] + [column(b) == column(f"{b}_r") for b in blocks]
    return second.hint("merge").join(first, same).select(
        *columns(keys + [n for side in (left, right) for n in side.columns if n not in keys]))


def _width(df: DataFrame) -> int:
    return df._jdf.schema().defaultSize()


def group_and_aggregate(df: DataFrame, group_by: str | Sequence[str],
                        aggregates: Mapping[str, str | Sequence[str]]) -> DataFrame:
    """``{column: function or list of functions}``; results are named ``{column}_{function}``."""
    keys = as_list(group_by)
    require(df, *keys, *aggregates)
    exprs = []
    for name, functions in aggregates.items():
        for function in as_list(functions):
            if function not in AGGREGATES:
                raise ValueError(
                    f"unknown aggregate {function!r}; use one of {', '.join(AGGREGATES)}")
            build, suffix = AGGREGATES[function]
            exprs.append(build(column(name)).alias(f"{name}_{suffix}"))
    if not exprs:
        raise ValueError("no aggregates given")
    return df.groupBy(*columns(keys)).agg(*exprs)


def row_count(df: DataFrame) -> DataFrame:
    """Total rows as a one-row table."""
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def drop_duplicates(df: DataFrame, subset: str | Sequence[str] | None = None,
                    order_by: Sequence[str | Column] | None = None) -> DataFrame:
    """Distinct rows, or the first row per subset in the given order.

    Without an order the remaining columns, ascending, decide, so the kept row
    does not depend on partitioning. ``row_number() <= 1`` lets Spark keep one
    row per key in each map task before the shuffle, so a hot key is harmless.
    """
    keys = as_list(subset)
    if not keys:
        return df.dropDuplicates()
    require(df, *keys)
    order = [column(o) if isinstance(o, str) else o for o in order_by or []]
    rest = [n for n in df.columns if n not in keys and is_hashable(type_of(df, n))]
    ranking = Window.partitionBy(*columns(keys)).orderBy(*order, *columns(rest)) if order or rest \
        else None
    if ranking is None:
        return df.dropDuplicates(keys)
    return (df.withColumn("__nth", F.row_number().over(ranking))
            .where(F.col("__nth") <= 1).drop("__nth"))


def unique_count(df: DataFrame, names: Sequence[str] | None = None,
                 approximate: bool = False) -> DataFrame:
    """Distinct values per column, with null counted as one value: (feature, unique_count)."""
    names = as_list(names) or [f.name for f in df.schema.fields if is_hashable(f.dataType)]
    require(df, *names)
    count = F.approx_count_distinct if approximate else F.count_distinct
    # distinct counts of several columns in one aggregate would copy every row for each of them;
    # on its own, each column is shuffled alone
    rows = aggregate_blocks(df, [
        [(count(column(n)) + F.max(F.when(column(n).isNull(), 1).otherwise(0))).alias("n")]
        for n in names])
    return df.sparkSession.createDataFrame(
        [(n, row["n"] or 0) for n, row in zip(names, rows)], "feature string, unique_count bigint")


def distinct_states(df: DataFrame, by: str | Sequence[str], names: Sequence[str] | None = None, precision: int = 14) -> DataFrame:
    """For each part of the table (a combination of ``by``) and column: (by..., feature, rows, nulls, state).

    The states are sketches (HLL) of at most 2^precision bytes that merge: ``unique_of`` answers from them for any
    parts together, without the table. All columns take one scan, whose map tasks merge by part.
    """
    keys = as_list(by)
    names = as_list(names) or [f.name for f in df.schema.fields if is_hashable(f.dataType) and f.name not in keys]
    require(df, *keys, *names)
    exprs = []
    for n in names:
        value = column(n)
        one = value + F.lit(0).cast(type_of(df, n)) if is_floating(type_of(df, n)) else value  # -0.0 is 0.0
        exprs.append(F.struct(
            F.lit(n).alias("feature"), F.count(F.lit(1)).alias("rows"), F.count_if(value.isNull()).alias("nulls"),
            F.hll_sketch_agg(F.when(value.isNotNull(), F.xxhash64(one)), F.lit(precision)).alias("state")))
    return df.groupBy(*columns(keys)).agg(F.array(*exprs).alias("__s")).select(*columns(keys), F.inline("__s"))


def unique_of(states: DataFrame, by: str | Sequence[str] | None = None, precision: int = 14) -> DataFrame:
    """Distinct values from states: (by..., feature, rows, unique_estimate, low, high), with null counted as one value.

    ``by`` names the columns of the parts that are kept apart, the others are merged; filter the states to choose
    parts. The count is between low and high with probability 0.997: the standard error is 1.04 / 2^(precision / 2).
    """
    keys = as_list(by)
    error = 3 * 1.04 / math.sqrt(1 << precision)
    merged = states.groupBy(*columns(keys), "feature").agg(
        F.sum("rows").alias("rows"), (F.max("nulls") > 0).cast("bigint").alias("__null"),
        F.hll_sketch_estimate(F.hll_union_agg("state")).alias("__n"))
    n = F.col("__n")
    return merged.select(*columns(keys), "feature", "rows", (n + F.col("__null")).alias("unique_estimate"),
                         (F.floor(n * (1 - error)) + F.col("__null")).alias("low"), (F.ceil(n * (1 + error)) + F.col("__null")).alias("high"))


def value_counts(df: DataFrame, name: str, top: int | None = 10) -> DataFrame:
    """Most frequent values, nulls left out, ties by value: (value, count).

    With ``top`` a summary of the column is made when called. Where it tells the
    frequent values from the rest, only those are counted; all values are
    counted where it doesn't, and without ``top``.
    """
    require(df, name)
    counts = None if top is None else top_counts(df, column(name), top)
    if counts is None:
        counts = _all_counts(df, column(name))
    return counts if top is None else counts.orderBy(F.desc("count"), F.asc("value")).limit(top)


def _all_counts(df: DataFrame, value: Column) -> DataFrame:
    return df.where(value.isNotNull()).groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("count"))


def mode(df: DataFrame, name: str) -> DataFrame:
    """Most frequent non-null value, the lowest on ties; no row when all are null.

    The built-in ``mode`` would hold every distinct value in one buffer.
    """
    return value_counts(df, name, top=1).select(F.col("value").alias(name), F.col("count"))


def most_frequent(df: DataFrame, names: Sequence[str]) -> dict[str, str]:
    """The mode of each column that has one, as text."""
    rows = run_together(df.sparkSession, lambda n: mode(df, n).select(column(n).cast("string")).first(), list(names))
    return {n: r[0] for n, r in zip(names, rows) if r is not None}


def modes(df: DataFrame, names: Sequence[str], nan_as_null: bool = False) -> DataFrame:
    """Distinct count, mode and its frequency of several scalar columns.

    (feature, unique, top, freq) with the value as text, ties to the lowest
    value; no row for a column without values. Each column is counted alone.
    """
    if not names:
        raise ValueError("no columns given")

    def one(name: str) -> tuple[str, int, str | None, int | None]:
        value = present(df, name, nan_as_null)
        counts = (df.where(value.isNotNull()).groupBy(value.alias("value"))
                  .agg(F.count(F.lit(1)).alias("n")))
        best = F.min(F.struct((-F.col("n")).alias("n"), F.col("value")))
        row = counts.agg(F.count(F.lit(1)).alias("unique"), best.alias("best")).select(
            "unique", F.col("best.value").cast("string").alias("top"),
            (-F.col("best.n")).alias("freq")).first()
        return (name, *row)

    rows = run_together(df.sparkSession, one, list(names))
    return df.sparkSession.createDataFrame(
        [r for r in rows if r[1]], "feature string, unique bigint, top string, freq bigint")


def _sort_columns(df: DataFrame, by: str | Sequence[str],
                  ascending: bool | Sequence[bool]) -> list[Column]:
    names = as_list(by)
    if not names:
        raise ValueError("no sort key given")
    require(df, *names)
    flags = [ascending] * len(names) if isinstance(ascending, bool) else list(ascending)
    if len(flags) != len(names):
        raise ValueError("give one direction, or one per sort key")
    return [column(n).asc() if up else column(n).desc() for n, up in zip(names, flags)]


def sort_data(df: DataFrame, by: str | Sequence[str],
              ascending: bool | Sequence[bool] = True, split_ties: bool = True) -> DataFrame:
    """Global sort: ascending puts nulls first, descending last.

    A sort key shared by many rows would land in one range partition; a random
    number as last key spreads such ties, equal rows too, and reads no column.
    """
    keys = _sort_columns(df, by, ascending)
    return df.orderBy(*keys, F.rand(11)) if split_ties else df.orderBy(*keys)


def top_n(df: DataFrame, by: str | Sequence[str], n: int = 15,
          ascending: bool | Sequence[bool] = True) -> DataFrame:
    """First ``n`` rows of the order; each task keeps only its own ``n``."""
    return df.orderBy(*_sort_columns(df, by, ascending)).limit(n)


def sample_n(df: DataFrame, n: int, key: str | Sequence[str], seed: int = 42) -> DataFrame:
    """``n`` rows at random but repeatable: those with the lowest hash of key and seed.

    ``key`` should identify a row. A bound on the hash, chosen from the row
    count so that slightly more than ``n`` rows pass, keeps the final ordering
    to about ``n`` rows however many tasks there are.
    """
    keys = as_list(key)
    require(df, *keys)
    draw = F.md5(F.concat_ws(":", *[F.coalesce(column(k).cast("string"), F.lit("")) for k in keys],
                             F.lit(str(seed))))
    total = df.count()
    if total <= n:
        return df
    share = (n + 8 * math.sqrt(n) + 64) / total
    while True:
        bound = format(int(min(share, 1.0) * (16 ** 12 - 1)), "012x") + "g"
        near = df.where(draw <= F.lit(bound))
        if share >= 1.0 or near.count() >= n:
            return near.orderBy(draw, *columns(keys)).limit(n)
        share *= 4
