"""Independent jobs over one table, run at the same time."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Row, SparkSession

JOBS_AT_ONCE = 8
Item = TypeVar("Item")
Result = TypeVar("Result")


def run_together(spark: SparkSession, work: Callable[[Item], Result],
                 items: Sequence[Item]) -> list[Result]:
    """``work(item)`` for each item, a few at a time; each call runs Spark jobs of its own."""
    if len(items) == 1:
        return [work(items[0])]
    with ThreadPoolExecutor(JOBS_AT_ONCE) as pool:
        return list(pool.map(inheritable_thread_target(spark)(work), items))


def aggregate_blocks(df: DataFrame, blocks: Sequence[Sequence[Column]]) -> list[Row]:
    """One single-row aggregate for each block of expressions.

    Blocks read different columns, so splitting a wide aggregate costs no extra
    reading, and narrow ones run much faster: the measures of six numeric
    columns took 0.7 s on 600,000 rows, those of nine 4.1 s.
    """
    return run_together(df.sparkSession, lambda block: df.agg(*block).first(), blocks)
