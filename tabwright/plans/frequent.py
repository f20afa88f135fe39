"""Exact counts of the most frequent values without a shuffle of all values.

Map tasks keep a frequent-items summary (a Misra-Gries sketch with ``TRACKED`` counters) of 64-bit hashes of the
values, whatever the values are. The summaries are merged in two steps, so no task merges all of them. A merged
summary of N rows overstates no count by more than E = 2.625 N / TRACKED, and what it doesn't report occurs at most
2 E times. One more scan counts the values whose hash may be among the wanted ones. Where the last of them is more
frequent than 2 E, nothing unreported can displace it; otherwise the bound doesn't decide, and the caller counts all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRACKED = 10_000
#: Groups of map tasks whose summaries are merged first.
MERGES = 64


def _hash(df: DataFrame, value: Column) -> Column:
    kind = df.select(value.alias("v")).schema[0].dataType
    return F.xxhash64(value + F.lit(0).cast(kind) if isinstance(kind, (T.FloatType, T.DoubleType)) else value)  # -0.0 is 0.0


def summary(df: DataFrame, value: Column, tracked: int = TRACKED) -> tuple[int, bool, list[tuple[int, int]]]:
    """Rows with a value, whether all values are counted exactly, and (hash, estimated count) of the values that the
    summary reports, most frequent first.

    With at most ``tracked`` different values no counter is ever given up; half of that leaves room for the error
    of the estimated number of values.
    """
    hashes = df.where(value.isNotNull()).select(_hash(df, value).alias("h"))
    parts = hashes.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGES)).alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("h").alias("different"),
        F.expr(f"approx_top_k_accumulate(h, {tracked})").alias("state"))
    merged = parts.groupBy(F.lit("all")).agg(  # by a key, since nothing can be combined without rows
        F.sum("n").alias("n"), F.hll_union_agg("different").alias("different"),
        F.expr(f"approx_top_k_combine(state, {tracked})").alias("state"))
    row = merged.select("n", F.hll_sketch_estimate("different").alias("different"),
                        F.expr(f"approx_top_k_estimate(state, {tracked})").alias("items")).first()
    if row is None:  # no row with a value
        return 0, False, []
    items = [(r["item"], r["count"]) for r in row["items"]]
    return row["n"], row["different"] <= tracked / 2 and sum(n for _, n in items) == row["n"], items


def top_counts(df: DataFrame, value: Column, top: int, tracked: int = TRACKED) -> DataFrame | None:
    """(value, count) of a few values, among them the ``top`` most frequent ones and their ties; None if undecided."""
    rows, complete, items = summary(df, value, tracked)
    off = 0 if complete else int(2.625 * rows / tracked)
    if not items or not complete and (len(items) < top or items[top - 1][1] <= 2 * off):
        return None
    least = items[min(top, len(items)) - 1][1] - off  # what the last wanted one occurs at least
    wanted = [h for h, n in items if n >= least]
    counts = df.where(_hash(df, value).isin(wanted)).groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("count"))
    if not complete:
        last = counts.orderBy(F.desc("count")).limit(top).agg(F.min("count"), F.count(F.lit(1))).first()
        if last[1] < top or last[0] <= 2 * off:
            return None
    return counts
