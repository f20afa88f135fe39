"""Profiles that merge: what is known of the parts of a table gives the profile of the whole.

A state has one row per column: counts, central moments, bounds, a sketch of distinct values (HLL) and one of ranks
(KLL). Means and moments of parts combine exactly (up to rounding), so do counts and bounds; quartiles and distinct
counts come from the sketches, with a rank error below 0.2 % and a standard error of 1.6 %.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.schema import column, is_floating, is_numeric, is_scalar, type_of
from tabwright.operators.profile import AuditRules, Measured, STANDARD, _full, _stats, measure
from tabwright.plans.jobs import aggregate_blocks

RANK_SKETCH = 4096
STATE_SCHEMA = ("feature string, place int, is_numeric boolean, rows bigint, count bigint, nan_count bigint, mean double, "
                "m2 double, m3 double, min double, max double, low string, high string, is_scalar boolean, "
                "different binary, ranks binary")
DIFFERENT = "feature string, distinct_estimate bigint"


def profile_state(df: DataFrame) -> DataFrame:
    """The state of a table: each column is read twice."""
    found = measure(df)
    blocks = {}  # columns apart, several at a time
    for i, m in enumerate(found):
        exprs = blocks.setdefault(i, [])
        value, dtype = column(m.feature), type_of(df, m.feature)
        if is_scalar(dtype):
            one = value + F.lit(0).cast(dtype) if is_floating(dtype) else value  # -0.0 is 0.0
            exprs += [F.min(one).cast("string").alias(f"low{i}"), F.max(one).cast("string").alias(f"high{i}")]
            if m.count:
                exprs.append(F.hll_sketch_agg(F.when(value.isNotNull(), F.xxhash64(one))).alias(f"different{i}"))
        if m.is_numeric and m.count > m.nan_count:
            exprs.append(F.kll_sketch_agg_double(value.cast("double"), RANK_SKETCH).alias(f"ranks{i}"))
    blocks = [b for b in blocks.values() if b]
    got = {k: v for row in (aggregate_blocks(df, blocks) if blocks else []) for k, v in row.asDict().items()}
    rows = []
    for i, m in enumerate(found):
        m2 = m3 = None
        if m.count and m.mean is not None:
            m2 = (m.std or 0.0) ** 2 * (m.count - 1)
            m3 = (m.skew or 0.0) * m2 ** 1.5 / math.sqrt(m.count)
        rows.append((m.feature, i, m.is_numeric, m.rows, m.count, m.nan_count, m.mean, m2, m3, m.min, m.max,
                     got.get(f"low{i}"), got.get(f"high{i}"), is_scalar(type_of(df, m.feature)),
                     got.get(f"different{i}"), got.get(f"ranks{i}")))
    return df.sparkSession.createDataFrame(rows, STATE_SCHEMA)


def merge_states(states: Sequence[DataFrame]) -> DataFrame:
    """The state of all parts together. They must have the same columns."""
    each = reduce(DataFrame.unionByName, states)
    total = each.groupBy("feature").agg(
        (F.sum(F.col("mean") * F.col("count")) / F.sum(F.when(F.col("mean").isNotNull(), F.col("count")))).alias("centre"))
    n, d = F.col("count"), F.col("mean") - F.col("centre")
    whole = each.join(total, "feature").groupBy("feature").agg(
        F.min("place").alias("place"), F.first("is_numeric").alias("is_numeric"), F.sum("rows").alias("rows"),
        F.sum("count").alias("count"), F.sum("nan_count").alias("nan_count"), F.first("centre").alias("mean"),
        F.sum(F.col("m2") + n * d * d).alias("m2"),
        F.sum(F.col("m3") + 3 * d * F.col("m2") + n * d * d * d).alias("m3"),
        F.min("min").alias("min"), F.max("max").alias("max"), F.min("low").alias("low"), F.max("high").alias("high"),
        # the texts of numbers don't sort like numbers; here it only matters whether all are the same
        F.first("is_scalar").alias("is_scalar"), F.collect_list("different").alias("sketches"),
        F.collect_list("ranks").alias("ranked"))
    different = F.reduce(F.slice("sketches", 2, F.size("sketches")), F.get("sketches", F.lit(0)),
                         lambda a, b: F.hll_union(a, b))
    ranks = F.reduce(F.slice("ranked", 2, F.size("ranked")), F.get("ranked", F.lit(0)),
                     lambda a, b: F.kll_sketch_merge_double(a, b))
    return whole.withColumns({"different": F.when(F.size("sketches") > 0, different),
                              "ranks": F.when(F.size("ranked") > 0, ranks)}).select(
        *[f.name for f in T.StructType.fromDDL(STATE_SCHEMA)])


def measured_of(state: DataFrame) -> list[Measured]:
    """What a state says of each column, in the form of ``measure``."""
    found = []
    for r in state.orderBy("place").collect():
        n, m2, m3 = r["count"], r["m2"], r["m3"]
        number = r["is_numeric"]
        std = math.sqrt(m2 / (n - 1)) if number and m2 is not None and n > 1 else None
        skew = math.sqrt(n) * m3 / m2 ** 1.5 if number and m2 else None
        same = n == 0 or (n == r["rows"] and r["low"] is not None and r["low"] == r["high"])
        texts = (None, None) if number else (r["low"], r["high"])
        found.append(Measured(r["feature"], number, r["rows"], n, r["rows"] - n, r["nan_count"], r["mean"] if number else None,
                              std, skew, r["min"], r["max"], *texts, bool(r["is_scalar"]) and same))
    return found


def audit_of(state: DataFrame, rules: AuditRules = STANDARD) -> DataFrame:
    """The full audit of the table that a state describes."""
    return _full(state, measured_of(state), rules)


def stats_of(state: DataFrame) -> DataFrame:
    """Its statistics, with quartiles from the sketch."""
    shares = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    rows = state.select("feature", F.when(F.col("ranks").isNotNull(), F.kll_sketch_get_quantile_double("ranks", shares)).alias("q")).collect()
    quartiles = {r["feature"]: r["q"] or [None] * 3 for r in rows}
    return _stats(state, measured_of(state), quartiles)


def distinct_of(state: DataFrame) -> DataFrame:
    """feature and the estimated number of its distinct values, null not counted."""
    return state.where("is_scalar").select("feature", F.coalesce(F.hll_sketch_estimate("different"), F.lit(0)).alias("distinct_estimate"))
