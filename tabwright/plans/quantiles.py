"""Exact quantiles whose memory does not grow with the table.

The built-in ``percentile`` keeps every distinct value in one buffer. Instead:

* whole columns: a mergeable sketch (KLL) of each column puts every wanted rank
  between two values; a second scan counts the rows up to them, and each of the
  values between them if these are at most ``DIRECT_ROWS`` rows, a few thousandths
  of all; if not, another round works on them alone. Each scan reads a column by itself,
  several at a time. The number of rounds follows from the number of rows, not
  from the values: a value that fills a bracket is one of its ends;
* groups: the built-in where all groups are small; otherwise values are counted
  per group, ordered across many tasks, and the wanted ranks are read off the
  running totals.

Quantiles interpolate linearly between the two neighbouring values.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tabwright.functions.schema import column, columns, present, same_key
from tabwright.plans.jobs import aggregate_blocks
from tabwright.plans.ordering import RUNNING, number_rows
from tabwright.plans.skew import find_hot_keys

DIRECT_ROWS = 100_000
#: Size of a sketch, and the share of the rows by which its ranks are taken to be off at most; where they are off
#: by more, another round follows.
SKETCH_SIZE, RANK_ERROR = 4096, 0.0015
HOT_GROUP_ROWS = 250_000


@dataclass
class _Gap:
    """Values of a column strictly between two known ones (None: no bound), the rows below and inside, and the
    positions wanted in it."""

    name: str
    low: float | None
    high: float | None
    below: int
    inside: int
    positions: list[int]

    @property
    def clusters(self) -> list[tuple[int, int]]:
        """First and last of the positions that are neighbours."""
        found: list[list[int]] = []
        for position in sorted(self.positions):
            if found and position <= found[-1][1] + 1:
                found[-1][1] = position
            else:
                found.append([position, position])
        return [(first, last) for first, last in found]


def exact_quantiles(df: DataFrame, names: Sequence[str], probs: Sequence[float],
                    known: Mapping[str, tuple[int, float, float]] | None = None,
                    nan_as_null: bool = False, direct_rows: int = DIRECT_ROWS,
                    enclosed: Mapping[str, list[tuple[float, float]]] | None = None) -> dict[str, list[float | None]]:
    """Quantiles of each column as ``{name: [value per probability]}``; None without values.

    ``known`` gives (non-null count, min, max) per column and spares the job
    that finds them, when the caller has them from a profile; ``enclosed`` is
    what ``enclosing_values`` gave. NaN ranks last.
    """
    if not names:
        return {}
    values = {name: present(df, name, nan_as_null).cast("double") for name in names}
    if known is None:
        known = counts_and_bounds(df, values)
    numbers = _numbers(values)
    sizes = {n: known[n][0] for n in names}
    with_nan = [n for n in names if sizes[n] and math.isnan(known[n][2])]
    if with_nan:
        row = df.agg(*[F.count(numbers[n]).alias(str(i)) for i, n in enumerate(with_nan)]).first()
        sizes |= {n: row[i] for i, n in enumerate(with_nan)}
    ranks = {(n, p): p * (known[n][0] - 1) for n in names if known[n][0] for p in probs}
    positions: dict[str, set[int]] = {}
    for (n, _), rank in ranks.items():
        positions.setdefault(n, set()).update((math.floor(rank), math.ceil(rank)))
    found: dict[tuple[str, int], float] = {}
    waiting = []
    for n, wanted in positions.items():
        found.update({(n, p): math.nan for p in wanted if p >= sizes[n]})
        rest = sorted(p for p in wanted if p < sizes[n])
        if known[n][1] == known[n][2]:
            found.update({(n, p): float(known[n][1]) for p in rest})
        elif rest:
            waiting.append(_Gap(n, None, None, 0, sizes[n], rest))
    while waiting:
        waiting = _narrowed(df, numbers, waiting, found, direct_rows, enclosed or {})
        enclosed = None

    def quantile(name: str, prob: float) -> float | None:
        if (name, prob) not in ranks:
            return None
        rank = ranks[name, prob]
        low, high = found[name, math.floor(rank)], found[name, math.ceil(rank)]
        return low if low == high else low + (rank - math.floor(rank)) * (high - low)

    return {n: [quantile(n, p) for p in probs] for n in names}


def enclosing_values(df: DataFrame, names: Sequence[str], probs: Sequence[float],
                     nan_as_null: bool = False) -> dict[str, list[tuple[float, float]]]:
    """For each column two values around each quantile, which need no count and so can be found beside a profile."""
    numbers = _numbers({n: present(df, n, nan_as_null).cast("double") for n in names})
    shares = [s for p in probs for s in (max(0.0, p - RANK_ERROR), min(1.0, p + RANK_ERROR))]
    blocks = []
    for n in names:
        sketch = F.kll_sketch_agg_double(numbers[n], SKETCH_SIZE)
        ends = F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(s) for s in shares]))
        blocks.append([F.when(F.kll_sketch_get_n_double(sketch) > 0, ends).alias("ends")])
    found = [row["ends"] or [] for row in aggregate_blocks(df, blocks)]
    return {n: list(zip(ends[::2], ends[1::2])) for n, ends in zip(names, found)}


def _numbers(values: Mapping[str, Column]) -> dict[str, Column]:
    return {n: F.when(~F.isnan(v), v) for n, v in values.items()}


def counts_and_bounds(df: DataFrame,
                      values: Mapping[str, Column]) -> dict[str, tuple[int, float, float]]:
    names = list(values)
    row = df.agg(*[f(values[n]).alias(f"{label}{i}") for i, n in enumerate(names)
                   for label, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    return {n: (row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"]) for i, n in enumerate(names)}


def _between(x: Column, low: float | None, high: float | None) -> Column:
    """The value where it lies strictly between the bounds, else null."""
    if low is not None and high is not None:
        return F.when((x > low) & (x < high), x)
    return x if low is None and high is None else F.when(x > low if high is None else x < high, x)


def _brackets(df: DataFrame, numbers: Mapping[str, Column], gaps: list[_Gap]) -> list[list[tuple[float, float]]]:
    """For each gap the two values that enclose each cluster of its positions, by one sketch for each gap."""
    blocks = []
    for g in gaps:
        shares = [s for first, last in g.clusters for s in (
            max(0.0, (first - g.below) / g.inside - RANK_ERROR), min(1.0, (last + 1 - g.below) / g.inside + RANK_ERROR))]
        sketch = F.kll_sketch_agg_double(_between(numbers[g.name], g.low, g.high), SKETCH_SIZE)
        blocks.append([F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(s) for s in shares])).alias("ends")])
    found = [row["ends"] for row in aggregate_blocks(df, blocks)]
    return [list(zip(ends[::2], ends[1::2])) for ends in found]


def _sql(value: float) -> str:
    return f"CAST('{value!r}' AS DOUBLE)" if math.isinf(value) else f"{value!r}D"


@dataclass
class _Plan:
    """The ends cut a gap into stretches: before the first end, equal to it, between it and the next one, and so on.
    Of the stretches in ``listed`` every value counts by itself."""

    gap: _Gap
    ends: list[float]
    listed: list[int]

    def cells(self, df: DataFrame, x: Column, number: int) -> DataFrame:
        # as text, which costs the driver one call instead of hundreds
        steps = "".join(f" WHEN x < {_sql(e)} THEN {2 * k} WHEN x = {_sql(e)} THEN {2 * k + 1}" for k, e in enumerate(self.ends))
        place = f"CASE{steps} ELSE {2 * len(self.ends)} END" if steps else "0"
        listed = ", ".join(map(str, self.listed)) or "-1"
        kept = df.select(_between(x, self.gap.low, self.gap.high).alias("x")).where("x IS NOT NULL").selectExpr("x", f"{place} AS s")
        return kept.selectExpr(f"{number} AS gap", "s", f"CASE WHEN s IN ({listed}) THEN x END AS v")


def _hits(df: DataFrame, numbers: Mapping[str, Column], plans: list[_Plan]) -> list[Row]:
    """The stretches (gap, s, and v where listed) that hold a wanted position: rows in them, and up to their end.

    Map tasks add up the rows of all gaps, each of which reads its column only.
    """
    cells = reduce(DataFrame.union, [p.cells(df, numbers[p.gap.name], i) for i, p in enumerate(plans)])
    counted = cells.groupBy("gap", "s", "v").agg(F.count(F.lit(1)).alias("n"))
    lists = (f"array({', '.join(f'{q - p.gap.below}L' for q in p.gap.positions)})" for p in plans)
    wanted = F.expr(f"get(array({', '.join(lists)}), gap)")
    upto = F.sum("n").over(Window.partitionBy("gap").orderBy("s", "v"))
    return counted.withColumn("upto", upto).where(F.exists(
        wanted, lambda p: (p < F.col("upto")) & (p >= F.col("upto") - F.col("n")))).collect()


def _narrowed(df: DataFrame, numbers: Mapping[str, Column], gaps: list[_Gap], found: dict[tuple[str, int], float],
              direct_rows: int, enclosed: Mapping[str, list[tuple[float, float]]]) -> list[_Gap]:
    """One round: values at positions go to ``found``; what stays open comes back as smaller gaps."""
    large = [g for g in gaps if g.inside > direct_rows]
    unknown = [g for g in large if g.name not in enclosed]
    brackets = {id(g): enclosed[g.name] for g in large if g.name in enclosed}
    brackets |= dict(zip(map(id, unknown), _brackets(df, numbers, unknown))) if unknown else {}
    plans = []
    for g in gaps:
        pairs = brackets.get(id(g), [])
        ends = sorted({e for pair in pairs for e in pair})
        listed = [] if ends else [0]
        if 2 * RANK_ERROR * g.inside + 2 <= direct_rows:  # what lies between the values of a pair
            listed += [s for low, high in pairs for s in range(2 * ends.index(low) + 2, 2 * ends.index(high) + 1, 2)]
        plans.append(_Plan(g, ends, listed))
    smaller = []
    for r in _hits(df, numbers, plans):
        g, ends = plans[r["gap"]].gap, plans[r["gap"]].ends
        upto = g.below + r["upto"]
        here = [p for p in g.positions if upto - r["n"] <= p < upto]
        value = ends[r["s"] // 2] if r["s"] % 2 else r["v"]
        if value is not None:
            found.update({(g.name, p): value for p in here})
            continue
        before, after = r["s"] // 2 - 1, r["s"] // 2
        smaller.append(_Gap(g.name, ends[before] if before >= 0 else g.low, ends[after] if after < len(ends) else g.high,
                            upto - r["n"], r["n"], here))
    return smaller


def grouped_quantiles(df: DataFrame, keys: list[str], name: str, probs: Sequence[float],
                      aliases: Sequence[str], hot_rows: int = HOT_GROUP_ROWS) -> DataFrame:
    """One row per group with exact quantiles of ``name``, in columns ``aliases``."""
    filled = df.where(column(name).isNotNull()).select(
        *columns(keys), column(name).cast("double").alias("__value"))
    hot = find_hot_keys(filled, keys, hot_rows)
    if hot is None:
        return _direct_groups(filled, keys, probs, aliases)
    large = _ranked_groups(hot.rows_of(filled), keys, hot, probs, aliases)
    if hot.covers_all:
        return large
    return large.unionByName(_direct_groups(hot.rest_of(filled), keys, probs, aliases))


def _direct_groups(df, keys, probs, aliases) -> DataFrame:
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    grouped = df.groupBy(*columns(keys)).agg(F.percentile("__value", wanted).alias("__q"))
    return grouped.select(*columns(keys), *[F.col("__q")[i].alias(a) for i, a in enumerate(aliases)])


def _ranked_groups(df, keys, hot, probs, aliases) -> DataFrame:
    counted = df.groupBy(*columns(keys), F.col("__value")).agg(F.count(F.lit(1)).alias("__n"))
    ranked = number_rows(counted, keys, [F.col("__value")], hot.rows, weight=F.col("__n"))
    renamed = {key: f"__hot_{i}" for i, key in enumerate(keys)}
    totals = hot.hinted(hot.table.withColumnsRenamed(renamed).withColumnRenamed("__rows", "__all"))
    joined = ranked.join(totals, same_key(ranked, totals, list(renamed.items())))

    picks, results = [], []
    for i, (p, alias) in enumerate(zip(probs, aliases)):
        rank = F.lit(float(p)) * (F.col("__all") - 1)
        for end, place in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            here = (F.col(RUNNING) > place) & (F.col(RUNNING) - F.col("__n") <= place)
            picks.append(F.max(F.when(here, F.col("__value"))).alias(f"__{end}{i}"))
        whole = F.lit(float(p)) * (F.col("__all") - 1)
        low, high = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        results.append((low + (whole - F.floor(whole)) * (high - low)).alias(alias))
    grouped = joined.groupBy(*columns(keys), F.col("__all")).agg(*picks)
    return grouped.select(*columns(keys), *results)
