"""The tables behind the charts. No drawing; every operator uses all rows unless a sample is asked for."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.schema import (
    as_list, column, columns, is_numeric, numeric_columns, present, require,
    scalar_columns, type_of,
)
from tabwright.operators.columns import drop_nulls
from tabwright.operators.relational import sample_n, value_counts
from tabwright.plans.quantiles import counts_and_bounds, exact_quantiles, grouped_quantiles
from tabwright.plans.storage import attach, written

#: The density counts rows in cells of this share of the bandwidth and follows each cell so many bandwidths.
CELLS_PER_BANDWIDTH, REACH = 64, 8.5
# The defaults of the plots whose data this is.
KDE_GRID = 200
VIOLIN_GRID = 100
VIOLIN_CUT = 2.0
TOP_VALUES = 10
NORMAL_95 = 1.959963984540054


def _numeric(df: DataFrame, *names: str) -> None:
    for name in names:
        if not is_numeric(type_of(df, name)):
            raise ValueError(f"{name} is not numeric")


def _without_nulls(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns of the rows where all have a value; NaN is none in a chart."""
    require(df, *names)
    return drop_nulls(df.select(*columns(dict.fromkeys(names))), nan_as_null=True)


def _automatic_bins(n: int, low: float, high: float, quartile_range: float, whole: bool) -> int:
    """The finer of Sturges and Freedman-Diaconis; whole numbers never get bins below 1."""
    if n == 0 or high == low:
        return 1
    width = (high - low) / (math.log2(n) + 1)
    if quartile_range > 0:
        width = min(width, 2 * quartile_range * n ** (-1 / 3))
    if whole:
        width = max(width, 1.0)
    return max(1, math.ceil((high - low) / width))


def _histograms(df: DataFrame, names: list[str], bins: int | None) -> DataFrame:
    """(feature, bin, low, high, count) of several numeric columns, non-empty bins only."""
    values = {n: present(df, n, nan_as_null=True).cast("double") for n in names}
    known = counts_and_bounds(df, values)
    quartiles = {} if bins else exact_quantiles(df, names, [0.25, 0.75], known, True)
    cells = []
    for n in names:
        count, low, high = known[n]
        if not count:
            continue
        if bins:
            number = bins
        else:
            q1, q3 = quartiles[n]
            number = _automatic_bins(count, low, high, q3 - q1, not _has_fraction(df, n))
        if low == high:
            # a single value gets one bin of width one around it, as histogram tools do
            low, high = low - 0.5, high + 0.5
        width = (high - low) / number
        place = F.least(F.floor((values[n] - low) / F.lit(width)),
                        F.lit(number - 1)).cast("bigint")
        cells.append(F.struct(F.lit(n).alias("feature"), place.alias("bin"),
                              F.lit(low).alias("start"), F.lit(width).alias("width")))
    if not cells:
        return df.sparkSession.createDataFrame(
            [], "feature string, bin bigint, low double, high double, count bigint")
    placed = df.select(F.inline(F.array(*cells))).where(F.col("bin").isNotNull())
    return placed.groupBy("feature", "bin", "start", "width").agg(
        F.count(F.lit(1)).alias("count"),
    ).select("feature", "bin", (F.col("start") + F.col("bin") * F.col("width")).alias("low"),
             (F.col("start") + (F.col("bin") + 1) * F.col("width")).alias("high"), "count")


def _has_fraction(df: DataFrame, name: str) -> bool:
    return type_of(df, name).typeName() in ("float", "double", "decimal")


def histogram(df: DataFrame, name: str, bins: int | None = None) -> DataFrame:
    """(bin, low, high, count): equal-width bins, the last one closed; nulls left out."""
    _numeric(df, name)
    if bins is not None and bins < 1:
        raise ValueError("bins must be at least 1")
    return _histograms(df, [name], bins).drop("feature")


def kde(df: DataFrame, name: str, by: str | Sequence[str] | None = None, grid: int = KDE_GRID,
        cut: float = 0.0) -> DataFrame:
    """Gaussian density curve with Scott's bandwidth: (keys, point, x, density).

    Rows are first counted in cells whose width is a fixed part of the group's
    bandwidth, so the error does not depend on the spread or the number of rows.
    A cell stands at the mean of its values, corrected by their variance, and
    only meets the grid points within ``REACH`` bandwidths; a group costs at most
    about ``2 * REACH * CELLS_PER_BANDWIDTH * grid`` rows. ``cut`` extends the
    grid by that many bandwidths.
    """
    keys = as_list(by)
    _numeric(df, name)
    base = _without_nulls(df, [*keys, name]).select(
        *columns(keys), column(name).cast("double").alias("__v"))
    spread = F.col("__sd") * F.pow(F.col("__n").cast("double"), F.lit(-0.2))
    fit = base.groupBy(*columns(keys)).agg(
        F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"),
        F.stddev_samp("__v").alias("__sd"),
    ).where((F.col("__n") > 1) & (F.col("__sd") > 0)).withColumn("__h", spread).drop("__sd")
    params = ["__n", "__lo", "__hi", "__h"]
    if keys:
        fit = written(fit, "density-fit")
        fitted = attach(base, fit, keys).where(F.col("__n").isNotNull())
    else:
        row = fit.first()
        if row is None:
            return df.sparkSession.createDataFrame([], "point int, x double, density double")
        fit = df.sparkSession.range(1).select(*[F.lit(row[c]).alias(c) for c in params])
        fitted = base.select("*", *[F.lit(row[c]).alias(c) for c in params])
    cell = F.floor((F.col("__v") - F.col("__lo")) / F.col("__h") * CELLS_PER_BANDWIDTH)
    cells = fitted.groupBy(*columns(keys), *params, cell.alias("__cell")).agg(
        F.count(F.lit(1)).alias("__w"), F.avg("__v").alias("__m"), F.var_pop("__v").alias("__s"))
    start = F.col("__lo") - F.lit(float(cut)) * F.col("__h")
    step = (F.col("__hi") - F.col("__lo") + 2 * F.lit(float(cut)) * F.col("__h")) / (grid - 1)
    first = F.greatest(F.ceil((F.col("__m") - REACH * F.col("__h") - start) / step), F.lit(0))
    last = F.least(F.floor((F.col("__m") + REACH * F.col("__h") - start) / step), F.lit(grid - 1))
    near = F.when(first <= last, F.sequence(first.cast("int"), last.cast("int")))
    square = F.pow((start + F.col("point") * step - F.col("__m")) / F.col("__h"), 2)
    bent = 1 + 0.5 * (square - 1) * F.col("__s") / (F.col("__h") * F.col("__h"))
    met = cells.withColumn("point", F.explode(near)).select(
        *columns(keys), *params, "point", (F.col("__w") * F.exp(-0.5 * square) * bent).alias("__k"))
    every = fit.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))).withColumn("__k", F.lit(0.0))
    total = F.sum("__k") / (F.col("__n") * F.col("__h") * F.lit(math.sqrt(2 * math.pi)))
    summed = met.unionByName(every).groupBy(*columns(keys), *params, "point").agg(total.alias("density"))
    return summed.select(*columns(keys), "point", (start + F.col("point") * step).alias("x"), "density")


def category_bars(df: DataFrame, name: str, top: int = TOP_VALUES) -> DataFrame:
    """The most frequent values of one column."""
    return value_counts(df, name, top)


def distribution(df: DataFrame, name: str, bins: int | None = None) -> DataFrame:
    """The distribution of one column: a histogram if numeric, else its top values."""
    return histogram(df, name, bins) if is_numeric(type_of(df, name)) else category_bars(df, name)


def all_distributions(df: DataFrame, bins: int | None = None, top: int = TOP_VALUES) -> DataFrame:
    """Histograms of all numeric and top values of all other scalar columns, in long form.

    (feature, kind, bin, low, high, value, count). One job per kind, not per column.
    """
    shape = "feature", "kind", "bin", "low", "high", "value", "count"
    numbers = numeric_columns(df)
    others = [n for n in scalar_columns(df) if n not in numbers]
    parts = []
    if numbers:
        parts.append(_histograms(df, numbers, bins).select(
            "*", F.lit("numeric").alias("kind"), F.lit(None).cast("string").alias("value"))
            .select(*shape))
    if others:
        cells = [F.struct(F.lit(n).alias("feature"), column(n).cast("string").alias("value"))
                 for n in others]
        counts = (df.select(F.inline(F.array(*cells))).where(F.col("value").isNotNull())
                  .groupBy("feature", "value").agg(F.count(F.lit(1)).alias("count")))
        # the rank filter keeps `top` rows per feature in each task before the shuffle
        place = Window.partitionBy("feature").orderBy(F.desc("count"), F.asc("value"))
        best = counts.withColumn("__nth", F.row_number().over(place)).where(F.col("__nth") <= top)
        none = F.lit(None)
        parts.append(best.select(
            "feature", F.lit("categorical").alias("kind"), none.cast("bigint").alias("bin"),
            none.cast("double").alias("low"), none.cast("double").alias("high"), "value", "count"))
    if not parts:
        raise ValueError("no column with a distribution")
    return reduce(DataFrame.unionByName, parts)


def scatter(df: DataFrame, x: str, y: str, hue: str | None = None, rows: int | None = None,
            key: str | Sequence[str] | None = None, seed: int = 42) -> DataFrame:
    """Points for a scatter plot: all rows without nulls.

    Only when the caller names a number of ``rows`` it is a repeatable sample,
    which the ``key`` of a row decides.
    """
    wanted = list(dict.fromkeys(n for n in (x, y, hue) if n))
    kept = drop_nulls(df, wanted, nan_as_null=True)
    if rows is None:
        return kept.select(*columns(wanted))
    if key is None:
        raise ValueError("a sample needs key=, the columns that identify a row")
    names = list(dict.fromkeys([*as_list(key), *wanted]))
    return sample_n(kept.select(*columns(names)), rows, key, seed).select(*columns(wanted))


def regression_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line over all rows with both values: (slope, intercept, r2, n).

    Null for a constant x.
    """
    _numeric(df, x, y)
    a, b = column(x).cast("double"), column(y).cast("double")
    return df.agg(F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"),
                  F.regr_r2(b, a).alias("r2"), F.regr_count(b, a).alias("n"))


def _group_means(df: DataFrame, x: str, y: str, hue: str | None, *extra: Column) -> DataFrame:
    _numeric(df, y)
    keys = list(dict.fromkeys(n for n in (x, hue) if n))
    kept = _without_nulls(df, [*keys, y])
    return kept.groupBy(*columns(keys)).agg(F.avg(column(y)).alias("mean"), *extra)


def line(df: DataFrame, x: str, y: str, hue: str | None = None, replicates: int | None = None,
         key: str | Sequence[str] | None = None, seed: int = 42) -> DataFrame:
    """Mean of y per x (and hue) with a 95 % interval.

    Without ``replicates`` it is the normal one, null for a single row; with them
    the percentile interval of that many bootstrap samples, repeatable by ``key``,
    the columns that identify a row.
    """
    if replicates is not None:
        return _bootstrapped(df, x, y, hue, replicates, key, seed)
    value = column(y).cast("double")
    means = _group_means(df, x, y, hue, F.stddev_samp(value).alias("__sd"),
                         F.count(F.lit(1)).alias("n"))
    half = F.lit(NORMAL_95) * F.col("__sd") / F.sqrt(F.col("n"))
    return means.withColumns({"low": F.col("mean") - half, "high": F.col("mean") + half}).drop("__sd")


#: Modulus, factors and offset of the hash that draws weights, and the distribution function of Poisson(1) in its units.
PRIME, FACTORS, OFFSET = 2_147_483_647, (48_271, 40_692, 69_621), 1_013_904_223
POISSON = [int(PRIME * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(9)]


def _row_number(df: DataFrame, names: Sequence[str]) -> Column:
    """A number below PRIME for each row: from its key columns, whole numbers as they are and others by hash."""
    number = F.lit(0).cast("bigint")
    for n in names:
        value = column(n).cast("bigint") if isinstance(type_of(df, n), T.IntegralType) else F.xxhash64(column(n))
        number = (number * 31 + F.pmod(value, F.lit(PRIME))) % PRIME
    return number


def _weighed(df: DataFrame, seed: int) -> DataFrame:
    """Adds ``__w``, how often the row ``__row`` is in the bootstrap sample ``__b``: Poisson(1), by a hash of both with
    two products of its own digits. Sample 0 is the table itself. Each round is a column of its own, computed once."""
    df = df.withColumn("__h", (F.col("__row") * FACTORS[0] + F.col("__b").cast("bigint") * FACTORS[1] + seed) % PRIME)
    h = F.col("__h")
    for factor in FACTORS[1:]:
        df = df.withColumn("__h", (h * (h % 65_536 + factor) + OFFSET) % PRIME)
    times = F.when(h < POISSON[0], 0)
    for k, t in enumerate(POISSON[1:], 1):
        times = times.when(h < t, k)
    return df.withColumn("__w", F.when(F.col("__b") == 0, 1).otherwise(times.otherwise(len(POISSON))).cast("bigint"))


def _bootstrapped(df: DataFrame, x: str, y: str, hue: str | None, replicates: int, key, seed: int) -> DataFrame:
    """Every sample weighs every row; map tasks add up the sums of each group and sample in one aggregate."""
    if replicates < 1:
        raise ValueError("replicates must be at least 1")
    names = as_list(key)
    if not names:
        raise ValueError("a bootstrap needs key=, the columns that identify a row")
    _numeric(df, y)
    require(df, *names)
    keys = list(dict.fromkeys(n for n in (x, hue) if n))
    kept = drop_nulls(df, [*keys, y])
    drawn = kept.select(*columns(keys), column(y).cast("double").alias("__y"), _row_number(kept, names).alias("__row"),
                        F.explode(F.sequence(F.lit(0), F.lit(replicates))).alias("__b"))
    sums = _weighed(drawn, seed).groupBy(*columns(keys), "__b").agg(
        F.sum("__w").alias("__n"), F.sum(F.col("__w") * F.col("__y")).alias("__s"))
    mean, sample = F.try_divide("__s", "__n"), F.col("__b") > 0
    ends = F.percentile(F.when(sample, mean), F.array(F.lit(0.025), F.lit(0.975)))
    return sums.groupBy(*columns(keys)).agg(
        F.max(F.when(~sample, mean)).alias("mean"), F.max(F.when(~sample, F.col("__n"))).alias("n"), ends.alias("__ends")).select(
        *columns(keys), "mean", "n", F.get("__ends", F.lit(0)).alias("low"), F.get("__ends", F.lit(1)).alias("high"))


def bar(df: DataFrame, x: str, y: str, hue: str | None = None) -> DataFrame:
    """Mean of y per x (and hue)."""
    return _group_means(df, x, y, hue)


def box(df: DataFrame, x: str, y: str, hue: str | None = None) -> DataFrame:
    """Quartiles, whisker ends within 1.5 IQR and number of outliers per x (and hue)."""
    _numeric(df, y)
    keys = list(dict.fromkeys(n for n in (x, hue) if n))
    kept = _without_nulls(df, [*keys, y])
    quartiles = grouped_quantiles(kept, keys, y, [0.25, 0.5, 0.75], ["__q1", "__q2", "__q3"])
    marked = attach(kept, quartiles, keys)
    value = column(y).cast("double")
    reach = 1.5 * (F.col("__q3") - F.col("__q1"))
    inside = (value >= F.col("__q1") - reach) & (value <= F.col("__q3") + reach)
    return marked.groupBy(*columns(keys), "__q1", "__q2", "__q3").agg(
        F.min(F.when(inside, value)).alias("whisker_low"),
        F.max(F.when(inside, value)).alias("whisker_high"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(~inside).alias("outliers"),
    ).withColumnsRenamed({"__q1": "q1", "__q2": "median", "__q3": "q3"})


def violin(df: DataFrame, x: str, y: str, hue: str | None = None, grid: int = VIOLIN_GRID,
           cut: float = VIOLIN_CUT) -> DataFrame:
    """Density per x (and hue); with exactly two hues, ``side`` says which half each one takes."""
    keys = list(dict.fromkeys(n for n in (x, hue) if n))
    curves = kde(df, y, keys, grid, cut)
    if not hue:
        return curves.withColumn("side", F.lit("both"))
    ends = _without_nulls(df, [*keys, y]).agg(
        F.min(column(hue)), F.max(column(hue)), F.count_distinct(column(hue))).first()
    low, _, number = ends
    if number != 2:
        return curves.withColumn("side", F.lit("both"))
    return curves.withColumn("side", F.when(column(hue) == F.lit(low), "left").otherwise("right"))


CHARTS = {"scatter": scatter, "line": line, "bar": bar, "box": box, "violin": violin}


def chart(df: DataFrame, kind: str, x: str, y: str, hue: str | None = None) -> DataFrame:
    """The data of one chart by name."""
    if kind not in CHARTS:
        raise ValueError(f"unknown chart {kind!r}; use {', '.join(CHARTS)}")
    return CHARTS[kind](df, x, y, hue)
