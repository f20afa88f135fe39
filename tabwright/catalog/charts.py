"""The tables behind the charts."""

import math

from pyspark.sql import functions as F

import tabwright as tw
from tabwright.catalog.registry import Registry, rounded
from tabwright.operators.charts import (
    FACTORS, KDE_GRID, NORMAL_95, OFFSET, POISSON, PRIME, VIOLIN_CUT, VIOLIN_GRID,
)

QUERIES = Registry()


def _histogram_sql(table: str, column: str, whole: bool, feature: str = "") -> str:
    """Non-empty bins; the bin width is the finer of Sturges and Freedman-Diaconis."""
    shape = f"'{column}' AS feature, " if feature else ""
    return f"""
    SELECT {shape}bin, round(lo + bin * w, 6) AS low, round(lo + (bin + 1) * w, 6) AS high,
           count(*) AS count
    FROM (SELECT lo, (hi - lo) / bins AS w,
                 CAST(least(floor(({column} - lo) / ((hi - lo) / bins)), bins - 1) AS BIGINT) AS bin
          FROM {table}, (
            SELECT lo, hi, ceil((hi - lo) / {'greatest(width, 1.0)' if whole else 'width'}) AS bins
            FROM (SELECT lo, hi, CASE WHEN iqr > 0
                    THEN least((hi - lo) / (log2(n) + 1), 2 * iqr * pow(n, -1.0 / 3))
                    ELSE (hi - lo) / (log2(n) + 1) END AS width
                  FROM (SELECT count({column}) AS n, CAST(min({column}) AS DOUBLE) AS lo,
                          CAST(max({column}) AS DOUBLE) AS hi,
                          quantile_cont({column}, 0.75) - quantile_cont({column}, 0.25) AS iqr
                        FROM {table})))
          WHERE {column} IS NOT NULL)
    GROUP BY bin, lo, w"""


def _kde_sql(table: str, column: str, keys: tuple[str, ...], grid: int, cut: float, digits: int = 7) -> str:
    by = "".join(f"{k}, " for k in keys)
    using = f"JOIN fit USING ({', '.join(keys)})" if keys else "CROSS JOIN fit"
    return f"""
    WITH fit AS (SELECT {by}count({column}) AS n, min({column}) AS lo, max({column}) AS hi,
                        stddev_samp({column}) * pow(count({column}), -0.2) AS h
                 FROM {table} GROUP BY {by + '()' if not keys else ', '.join(keys)}),
    SELECT {by}CAST(point AS INTEGER) AS point, round(x, 6) AS x,
           round(sum(exp(-0.5 * pow((x - v) / h, 2))) / (any_value(n) * any_value(h) * {math.sqrt(2 * math.pi)!r}), {digits})
             AS density
    FROM (SELECT *, {column} AS v, lo - {cut} * h + point * ((hi - lo + 2 * {cut} * h) / {grid - 1}) AS x
          FROM {table} {using}, range({grid}) AS g(point))
    GROUP BY {by}point, x"""


@QUERIES.add("v1_histogram", _histogram_sql("events", "value", False))
def histogram(t):
    return rounded(tw.histogram(t.events, "value"), low=6, high=6)


@QUERIES.add("v1_histogram_fixed", """
    SELECT bin, round(lo + bin * (hi - lo) / 20, 6) AS low,
           round(lo + (bin + 1) * (hi - lo) / 20, 6) AS high, count(*) AS count
    FROM (SELECT lo, hi, CAST(least(floor((c_acctbal - lo) / ((hi - lo) / 20)), 19) AS BIGINT) AS bin
          FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer))
    GROUP BY bin, lo, hi""")
def histogram_fixed(t):
    return rounded(tw.histogram(t.customer, "c_acctbal", 20), low=6, high=6)


@QUERIES.add("v2_kde", _kde_sql("events", "value", (), KDE_GRID, 0.0))
def kde(t):
    return rounded(tw.kde(t.events, "value"), x=6, density=7)


@QUERIES.add("v3_category_bars", """
    SELECT p_brand AS value, count(*) AS count FROM part WHERE p_brand IS NOT NULL
    GROUP BY p_brand ORDER BY count DESC, value LIMIT 10""")
def category_bars(t):
    return tw.category_bars(t.part, "p_brand")


@QUERIES.add("v4_scatter", """
    SELECT o_totalprice, o_custkey, o_orderstatus FROM orders
    WHERE o_totalprice IS NOT NULL AND o_custkey IS NOT NULL AND o_orderstatus IS NOT NULL""")
def scatter(t):
    return tw.scatter(t.orders, "o_totalprice", "o_custkey", "o_orderstatus")


@QUERIES.add("v5_regression", """
    SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope,
           round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
           round(regr_r2(l_extendedprice, l_quantity), 8) AS r2,
           CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n FROM lineitem""")
def regression(t):
    return rounded(tw.regression_line(t.lineitem, "l_quantity", "l_extendedprice"),
                   slope=6, intercept=4, r2=8)


@QUERIES.add("v6_line", f"""
    SELECT l_linenumber, l_returnflag, round(m, 4) AS mean, n, round(m - half, 4) AS low,
           round(m + half, 4) AS high
    FROM (SELECT l_linenumber, l_returnflag, avg(l_extendedprice) AS m, count(*) AS n,
                 {NORMAL_95} * stddev_samp(l_extendedprice) / sqrt(count(*)) AS half
          FROM lineitem GROUP BY l_linenumber, l_returnflag)""")
def line(t):
    result = tw.line(t.lineitem, "l_linenumber", "l_extendedprice", "l_returnflag")
    return rounded(result, mean=4, low=4, high=4)


def _steps(source: str, seed: int = 42) -> str:
    """Sub-selects that carry the hash of a row through its rounds."""
    sql = f"SELECT *, (row_no * {FACTORS[0]} + b * {FACTORS[1]} + {seed}) % {PRIME} AS h FROM {source}"
    for factor in FACTORS[1:]:
        sql = f"SELECT * REPLACE ((h * (h % 65536 + {factor}) + {OFFSET}) % {PRIME} AS h) FROM ({sql})"
    return sql


@QUERIES.add("v6_line_bootstrap", f"""
    WITH numbered AS (
      SELECT l_linenumber, l_returnflag, l_extendedprice AS y, (l_orderkey % {PRIME} * 31 + l_linenumber) % {PRIME} AS row_no FROM lineitem),
    samples AS ({_steps("(SELECT * FROM numbered, (SELECT CAST(unnest(range(1, 101)) AS BIGINT) AS b))")}),
    sums AS (
      SELECT l_linenumber, l_returnflag, b, sum(w * y) / sum(w) AS m
      FROM (SELECT *, {" + ".join(f"CAST(h >= {t} AS BIGINT)" for t in POISSON)} AS w FROM samples) GROUP BY ALL),
    ends AS (SELECT l_linenumber, l_returnflag, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM sums GROUP BY ALL)
    SELECT l_linenumber, l_returnflag, round(avg(y), 2) AS mean, count(*) AS n, round(any_value(low), 2) AS low, round(any_value(high), 2) AS high
    FROM numbered JOIN ends USING (l_linenumber, l_returnflag) GROUP BY l_linenumber, l_returnflag""")
def line_bootstrap(t):
    result = tw.line(t.lineitem, "l_linenumber", "l_extendedprice", "l_returnflag", replicates=100, key=["l_orderkey", "l_linenumber"])
    return rounded(result, mean=2, low=2, high=2)


@QUERIES.add("v7_bar", """
    SELECT event_type, round(avg(value), 6) AS mean FROM events
    WHERE event_type IS NOT NULL AND value IS NOT NULL GROUP BY event_type""")
def bar(t):
    return rounded(tw.bar(t.events, "event_type", "value"), mean=6)


_BOX = """
    WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2,
                      quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type)
    SELECT event_type, round(q1, 6) AS q1, round(q2, 6) AS median, round(q3, 6) AS q3,
           min(value) FILTER (inside) AS whisker_low, max(value) FILTER (inside) AS whisker_high,
           count(*) AS n, count(*) FILTER (NOT inside) AS outliers
    FROM (SELECT *, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
          FROM events JOIN q USING (event_type))
    GROUP BY event_type, q1, q2, q3"""


@QUERIES.add("v8_box", _BOX)
def box(t):
    return rounded(tw.box(t.events, "event_type", "value"), q1=6, median=6, q3=6)


@QUERIES.add("v9_violin", f"""
    SELECT *, CASE WHEN l_linestatus = (SELECT min(l_linestatus) FROM lineitem) THEN 'left'
              ELSE 'right' END AS side
    FROM ({_kde_sql("lineitem", "l_extendedprice", ("l_returnflag", "l_linestatus"),
                    VIOLIN_GRID, VIOLIN_CUT, 10)
           .replace("round(x, 6)", "round(x, 4)")})""")
def violin(t):
    result = tw.violin(t.lineitem, "l_returnflag", "l_extendedprice", "l_linestatus")
    return rounded(result, x=4, density=10)


def _all_sql() -> str:
    numbers = [f"""SELECT feature, 'numeric' AS kind, bin, low, high, CAST(NULL AS VARCHAR) AS value,
                   count FROM ({_histogram_sql('part', c, whole, c)})"""
               for c, whole in (("p_partkey", True), ("p_size", True), ("p_retailprice", False))]
    texts = [f"""SELECT '{c}', 'categorical', CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE),
                 CAST(NULL AS DOUBLE), {c}, n FROM (
                   SELECT {c}, count(*) AS n FROM part WHERE {c} IS NOT NULL GROUP BY {c}
                   ORDER BY n DESC, {c} LIMIT 10)""" for c in ("p_name", "p_brand", "p_type")]
    return " UNION ALL ".join(numbers + texts)


@QUERIES.add("v10_all_distributions", _all_sql())
def all_distributions(t):
    return tw.all_distributions(t.part).withColumns(
        {"low": F.round("low", 6), "high": F.round("high", 6)})
