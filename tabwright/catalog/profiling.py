"""Statistics, audits, correlation. The audit SQL is put together per column."""

from pyspark.sql import functions as F

import tabwright as tw
from tabwright.catalog.registry import LINEITEM_N, Registry, rounded

QUERIES = Registry()

NUMERIC = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
           "l_discount", "l_tax", "const_col")
OTHER = ("l_returnflag", "l_linestatus", "l_shipdate")
ALL = NUMERIC + OTHER


def _skew(c: str) -> str:
    """Population skewness from the sample-adjusted one; null for a constant column."""
    return f"""CASE WHEN count({c}) > 2 AND min({c}) < max({c}) THEN skewness({c})
               * (count({c}) - 2) / sqrt(CAST(count({c}) AS DOUBLE) * (count({c}) - 1)) END"""


def _metrics(table: str, numeric: tuple[str, ...], other: tuple[str, ...]) -> str:
    """SQL for one row per column: counts, skew, constant flag."""
    rows = [f"""SELECT '{c}' AS feature, {'true' if c in numeric else 'false'} AS is_numeric,
            count(*) AS n, count(*) - count({c}) AS nulls,
            {_skew(c) if c in numeric else 'CAST(NULL AS DOUBLE)'} AS skew,
            (count({c}) = 0 OR (count({c}) = count(*) AND min({c}) = max({c}))) AS is_constant
            FROM {table}""" for c in numeric + other]
    return "metrics AS (" + " UNION ALL ".join(rows) + ")"


_MISSING = """SELECT feature, 'Missing Values' AS issue,
    printf('%.1f%% Null', nulls / n * 100) AS severity,
    CASE WHEN 100.0 * nulls / n > 40 THEN 'Drop Column' WHEN is_numeric
         THEN 'Impute with Median/Mean' ELSE 'Impute with Mode' END AS action,
    round(100.0 * nulls / n, 6) AS metric FROM metrics WHERE nulls > 0"""
_HIGH_SKEW = """SELECT feature, 'High Skew' AS issue,
    printf('Skewness: %.2f', skew) AS severity, 'Log Transform/Cap' AS action,
    round(skew, 6) AS metric FROM metrics WHERE abs(skew) > 1.5"""
_CONSTANT = """SELECT feature, 'Constant/Zero Variance' AS issue, 'Danger' AS severity,
    '🗑️ Drop this column' AS action, 1.0 AS metric FROM metrics WHERE is_constant"""
_CLEAN = """SELECT 'All' AS feature, 'None' AS issue, 'Clean' AS severity, 'Ready' AS action,
    CAST(NULL AS DOUBLE) AS metric"""


def _audit_sql(table: str, numeric: tuple[str, ...], other: tuple[str, ...], *parts: str,
               before: str = "") -> str:
    """The audit rows, or the clean row if there are none, as CTE ``audit``."""
    found = " UNION ALL ".join(parts)
    return f"""WITH {before + ',' if before else ''} {_metrics(table, numeric, other)},
        found AS ({found}),
        audit AS (SELECT feature, issue, severity, action, CAST(metric AS DOUBLE) AS metric FROM found
          UNION ALL SELECT * FROM ({_CLEAN}) AS c WHERE NOT EXISTS (SELECT 1 FROM found))"""


def _lineitem_audit(*parts: str) -> str:
    return _audit_sql("lineitem_n", NUMERIC, OTHER, *parts, before=LINEITEM_N)


_EVENTS = ("event_id", "user_id", "value"), ("ts", "event_type", "props")
_LABELS = ("doc_id", "quality", "toxic"), ()
_BADGE = """CASE WHEN severity LIKE '%Skewness%' AND shown > 2 THEN 'danger'
                 WHEN severity LIKE '%Null%' AND shown > 20 THEN 'danger'
                 WHEN severity LIKE '%Null%' AND shown > 0 THEN 'warning' ELSE 'success' END"""
_MARKED = f"""marked AS (SELECT feature, issue, severity, action, metric, {_BADGE} AS badge FROM (
    SELECT *, TRY_CAST(regexp_extract(severity, '-?[0-9]+(\\.[0-9]+)?') AS DOUBLE) AS shown
    FROM audit))"""


def _statistics(table: str, numeric: tuple[str, ...], other: tuple[str, ...],
                quartiles: bool) -> str:
    rows = []
    for c in numeric + other:
        number = c in numeric
        cells = [("count", f"CAST(count({c}) AS DOUBLE)", None),
                 ("mean", f"avg({c})" if number else None, None),
                 ("stddev", f"stddev_samp({c})" if number else None, None),
                 ("min", f"CAST(min({c}) AS DOUBLE)" if number else None, None if number else f"min({c})")]
        if quartiles:
            cells += [(f"{round(q * 100)}%", f"quantile_cont(CAST({c} AS DOUBLE), {q})" if number
                       else None, None) for q in (0.25, 0.5, 0.75)]
        cells.append(("max", f"CAST(max({c}) AS DOUBLE)" if number else None,
                      None if number else f"max({c})"))
        for statistic, value, text in cells:
            source = f" FROM {table}" if value or text else ""
            value = f"round({value}, 4)" if value else "CAST(NULL AS DOUBLE)"
            text = f"CAST({text} AS VARCHAR)" if text else "CAST(NULL AS VARCHAR)"
            rows.append(f"SELECT '{c}' AS feature, '{statistic}' AS statistic, {value} AS value, "
                        f"{text} AS text{source}")
    return " UNION ALL ".join(rows)


@QUERIES.add("d1_describe", f"WITH {LINEITEM_N} " + _statistics("lineitem_n", NUMERIC, OTHER, False))
def describe(t):
    return rounded(tw.describe_data(t.lineitem_n), value=4)


@QUERIES.add("d2_summary", f"WITH {LINEITEM_N} " + _statistics("lineitem_n", NUMERIC, OTHER, True))
def summary(t):
    return rounded(tw.summary_data(t.lineitem_n), value=4)


_QUARTILES = {"25%": 0.25, "50%": 0.5, "75%": 0.75}


@QUERIES.add("d2_summary_approximate", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, '{s}' AS statistic, count({c}) AS n, TRUE AS rank_within_bound FROM lineitem_n"
    for c in NUMERIC for s in _QUARTILES).join((f"WITH {LINEITEM_N} ", "")))
def summary_approximate(t):
    """Whether each approximate quartile's rank is within 1/accuracy of the wanted one, over all rows."""
    accuracy, table = 10_000, t.lineitem_n
    values = {(r["feature"], r["statistic"]): r["value"] for r in tw.summary_data(table, accuracy=accuracy).where(
        F.col("statistic").isin(*_QUARTILES)).where("value is not null").collect()}
    checks = []
    for (name, statistic), value in values.items():
        x, share = F.col(name).cast("double"), _QUARTILES[statistic]
        n = F.count(x)
        inside = (F.count_if(x < value) <= (share + 1 / accuracy) * n + 1) & (F.count_if(x <= value) >= (share - 1 / accuracy) * n - 1)
        checks.append(F.struct(F.lit(name).alias("feature"), F.lit(statistic).alias("statistic"), n.alias("n"),
                               inside.alias("rank_within_bound")))
    return table.agg(F.array(*checks).alias("c")).select(F.inline("c"))


def statistics_rows(table: str, numeric: tuple[str, ...], other: tuple[str, ...], top: bool = False) -> str:
    """SQL for one row of statistics per column."""
    rows = []
    for c in numeric + other:
        if c in numeric:
            x = f"CAST({c} AS DOUBLE)"
            values = [f"round({v}, 4)" for v in (
                f"avg({x})", f"stddev_samp({x})", f"min({x})", f"quantile_cont({x}, 0.25)", f"quantile_cont({x}, 0.5)",
                f"quantile_cont({x}, 0.75)", f"max({x})")] + ["NULL"] * 5
        else:
            best = (f"(SELECT CAST({c} AS VARCHAR) FROM {table} WHERE {c} IS NOT NULL GROUP BY {c} "
                    f"ORDER BY count(*) DESC, {c} LIMIT 1)")
            freq = (f"(SELECT count(*) FROM {table} WHERE {c} IS NOT NULL GROUP BY {c} "
                    f"ORDER BY count(*) DESC LIMIT 1)")
            values = ["NULL"] * 7 + [f"CAST(min({c}) AS VARCHAR)", f"CAST(max({c}) AS VARCHAR)", f"count(DISTINCT {c})", best, freq]
        rows.append(f"SELECT '{c}', count({c}), count(*) - count({c}), CAST(0 AS BIGINT), "
                    f"{', '.join(values if top else values[:-3])} FROM {table}")
    names = ('feature, count, null_count, nan_count, mean, std, min, "25%", "50%", "75%", max, '
             'min_text, max_text') + (', "unique", top, freq' if top else "")
    return f"SELECT * FROM ({' UNION ALL '.join(rows)}) AS s({names})"


_VALUES = dict.fromkeys(("mean", "std", "min", "25%", "50%", "75%", "max"), 4)


@QUERIES.add("d3_feature_stats", f"WITH {LINEITEM_N} " + statistics_rows("lineitem_n", NUMERIC, OTHER, True))
def feature_stats(t):
    return rounded(tw.feature_stats(t.lineitem_n, top=True), **_VALUES)


@QUERIES.add("d4_type_split", f"""
    WITH {LINEITEM_N}, levels AS (
      SELECT 'l_returnflag' AS "column", count(DISTINCT l_returnflag) AS levels FROM lineitem_n
      UNION ALL SELECT 'l_linestatus', count(DISTINCT l_linestatus) FROM lineitem_n)
    SELECT s.*, levels, levels = 2 AS binary, levels <= 1 AS constant FROM (VALUES
      {", ".join(f"('{c}', 'numeric', false)" for c in NUMERIC)},
      ('l_returnflag', 'categorical', true), ('l_linestatus', 'categorical', true), ('l_shipdate', 'categorical', false)
    ) AS s("column", kind, encodable) LEFT JOIN levels USING ("column")""")
def type_split(t):
    return tw.type_split(t.lineitem_n, observed=True)


@QUERIES.add("d5_missing_audit", _lineitem_audit(_MISSING) + " SELECT * FROM audit")
def missing_audit(t):
    return rounded(tw.missing_audit(t.lineitem_n), metric=6)


@QUERIES.add("d5_missing_audit_strict", f"""WITH {LINEITEM_N},
    {_metrics("lineitem_n", NUMERIC, OTHER)}
    SELECT feature, 'Missing Values' AS issue,
           CAST(round_even(100.0 * nulls / n, 2) AS VARCHAR) || '% Null' AS severity,
           CASE WHEN round_even(100.0 * nulls / n, 2) > 20
                THEN '⚠️ Consider dropping column or heavy imputation'
                ELSE '💡 Fill with Mean/Median/Mode' END AS action,
           round(100.0 * nulls / n, 6) AS metric
    FROM metrics WHERE round_even(100.0 * nulls / n, 2) > 0""")
def missing_audit_strict(t):
    return rounded(tw.missing_audit(t.lineitem_n, tw.STRICT), metric=6)


@QUERIES.add("d6_skew_audit", _audit_sql("events", *_EVENTS, _HIGH_SKEW) + " SELECT * FROM audit")
def skew_audit(t):
    return rounded(tw.skew_audit(t.events), metric=6)


@QUERIES.add("d6_skew_audit_adjusted", """
    SELECT feature, 'High Skew' AS issue, printf('Skewness: %.2f', skew) AS severity,
           'Log Transform/Cap' AS action, round(skew, 6) AS metric FROM (
      SELECT 'quality' AS feature, skewness(quality) AS skew FROM labels
      UNION ALL SELECT 'toxic', skewness(toxic) FROM labels
      UNION ALL SELECT 'doc_id', skewness(doc_id) FROM labels) WHERE abs(skew) > 1.5""")
def skew_audit_adjusted(t):
    return rounded(tw.skew_audit(t.labels, adjusted=True), metric=6)


@QUERIES.add("d7_constant_audit", _lineitem_audit(_CONSTANT) + " SELECT * FROM audit")
def constant_audit(t):
    return tw.constant_audit(t.lineitem_n)


@QUERIES.add("d8_clean_marker", _audit_sql("orders", ("o_orderkey", "o_custkey", "o_totalprice"),
             ("o_orderstatus", "o_orderdate", "o_orderpriority"), _MISSING, _HIGH_SKEW, _CONSTANT)
             + " SELECT * FROM audit")
def clean_marker(t):
    return rounded(tw.full_audit(t.orders), metric=6)


@QUERIES.add("d9_full_audit", _lineitem_audit(_MISSING, _HIGH_SKEW, _CONSTANT)
             + " SELECT * FROM audit")
def full_audit(t):
    return rounded(tw.full_audit(t.lineitem_n), metric=6)


@QUERIES.add("d9_full_audit_events", _audit_sql("events", *_EVENTS, _MISSING, _HIGH_SKEW, _CONSTANT)
             + " SELECT * FROM audit")
def full_audit_events(t):
    return rounded(tw.full_audit(t.events), metric=6)


@QUERIES.add("d10_correlation", f"WITH {LINEITEM_N} " + " UNION ALL ".join(f"""
    SELECT '{a}' AS x, '{b}' AS y, CASE WHEN isnan(c) THEN NULL ELSE round(c, 6) END AS corr
    FROM (SELECT corr({a}, {b}) AS c FROM lineitem_n)""" for a in NUMERIC for b in NUMERIC))
def correlation(t):
    return rounded(tw.correlation_matrix(t.lineitem_n), corr=6)


@QUERIES.add("d11_audit_severity", _lineitem_audit(_MISSING, _HIGH_SKEW, _CONSTANT)
             + f", {_MARKED} SELECT * FROM marked")
def audit_severity(t):
    return rounded(tw.audit_severity(tw.full_audit(t.lineitem_n)), metric=6)


@QUERIES.add("d11_audit_severity_signed", _audit_sql("labels", *_LABELS, _MISSING, _HIGH_SKEW,
             _CONSTANT) + f", {_MARKED} SELECT * FROM marked")
def audit_severity_signed(t):
    return rounded(tw.audit_severity(tw.full_audit(t.labels)), metric=6)


@QUERIES.add("d12_scorecard", f"""WITH {LINEITEM_N}, {_metrics("lineitem_n", NUMERIC, OTHER)}
    SELECT max(n) AS rows, count(*) FILTER (nulls > 0) AS missing_features,
           count(*) FILTER (abs(skew) > 1.5) AS skewed_features FROM metrics""")
def scorecard(t):
    return tw.scorecard(t.lineitem_n)


@QUERIES.add("d13_critical_audit", _lineitem_audit(_MISSING, _HIGH_SKEW, _CONSTANT) + f""",
    {_MARKED} SELECT * FROM marked WHERE badge IN ('warning', 'danger')
    AND (severity LIKE '%Null%' OR severity LIKE '%Skew%')
    ORDER BY metric DESC, feature LIMIT 15""")
def critical_audit(t):
    return rounded(tw.critical_audit(tw.full_audit(t.lineitem_n)), metric=6)
