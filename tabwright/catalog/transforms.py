"""Column transforms: fitted on the whole table, applied to every row."""

import tabwright as tw
from tabwright.catalog.profiling import statistics_rows
from tabwright.catalog.registry import LINEITEM_N, Registry, rounded
from tabwright.plans.storage import new_path

QUERIES = Registry()


def _customer(name: str, expression: str, kind: str, with_fit: str = "", **options):
    """A transform of customer.c_acctbal, which has negative values."""
    fit = f", (SELECT {with_fit} FROM customer) AS fit" if with_fit else ""

    @QUERIES.add(name, f"""
        SELECT customer.* REPLACE (round({expression}, 6) AS c_acctbal) FROM customer{fit}""")
    def build(t):
        return rounded(tw.transform(t.customer, "c_acctbal", kind, **options), c_acctbal=6)


_customer("t1_log", "CASE WHEN c_acctbal > -1 THEN ln(1 + c_acctbal) END", "log", shift=False)
_customer("t2_log_shifted", """CASE WHEN lo <= 0 THEN ln(1 + (c_acctbal - lo + 1))
          ELSE ln(1 + c_acctbal) END""", "log", "min(c_acctbal) AS lo")
_customer("t3_sqrt_abs", "sqrt(abs(c_acctbal))", "sqrt", clip=False)
_customer("t4_sqrt_clip", "sqrt(CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END)", "sqrt")
_customer("t5_square", "c_acctbal * c_acctbal", "square")
_customer("t6_abs", "abs(c_acctbal)", "abs")
_customer("t7_reciprocal", "1.0 / NULLIF(c_acctbal, 0)", "reciprocal")
_customer("t8_standard_scale", "(c_acctbal - m) / s", "standard_scale",
          "avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s")
_customer("t8_standard_scale_population", "(c_acctbal - m) / s", "standard_scale",
          "avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s", ddof=0)
_customer("t9_minmax_scale", "(c_acctbal - lo) / (hi - lo)", "minmax_scale",
          "min(c_acctbal) AS lo, max(c_acctbal) AS hi")


@QUERIES.add("t9_minmax_scale_constant", f"""
    WITH {LINEITEM_N} SELECT * FROM lineitem_n""")
def minmax_constant(t):
    return tw.transform(t.lineitem_n, "const_col", "minmax_scale")


def _fill(name: str, column: str, fit: str, kind: str, **options):
    """A fill of a lineitem column with injected nulls."""
    @QUERIES.add(name, f"""
        WITH {LINEITEM_N}, fit AS (SELECT {fit} AS v FROM lineitem_n)
        SELECT * REPLACE (coalesce({column}, (SELECT v FROM fit)) AS {column}) FROM lineitem_n""")
    def build(t):
        return tw.transform(t.lineitem_n, column, kind, **options)


@QUERIES.add("t10_fill_mean", f"""
    WITH {LINEITEM_N}, fit AS (SELECT avg(l_quantity) AS v FROM lineitem_n)
    SELECT * REPLACE (round(coalesce(l_quantity, (SELECT v FROM fit)), 6) AS l_quantity) FROM lineitem_n""")
def fill_mean(t):
    return rounded(tw.fill_nulls(t.lineitem_n, "l_quantity", "mean"), l_quantity=6)


_fill("t11_fill_median", "l_quantity", "quantile_cont(l_quantity, 0.5)", "fill_median")


@QUERIES.add("t12_fill_mode", f"""
    WITH {LINEITEM_N}, fit AS (
      SELECT l_returnflag AS v FROM lineitem_n WHERE l_returnflag IS NOT NULL
      GROUP BY l_returnflag ORDER BY count(*) DESC, l_returnflag LIMIT 1)
    SELECT * REPLACE (coalesce(l_returnflag, (SELECT v FROM fit)) AS l_returnflag) FROM lineitem_n""")
def fill_mode(t):
    return tw.fill_nulls(t.lineitem_n, "l_returnflag", "mode")


@QUERIES.add("t13_fill_zero", f"""
    WITH {LINEITEM_N}
    SELECT * REPLACE (coalesce(l_tax, 0) AS l_tax) FROM lineitem_n""")
def fill_zero(t):
    return tw.fill_nulls(t.lineitem_n, "l_tax", "zero")


@QUERIES.add("t13_fill_value", f"""
    WITH {LINEITEM_N}
    SELECT * REPLACE (coalesce(l_returnflag, 'none') AS l_returnflag) FROM lineitem_n""")
def fill_value(t):
    return tw.fill_nulls(t.lineitem_n, "l_returnflag", "custom", value="none")


@QUERIES.add("t14_cap_outliers", """
    WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
    SELECT events.* REPLACE (round(CASE WHEN value < q1 - 1.5 * (q3 - q1) THEN q1 - 1.5 * (q3 - q1)
                                        WHEN value > q3 + 1.5 * (q3 - q1) THEN q3 + 1.5 * (q3 - q1)
                                        ELSE value END, 6) AS value)
    FROM events, q""")
def cap_outliers(t):
    return rounded(tw.transform(t.events, "value", "cap_outliers_iqr"), value=6)


def _bins(name: str, count: int, kind: str, **options):
    steps = " ".join(f"WHEN value <= lo + (hi - lo) / {count} * {i} THEN 'Bin {i}'"
                     for i in range(1, count))

    @QUERIES.add(name, f"""
        SELECT events.* REPLACE (CASE WHEN value IS NULL THEN NULL {steps} ELSE 'Bin {count}' END AS value)
        FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events) AS fit""")
    def build(t):
        return tw.transform(t.events, "value", kind, **options)


_bins("t15_binning_5", 5, "binning_5")
_bins("t15_binning_8", 8, "binning", bins=8)


@QUERIES.add("t16_label_encode", f"""
    WITH {LINEITEM_N}, codes AS (
      SELECT l_returnflag, row_number() OVER (ORDER BY l_returnflag) - 1 AS code
      FROM (SELECT DISTINCT l_returnflag FROM lineitem_n WHERE l_returnflag IS NOT NULL))
    SELECT n.* REPLACE (code AS l_returnflag) FROM lineitem_n AS n LEFT JOIN codes AS c ON n.l_returnflag = c.l_returnflag""")
def label_encode(t):
    return tw.transform(t.lineitem_n, "l_returnflag", "label_encode")


@QUERIES.add("t16_label_encode_many", """
    WITH codes AS (
      SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS c_name_code
      FROM (SELECT DISTINCT c_name FROM customer WHERE c_name IS NOT NULL))
    SELECT customer.*, c_name_code FROM customer LEFT JOIN codes USING (c_name)""")
def label_encode_many(t):
    return tw.transform(t.customer, "c_name", "label_encode", "c_name_code")


@QUERIES.add("t17_transform_profile", """
    WITH changed AS (SELECT * REPLACE (ln(1 + value + (SELECT CASE WHEN min(value) <= 0 THEN 1 - min(value) ELSE 0 END FROM events)) AS value)
                     FROM events) """
             + statistics_rows("changed", ("event_id", "user_id", "value"), ("ts", "event_type", "props")))
def transform_profile(t):
    stats = tw.profile(tw.transform(t.events, "value", "log")).stats
    return rounded(stats, **dict.fromkeys(("mean", "std", "min", "25%", "50%", "75%", "max"), 4))


@QUERIES.add("t17_saved_steps", """
    WITH first AS (SELECT * FROM events WHERE event_id % 3 = 0),
    q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM first),
    capped AS (
      SELECT events.* REPLACE (CASE WHEN value < q1 - 1.5 * (q3 - q1) THEN q1 - 1.5 * (q3 - q1)
                                    WHEN value > q3 + 1.5 * (q3 - q1) THEN q3 + 1.5 * (q3 - q1) ELSE value END AS value) FROM events, q),
    fit AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM capped WHERE event_id % 3 = 0),
    codes AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS code
              FROM (SELECT DISTINCT event_type FROM first WHERE event_type IS NOT NULL))
    SELECT c.* REPLACE (round((value - m) / s, 6) AS value, code AS event_type)
    FROM capped AS c, fit LEFT JOIN codes ON codes.event_type = c.event_type""")
def saved_steps(t):
    """Three transforms fitted on a third of the rows, saved, loaded, and applied to all."""
    first, steps = t.events.where("event_id % 3 = 0"), []
    for name, kind in (("value", "cap_outliers_iqr"), ("value", "standard_scale"), ("event_type", "label_encode")):
        steps.append(tw.fit(first, name, kind))
        first = steps[-1].apply(first)
    path = tw.save_fit(t.spark, steps, new_path(t.spark, "fit"))
    return rounded(tw.apply_fit(t.events, tw.load_fit(t.spark, path)), value=6)


@QUERIES.add("t_drop_nulls", f"""
    WITH {LINEITEM_N} SELECT * FROM lineitem_n WHERE l_tax IS NOT NULL""")
def drop_nulls(t):
    return tw.transform(t.lineitem_n, "l_tax", "drop_nulls")


@QUERIES.add("t_drop_duplicates", "SELECT DISTINCT * FROM lineitem")
def drop_duplicates(t):
    return tw.transform(t.lineitem, "l_orderkey", "drop_duplicates")
