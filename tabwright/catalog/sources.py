"""Reading, writing, snapshots, schema, preview and shape."""

from pyspark.sql import functions as F

import tabwright as tw
from tabwright.catalog.profiling import _CONSTANT, _HIGH_SKEW, _MISSING, _lineitem_audit
from tabwright.catalog.registry import Registry, rounded
from tabwright.plans.storage import new_path

QUERIES = Registry()

ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


@QUERIES.add("s1_read_csv", """
    SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def read_csv(t):
    path = tw.write_csv(t.customer, new_path(t.spark, "csv"))
    # inference takes the narrowest whole type
    return tw.read_csv(t.spark, path).withColumn("c_custkey", F.col("c_custkey").cast("bigint"))


_SPOILT = "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING, since TIMESTAMP_NTZ"


def _spoilt(t):
    """customer as CSV in which some numbers and dates are unreadable and some missing."""
    key = F.col("c_custkey")
    df = t.customer.withColumns({
        "c_nationkey": F.when(key % 11 == 0, F.concat(F.col("c_nationkey").cast("string"), F.lit("x"))).otherwise(F.col("c_nationkey").cast("string")),
        "c_acctbal": F.when(key % 7 == 0, "n/a").when(key % 13 != 0, F.col("c_acctbal").cast("string")),
        "since": F.when(key % 5 == 0, "last year").otherwise("2024-02-29 10:00:00"),
    })
    path = tw.write_csv(df, new_path(t.spark, "csv"))
    return tw.read_csv_checked(t.spark, path, _SPOILT)


@QUERIES.add("s1_read_csv_checked", """
    SELECT c_custkey, c_name, CASE WHEN c_custkey % 11 <> 0 THEN c_nationkey END AS c_nationkey,
           CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 13 <> 0 THEN c_acctbal END AS c_acctbal, c_mktsegment,
           CASE WHEN c_custkey % 5 <> 0 THEN TIMESTAMP '2024-02-29 10:00:00' END AS since FROM customer""")
def read_csv_checked(t):
    return _spoilt(t)[0]


@QUERIES.add("s1_bad_cells", """
    WITH bad AS (
      SELECT 'c_nationkey' AS "column", 'int' AS "type", CAST(c_nationkey AS VARCHAR) || 'x' AS text FROM customer WHERE c_custkey % 11 = 0
      UNION ALL SELECT 'c_acctbal', 'double', 'n/a' FROM customer WHERE c_custkey % 7 = 0
      UNION ALL SELECT 'since', 'timestamp_ntz', 'last year' FROM customer WHERE c_custkey % 5 = 0)
    SELECT "column", "type", count(*) AS bad_cells, count(DISTINCT text) AS bad_texts, min(text) AS example
    FROM bad GROUP BY 1, 2""")
def bad_cells(t):
    return tw.bad_cell_counts(_spoilt(t)[1])


@QUERIES.add("s1_missing_audit_checked", """
    WITH nulls AS (
      SELECT 'c_nationkey' AS feature, count(*) FILTER (c_custkey % 11 = 0) AS n, n AS bad, count(*) AS rows FROM customer
      UNION ALL SELECT 'c_acctbal', count(*) FILTER (c_custkey % 7 = 0 OR c_custkey % 13 = 0), count(*) FILTER (c_custkey % 7 = 0), count(*) FROM customer
      UNION ALL SELECT 'since', count(*) FILTER (c_custkey % 5 = 0) AS n, n, count(*) FROM customer)
    SELECT feature, 'Missing Values' AS issue, printf('%.1f%% Null', n / rows * 100) AS severity,
           CASE WHEN feature = 'since' THEN 'Impute with Mode' ELSE 'Impute with Median/Mean' END AS action,
           round(100.0 * n / rows, 6) AS metric, bad AS bad_cells FROM nulls WHERE n > 0""")
def missing_checked(t):
    return rounded(tw.missing_audit_checked(*_spoilt(t)), metric=6)


@QUERIES.add("s2_read_parquet", f"SELECT {ORDERS} FROM orders")
def read_parquet(t):
    return tw.read_parquet(t.spark, f"{t.folder}/orders.parquet")


@QUERIES.add("s3_write_csv", f"SELECT {ORDERS} FROM orders")
def write_csv(t):
    path = tw.write_csv(t.orders, new_path(t.spark, "csv"), "error")
    return tw.read_csv(t.spark, path, t.orders.schema)


@QUERIES.add("s4_write_parquet", f"""
    SELECT {ORDERS} FROM orders UNION ALL SELECT {ORDERS} FROM orders""")
def write_parquet(t):
    path = new_path(t.spark, "parquet")
    tw.write_parquet(t.orders, path, "overwrite")
    tw.write_parquet(t.orders, path, "append")
    return tw.read_parquet(t.spark, path)


@QUERIES.add("s5_snapshot", """
    SELECT c_custkey, '[REDACTED]' AS c_name, c_nationkey, abs(c_acctbal) AS c_acctbal,
           c_mktsegment, CAST(2 AS BIGINT) AS version FROM customer""")
def snapshot(t):
    path = new_path(t.spark, "snapshot")
    tw.save_snapshot(t.customer, path, "customers", mask_pii=True)
    stored = tw.transform_snapshot(t.spark, path, "c_acctbal", "abs")
    return stored.data.withColumn("version", F.lit(stored.version).cast("bigint"))


@QUERIES.add("s5_append_audit", _lineitem_audit(_MISSING, _HIGH_SKEW, _CONSTANT) + """
    SELECT *, CAST(3 AS BIGINT) AS version, (SELECT count(*) FROM lineitem) AS row_count FROM audit""")
def append_audit(t):
    """The table in three parts, two of them appended: the merged profile audits like the whole."""
    path, part = new_path(t.spark, "snapshot"), F.col("l_orderkey") % 3
    tw.save_snapshot(t.lineitem_n.where(part == 0), path, "lines")
    for k in (1, 2):
        tw.append_snapshot(t.lineitem_n.where(part == k), path)
    stored = tw.load_snapshot(t.spark, path)
    return rounded(stored.audit, metric=6).withColumns({
        "version": F.lit(stored.version).cast("bigint"), "row_count": F.lit(stored.meta["row_count"]).cast("bigint")})


@QUERIES.add("s5_append_data", "SELECT * FROM orders")
def append_data(t):
    path, part = new_path(t.spark, "snapshot"), F.col("o_orderkey") % 2
    tw.save_snapshot(t.orders.where(part == 0), path)
    tw.append_snapshot(t.orders.where(part == 1), path)
    return tw.load_snapshot(t.spark, path).data


_TYPES = {"o_orderkey": "LongType()", "o_custkey": "LongType()", "o_orderstatus": "StringType()",
          "o_totalprice": "DoubleType()", "o_orderdate": "TimestampNTZType()", "o_orderpriority": "StringType()"}
_TEXT = {"LongType()": "CAST(CAST({} AS DOUBLE) AS VARCHAR)", "DoubleType()": "CAST({} AS VARCHAR)"}


def _laid_out(t):
    """orders and customer in buckets by customer."""
    found = []
    for name, df, sort_by in (("orders", t.orders.withColumnRenamed("o_custkey", "custkey"), ["o_orderdate", "o_orderkey"]),
                              ("customer", t.customer.withColumnRenamed("c_custkey", "custkey"), [])):
        path = new_path(t.spark, name)
        found.append(tw.write_layout(df, f"laid_out_{path[-32:]}", path, "custkey", 8, sort_by))
    return found


@QUERIES.add("s4_layout_join", """
    SELECT o.* RENAME (o_custkey AS custkey), c.* EXCLUDE (c_custkey) FROM orders AS o JOIN customer AS c ON o_custkey = c_custkey""")
def layout_join(t):
    return tw.join_dataframes(*_laid_out(t), "custkey", "inner")


@QUERIES.add("s4_layout_windows", """
    SELECT o.* RENAME (o_custkey AS custkey),
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS row_number,
           lag(o_totalprice, 1) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS o_totalprice_lag_1,
           round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2)
           AS o_totalprice_cumsum FROM orders AS o""")
def layout_windows(t):
    orders, order = _laid_out(t)[0], ["o_orderdate", "o_orderkey"]
    df = tw.add_row_number(orders, "custkey", order)
    df = tw.add_lag_lead(df, "custkey", order, "o_totalprice", 1, "lag")
    return rounded(tw.add_running_total(df, "custkey", order, "o_totalprice"), o_totalprice_cumsum=2)


@QUERIES.add("s7_schema_info", " UNION ALL ".join(f"""
    SELECT '{c}' AS "column", '{k}' AS "type", true AS nullable, count({c}) AS count, count(*) - count({c}) AS null_count,
           {'NULL' if k in _TEXT else f'CAST(min({c}) AS VARCHAR)'} AS min_text,
           {'NULL' if k in _TEXT else f'CAST(max({c}) AS VARCHAR)'} AS max_text,
           count({c}) = count(*) AND min({c}) = max({c}) AS is_constant FROM orders""" for c, k in _TYPES.items()))
def schema_info(t):
    info = tw.schema_info(t.orders, observed=True)
    # the text of a floating number differs between engines
    number = F.col("type").isin(*_TEXT)
    return info.withColumns({n: F.when(~number, F.col(n)) for n in ("min_text", "max_text")})


@QUERIES.add("s8_preview", f"SELECT {ORDERS} FROM orders ORDER BY o_orderkey LIMIT 5")
def preview(t):
    return tw.preview(t.orders, 5, "o_orderkey")


@QUERIES.add("s9_shape", """
    SELECT count(*) AS row_count, CAST(11 AS BIGINT) AS column_count FROM lineitem""")
def shape(t):
    return tw.shape(t.lineitem)
