"""Joins, grouping, distinct, value counts, sorting, sampling."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import tabwright as tw
from tabwright.catalog.registry import LINEITEM_N, Registry, rounded
from tabwright.plans import storage

QUERIES = Registry()


def _customers(t):
    return t.customer.withColumnRenamed("c_custkey", "custkey")


def _orders(t):
    return t.orders.withColumnRenamed("o_custkey", "custkey")


_CUSTOMERS = "customers AS (SELECT * RENAME (c_custkey AS custkey) FROM customer)"
_ORDERS = "ordered AS (SELECT * RENAME (o_custkey AS custkey) FROM orders)"
_SIZES = """suppliers AS (SELECT * RENAME (s_nationkey AS k) FROM supplier),
            parts AS (SELECT * RENAME (p_size AS k) FROM part)"""


@QUERIES.add("j1_inner", f"""
    WITH {_CUSTOMERS}, {_ORDERS} SELECT * FROM ordered JOIN customers USING (custkey)""")
def inner(t):
    return tw.join_dataframes(_orders(t), _customers(t), "custkey", "inner")


@QUERIES.add("j2_left", f"""
    WITH {_CUSTOMERS}, {_ORDERS} SELECT * FROM customers LEFT JOIN ordered USING (custkey)""")
def left(t):
    return tw.join_dataframes(_customers(t), _orders(t), "custkey", "left")


@QUERIES.add("j3_right", f"""
    WITH {_CUSTOMERS}, {_ORDERS} SELECT * FROM ordered RIGHT JOIN customers USING (custkey)""")
def right(t):
    return tw.join_dataframes(_orders(t), _customers(t), "custkey", "right")


@QUERIES.add("j4_outer", f"""
    WITH {_SIZES} SELECT * FROM suppliers FULL JOIN parts USING (k)""")
def outer(t):
    return tw.join_dataframes(t.supplier.withColumnRenamed("s_nationkey", "k"),
                              t.part.withColumnRenamed("p_size", "k"), "k", "outer")


@QUERIES.add("j5_cross_on_key", """
    SELECT c.c_custkey, c.c_name, c.c_nationkey AS n_nationkey, c.c_acctbal, c.c_mktsegment,
           n.n_name, n.n_regionkey
    FROM customer AS c JOIN nation AS n ON c.c_nationkey = n.n_nationkey""")
def cross_on_key(t):
    return tw.join_dataframes(t.customer.withColumnRenamed("c_nationkey", "n_nationkey"),
                              t.nation, "n_nationkey", "cross")


@QUERIES.add("j6_semi", f"""
    WITH {_SIZES} SELECT * FROM parts WHERE EXISTS
    (SELECT 1 FROM suppliers WHERE suppliers.k = parts.k)""")
def semi(t):
    return tw.join_dataframes(t.part.withColumnRenamed("p_size", "k"),
                              t.supplier.withColumnRenamed("s_nationkey", "k"), "k", "semi")


@QUERIES.add("j7_anti", f"""
    WITH {_SIZES} SELECT * FROM parts WHERE NOT EXISTS
    (SELECT 1 FROM suppliers WHERE suppliers.k = parts.k)""")
def anti(t):
    return tw.join_dataframes(t.part.withColumnRenamed("p_size", "k"),
                              t.supplier.withColumnRenamed("s_nationkey", "k"), "k", "anti")


_AGGREGATES = {"sum": "sum", "avg": "avg", "count": "count", "min": "min", "max": "max",
               "stddev": "stddev_samp"}


def _grouped(function: str, sql_function: str):
    value = f"{sql_function}(l_quantity)"
    value = value if function == "count" else f"round({value}, 6)"

    @QUERIES.add(f"a1_groupby_{function}", f"""
        WITH {LINEITEM_N} SELECT l_returnflag, l_linestatus, {value} AS l_quantity_{function}
        FROM lineitem_n GROUP BY l_returnflag, l_linestatus""")
    def group(t):
        result = tw.group_and_aggregate(t.lineitem_n, ["l_returnflag", "l_linestatus"],
                                        {"l_quantity": function})
        return result if function == "count" else rounded(result, **{f"l_quantity_{function}": 6})


for _function, _sql in _AGGREGATES.items():
    _grouped(_function, _sql)


@QUERIES.add("a1_groupby_many", """
    SELECT o_custkey, round(sum(o_totalprice), 2) AS o_totalprice_sum,
           max(o_totalprice) AS o_totalprice_max, count(o_orderkey) AS o_orderkey_count,
           min(o_orderdate) AS o_orderdate_min, max(o_orderdate) AS o_orderdate_max
    FROM orders GROUP BY o_custkey""")
def group_many(t):
    result = tw.group_and_aggregate(t.orders, "o_custkey", {
        "o_totalprice": ["sum", "max"], "o_orderkey": "count", "o_orderdate": ["min", "max"]})
    return rounded(result, o_totalprice_sum=2)


@QUERIES.add("a2_count", "SELECT count(*) AS row_count FROM lineitem")
def count(t):
    return tw.row_count(t.lineitem)


@QUERIES.add("a3_distinct", "SELECT DISTINCT * FROM (FROM lineitem UNION ALL FROM lineitem WHERE l_orderkey % 3 = 0)")
def distinct(t):
    """All columns, with a third of the rows there twice."""
    return tw.drop_duplicates(t.lineitem.union(t.lineitem.where("l_orderkey % 3 = 0")))


@QUERIES.add("a3_distinct_subset", """
    SELECT * EXCLUDE (nth) FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth
      FROM orders) WHERE nth = 1""")
def distinct_subset(t):
    return tw.drop_duplicates(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"])


@QUERIES.add("a4_unique", f"""
    WITH {LINEITEM_N}
    """ + " UNION ALL ".join(f"""
    SELECT '{n}' AS feature, count(DISTINCT {n})
           + CAST(coalesce(max(CASE WHEN {n} IS NULL THEN 1 ELSE 0 END), 0) AS BIGINT) AS unique_count
    FROM lineitem_n""" for n in ("l_orderkey", "l_quantity", "l_tax", "l_returnflag", "l_linestatus",
                                 "l_shipdate", "const_col")))
def unique(t):
    return tw.unique_count(t.lineitem_n, ["l_orderkey", "l_quantity", "l_tax", "l_returnflag",
                                          "l_linestatus", "l_shipdate", "const_col"])


_ROLLED = ("l_returnflag, l_linestatus", "l_returnflag", "")
_COUNTED = ("l_orderkey", "l_partkey", "l_quantity", "l_shipdate")


@QUERIES.add("a4_unique_rollup", f"WITH {LINEITEM_N}" + " UNION ALL ".join(f"""
    SELECT {"l_returnflag" if "flag" in by else "CAST(NULL AS VARCHAR)"} AS l_returnflag,
           {"l_linestatus" if "status" in by else "CAST(NULL AS VARCHAR)"} AS l_linestatus, '{n}' AS feature,
           count(*) AS rows, count(DISTINCT {n}) + max(CASE WHEN {n} IS NULL THEN 1 ELSE 0 END) AS unique_count, TRUE AS within_bound
    FROM lineitem_n {f"GROUP BY {by}" if by else ""}""" for by in _ROLLED for n in _COUNTED))
def unique_rollup(t):
    """From one table of states the distinct values of every group, of groups of groups and of all, with exact counts."""
    table = t.lineitem_n
    states = storage.written(tw.distinct_states(table, ["l_returnflag", "l_linestatus"], list(_COUNTED)), "states")
    found = []
    for by in _ROLLED:
        keys = by.split(", ") if by else []
        estimated = tw.unique_of(states, keys)
        exact = table.groupBy(*keys).agg(F.array(*[F.struct(F.lit(n).alias("feature"), (
            F.count_distinct(n) + F.max(F.col(n).isNull().cast("bigint"))).alias("unique_count")) for n in _COUNTED]).alias("s")).select(
                *keys, F.inline("s")).withColumnsRenamed({k: f"k_{k}" for k in keys}).withColumnRenamed("feature", "k_feature")
        same = F.col("feature") == F.col("k_feature")
        for k in keys:
            same &= F.col(k).eqNullSafe(F.col(f"k_{k}"))
        found.append(estimated.join(exact, same).select(
            *[F.col(k) if k in keys else F.lit(None).cast("string").alias(k) for k in ("l_returnflag", "l_linestatus")],
            "feature", "rows", "unique_count", F.col("unique_count").between(F.col("low"), F.col("high")).alias("within_bound")))
    return reduce(DataFrame.union, found)


@QUERIES.add("a5_topk", """
    SELECT user_id AS value, count(*) AS count FROM events WHERE user_id IS NOT NULL
    GROUP BY user_id ORDER BY count DESC, value LIMIT 10""")
def topk(t):
    return tw.value_counts(t.events, "user_id", 10)


_MIXED = """CASE WHEN l_orderkey % 10 < 3 THEN l_suppkey ELSE 1000000 + l_orderkey * 8 + l_linenumber END"""


def _mixed(t):
    """Seven tenths of the rows have a value of their own, the others share a few."""
    return t.lineitem.withColumn("code", F.expr(_MIXED))


@QUERIES.add("a5_topk_near_unique", f"""
    SELECT {_MIXED} AS value, count(*) AS count FROM lineitem GROUP BY value ORDER BY count DESC, value LIMIT 10""")
def topk_near_unique(t):
    return tw.value_counts(_mixed(t), "code", 10)


@QUERIES.add("a6_mode_near_unique", f"""
    SELECT {_MIXED} AS code, count(*) AS count FROM lineitem GROUP BY code ORDER BY count DESC, code LIMIT 1""")
def mode_near_unique(t):
    return tw.mode(_mixed(t), "code")


@QUERIES.add("a6_mode", f"""
    WITH {LINEITEM_N} SELECT l_returnflag, count(*) AS count FROM lineitem_n
    WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag
    ORDER BY count DESC, l_returnflag LIMIT 1""")
def mode(t):
    return tw.mode(t.lineitem_n, "l_returnflag")


@QUERIES.add("o1_sort", "SELECT * FROM orders ORDER BY o_totalprice, o_orderkey")
def sort(t):
    return tw.sort_data(t.orders, ["o_totalprice", "o_orderkey"])


@QUERIES.add("o2_topn", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def topn(t):
    return tw.top_n(t.orders, ["o_totalprice", "o_orderkey"], 15, [False, True])


@QUERIES.add("o3_sample", """
    SELECT * FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':42'), o_orderkey LIMIT 1000""")
def sample(t):
    return tw.sample_n(t.orders, 1000, "o_orderkey")
