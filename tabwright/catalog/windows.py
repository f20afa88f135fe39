"""Window functions over the orders of each customer, and over a conversation."""

from pyspark.sql import functions as F

import tabwright as tw
from tabwright.catalog.registry import Registry, rounded

QUERIES = Registry()

KEY, ORDER = "o_custkey", ["o_orderdate", "o_orderkey"]
_OVER = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"


@QUERIES.add("w1_row_number", f"SELECT *, row_number() {_OVER}) AS row_number FROM orders")
def row_number(t):
    return tw.add_row_number(t.orders, KEY, ORDER)


@QUERIES.add("w2_rank", """
    SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS rank FROM orders""")
def rank(t):
    return tw.add_rank(t.orders, KEY, "o_orderdate", "rank")


@QUERIES.add("w3_dense_rank", """
    SELECT *, dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC) AS dense_rank
    FROM orders""")
def dense_rank(t):
    return tw.add_rank(t.orders, "o_orderstatus", "o_orderdate", "dense_rank")


@QUERIES.add("w4_lag", f"SELECT *, lag(o_totalprice, 1) {_OVER}) AS o_totalprice_lag_1 FROM orders")
def lag(t):
    return tw.add_lag_lead(t.orders, KEY, ORDER, "o_totalprice", 1, "lag")


@QUERIES.add("w5_lead", """
    SELECT *, lead(role, 2) OVER (PARTITION BY conv_id ORDER BY turn) AS role_lead_2 FROM conversations""")
def lead(t):
    return tw.add_lag_lead(t.conversations, "conv_id", "turn", "role", 2, "lead")


@QUERIES.add("w6_cumsum", f"""
    SELECT *, round(sum(o_totalprice) {_OVER}
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS o_totalprice_cumsum
    FROM orders""")
def cumsum(t):
    return rounded(tw.add_running_total(t.orders, KEY, ORDER, "o_totalprice"),
                   o_totalprice_cumsum=2)


_BY_TYPE = "OVER (PARTITION BY event_type ORDER BY ts, event_id)"
_RANKED = "OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC)"


@QUERIES.add("w7_dispatch", f"""
    SELECT *, row_number() {_BY_TYPE} AS row_number, rank() {_RANKED} AS rank, dense_rank() {_RANKED} AS dense_rank,
           lag(value, 2) {_BY_TYPE} AS value_lag_2, lead(value, 1) {_BY_TYPE} AS value_lead_1,
           round(sum(value) {_BY_TYPE[:-1]} ROWS UNBOUNDED PRECEDING), 2) AS value_cumsum
    FROM events""")
def dispatch(t):
    """All six functions by name, one after the other."""
    order = ["ts", "event_id"]
    df = tw.window_function(t.events, "row_number", "event_type", order)
    for func in ("rank", "dense_rank"):
        df = tw.window_function(df, func, "event_type", order)
    df = tw.window_function(df, "lag", "event_type", order, "value", 2)
    df = tw.window_function(df, "lead", "event_type", order, "value", 1)
    return rounded(tw.window_function(df, "cumsum", "event_type", order, "value"), value_cumsum=2)


# The same results by the route for hot keys: every order status counts as hot here.
_HOT = "OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey"


@QUERIES.add("w_hot_row_number", f"SELECT *, row_number() {_HOT}) AS row_number FROM orders")
def hot_row_number(t):
    return tw.add_row_number(t.orders, "o_orderstatus", ORDER, hot_rows=100)


@QUERIES.add("w_hot_rank", """
    SELECT *, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC) AS rank
    FROM orders""")
def hot_rank(t):
    return tw.add_rank(t.orders, "o_orderstatus", "o_orderdate", "rank", hot_rows=100)


@QUERIES.add("w_hot_lead", f"""
    SELECT *, lead(o_totalprice, 3) {_HOT}) AS o_totalprice_lead_3 FROM orders""")
def hot_lead(t):
    return tw.add_lag_lead(t.orders, "o_orderstatus", ORDER, "o_totalprice", 3, "lead", hot_rows=100)


@QUERIES.add("w_hot_cumsum", f"""
    SELECT *, round(sum(o_totalprice) {_HOT}
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS o_totalprice_cumsum
    FROM orders""")
def hot_cumsum(t):
    result = tw.add_running_total(t.orders, "o_orderstatus", ORDER, "o_totalprice", hot_rows=100)
    return result.withColumn("o_totalprice_cumsum", F.round("o_totalprice_cumsum", 2))
