"""Projections, filters, column edits, text functions."""

import tabwright as tw
from tabwright.catalog.registry import LINEITEM_N, Registry, rounded

QUERIES = Registry()

CUSTOMER = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


def _customer_with(**changed: str) -> str:
    """SELECT over customer with some columns replaced or added."""
    parts = [f"{changed.get(n, n)} AS {n}" for n in CUSTOMER]
    parts += [f"{sql} AS {n}" for n, sql in changed.items() if n not in CUSTOMER]
    return f"SELECT {', '.join(parts)} FROM customer"


@QUERIES.add("p1_select", "SELECT l_orderkey, l_quantity FROM lineitem")
def select(t):
    return tw.select_columns(t.lineitem, ["l_orderkey", "l_quantity"])


@QUERIES.add("p2_drop", "SELECT * EXCLUDE (c_acctbal) FROM customer")
def drop(t):
    return tw.drop_column(t.customer, "c_acctbal")


@QUERIES.add("p3_rename", "SELECT * RENAME (c_acctbal AS balance) FROM customer")
def rename(t):
    return tw.rename_column(t.customer, "c_acctbal", "balance")


@QUERIES.add("p4_cast_int", _customer_with(c_custkey="TRY_CAST(c_custkey AS INTEGER)"))
def cast_int(t):
    return tw.cast_column(t.customer, "c_custkey", "int")


@QUERIES.add("p4_cast_text_to_double", _customer_with(c_name="TRY_CAST(c_name AS DOUBLE)"))
def cast_text(t):
    return tw.cast_column(t.customer, "c_name", "double")


@QUERIES.add("p4_cast_string", _customer_with(c_nationkey="CAST(c_nationkey AS VARCHAR)"))
def cast_string(t):
    return tw.cast_column(t.customer, "c_nationkey", "string")


@QUERIES.add("p4_cast_boolean", _customer_with(c_nationkey="CAST(c_nationkey AS BOOLEAN)"))
def cast_boolean(t):
    return tw.cast_column(t.customer, "c_nationkey", "boolean")


@QUERIES.add("p4_cast_float", _customer_with(c_nationkey="CAST(c_nationkey AS FLOAT)"))
def cast_float(t):
    return tw.cast_column(t.customer, "c_nationkey", "float")


@QUERIES.add("p5_conditional", _customer_with(
    level="CASE WHEN c_acctbal > 5000 THEN 'High' ELSE 'Low' END"))
def conditional(t):
    return tw.conditional_column(t.customer, "level", "c_acctbal", 5000)


@QUERIES.add("p6_replace", _customer_with(
    c_mktsegment="CASE WHEN c_mktsegment = 'BUILDING' THEN 'Other' ELSE c_mktsegment END"))
def replace(t):
    return tw.replace_values(t.customer, "c_mktsegment", "BUILDING", "Other")


@QUERIES.add("p6_replace_with_null", _customer_with(
    c_mktsegment="NULLIF(c_mktsegment, 'BUILDING')"))
def replace_with_null(t):
    return tw.replace_values(t.customer, "c_mktsegment", "BUILDING", None)


# Spark's log1p is null up to -1, where ln raises in SQL
_EDITS = {
    "log": "CASE WHEN c_acctbal > -1 THEN ln(1 + c_acctbal) END",
    "sqrt": "sqrt(abs(c_acctbal))",
    "square": "c_acctbal * c_acctbal",
    "abs": "abs(c_acctbal)",
    "reciprocal": "1.0 / NULLIF(c_acctbal, 0)",
}


def _edit(name: str):
    @QUERIES.add(f"p7_modify_{name}", _customer_with(changed=f"round({_EDITS[name]}, 6)"))
    def modify(t):
        return rounded(tw.add_or_modify_column(t.customer, "c_acctbal", name, "changed"), changed=6)


for _name in _EDITS:
    _edit(_name)

_COMPARISONS = {"gt": ">", "lt": "<", "ge": ">=", "le": "<=", "eq": "==", "ne": "!="}


def _filter(name: str, sign: str):
    sql_sign = {"==": "=", "!=": "<>"}.get(sign, sign)

    @QUERIES.add(f"f1_filter_{name}", f"SELECT * FROM lineitem WHERE l_quantity {sql_sign} 25")
    def keep(t):
        return tw.filter_rows(t.lineitem, "l_quantity", sign, 25)


for _name, _sign in _COMPARISONS.items():
    _filter(_name, _sign)


@QUERIES.add("f2_filter_text_number", "SELECT * FROM customer WHERE c_acctbal > 1000.5")
def filter_text_number(t):
    return tw.filter_rows(t.customer, "c_acctbal", ">", "1000.5")


@QUERIES.add("f2_filter_text_string", "SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING'")
def filter_text_string(t):
    return tw.filter_rows(t.customer, "c_mktsegment", "!=", "BUILDING")


@QUERIES.add("f3_drop_nulls", f"""
    WITH {LINEITEM_N} SELECT * FROM lineitem_n
    WHERE l_quantity IS NOT NULL AND l_returnflag IS NOT NULL AND l_tax IS NOT NULL""")
def drop_nulls(t):
    return tw.drop_nulls(t.lineitem_n)


@QUERIES.add("f3_drop_nulls_subset", f"""
    WITH {LINEITEM_N} SELECT * FROM lineitem_n WHERE l_quantity IS NOT NULL""")
def drop_nulls_subset(t):
    return tw.drop_nulls(t.lineitem_n, ["l_quantity"])


# full case mapping turns the German sharp s into SS; DuckDB's upper leaves it as it is
@QUERIES.add("x1_upper", """
    SELECT * REPLACE (upper(replace(text, 'ß', 'ss')) AS text) FROM documents""")
def upper(t):
    return tw.text_column(t.documents, "text", "upper")


@QUERIES.add("x2_lower", "SELECT * REPLACE (lower(text) AS text) FROM documents")
def lower(t):
    return tw.text_column(t.documents, "text", "lower")


@QUERIES.add("x3_length", """
    SELECT *, CAST(length(text) AS INTEGER) AS text_length FROM documents""")
def length(t):
    return tw.text_column(t.documents, "text", "length")


@QUERIES.add("x4_reverse", "SELECT * REPLACE (reverse(c_name) AS c_name) FROM customer")
def reverse(t):
    return tw.text_column(t.customer, "c_name", "reverse")


@QUERIES.add("x5_contains_at", "SELECT *, contains(text, '@') AS text_has_at FROM documents")
def contains_at(t):
    return tw.contains_at(t.documents, "text")
