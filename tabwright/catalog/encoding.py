"""Masking, encoding, the cleaned table."""

from pyspark.sql import functions as F

import tabwright as tw
from tabwright.catalog.registry import CUSTOMER_PII, LINEITEM_N, Registry, rounded
from tabwright.plans.storage import new_path

QUERIES = Registry()

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def _flags(column: str, levels: tuple[str, ...]) -> str:
    """One 0/1 column for each level but the first."""
    return ", ".join(f"CASE WHEN {column} = '{v}' THEN 1 ELSE 0 END AS \"{column}_{v}\""
                     for v in sorted(levels)[1:])


@QUERIES.add("c1_pii_name", "SELECT * REPLACE ('[REDACTED]' AS c_name) FROM customer")
def pii_name(t):
    return tw.scrub_pii(t.customer)


@QUERIES.add("c2_pii_density", f"""
    WITH {CUSTOMER_PII}, share AS (
      SELECT avg(CASE WHEN contains(contact, '@') THEN 1.0 ELSE 0.0 END) AS s FROM customer_pii)
    SELECT c_custkey, '[REDACTED]' AS c_name, c_nationkey, c_acctbal, c_mktsegment,
           CASE WHEN s > 0.1 THEN '[REDACTED_EMAIL]' ELSE contact END AS contact
    FROM customer_pii, share""")
def pii_density(t):
    return tw.scrub_pii(t.customer_pii)


@QUERIES.add("c2_pii_cells", f"""
    WITH {CUSTOMER_PII} SELECT c_custkey, '[REDACTED]' AS c_name, c_nationkey, c_acctbal, c_mktsegment,
      regexp_replace(contact,
        '(?i)\\b[a-z0-9][\\w.+%-]*@(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\\.)+[a-z]{{2,24}}\\b',
        '[REDACTED_EMAIL]', 'g') AS contact FROM customer_pii""")
def pii_cells(t):
    return tw.scrub_pii(t.customer_pii, mode="cell")


@QUERIES.add("c2_pii_density_below", """
    WITH share AS (SELECT avg(CASE WHEN contains(text, '@') THEN 1.0 ELSE 0.0 END) AS s
                   FROM documents)
    SELECT * EXCLUDE (s) REPLACE (CASE WHEN s > 0.1 THEN '[REDACTED_EMAIL]' ELSE text END AS text)
    FROM documents, share""")
def pii_density_below(t):
    return tw.scrub_pii(t.documents)


@QUERIES.add("c3_binary", """
    SELECT l.* REPLACE (CASE WHEN l_linestatus = lo THEN 0 WHEN l_linestatus = hi THEN 1 END
                        AS l_linestatus)
    FROM lineitem AS l, (SELECT min(l_linestatus) AS lo, max(l_linestatus) AS hi FROM lineitem)""")
def binary(t):
    return tw.binary_encode(t.lineitem, ["l_linestatus"])


@QUERIES.add("c4_onehot", f"""
    WITH {LINEITEM_N} SELECT * EXCLUDE (l_returnflag), {_flags("l_returnflag", ("A", "N", "R"))}
    FROM lineitem_n""")
def onehot(t):
    return tw.one_hot(t.lineitem_n, ["l_returnflag"])


@QUERIES.add("c5_encoding_log", """
    SELECT 'l_linestatus' AS "column", 'binary' AS action,
           'Binary Encoded ''l_linestatus'': ''' || min(l_linestatus) || '''->0, '''
           || max(l_linestatus) || '''->1' AS detail FROM lineitem
    UNION ALL SELECT NULL, 'one_hot', 'One-Hot Encoded: l_returnflag'""")
def encoding_log(t):
    return tw.encoding_log(t.lineitem)


@QUERIES.add("c5_encoding_log_pii", f"""
    WITH {CUSTOMER_PII} SELECT * FROM (VALUES
      ('c_name', 'mask_name', 'Masked entire column ''c_name'' due to PII keyword match.'),
      ('contact', 'mask_email', 'Masked column ''contact'' due to high email density.'),
      (NULL, 'one_hot', 'One-Hot Encoded: c_name, c_mktsegment, contact'))
      AS l("column", action, detail)
    WHERE "column" IS DISTINCT FROM 'contact'
       OR (SELECT avg(CASE WHEN contains(contact, '@') THEN 1.0 ELSE 0.0 END) FROM customer_pii) > 0.1
    """)
def encoding_log_pii(t):
    return tw.encoding_log(t.customer_pii)


@QUERIES.add("c6_encoded_preview", f"""
    SELECT c_custkey, c_nationkey, c_acctbal, {_flags("c_mktsegment", SEGMENTS)}
    FROM customer ORDER BY c_custkey LIMIT 5""")
def encoded_preview(t):
    return tw.encoded_preview(t.customer, "c_custkey")


@QUERIES.add("c7_autoclean", f"""
    WITH {LINEITEM_N}, fit AS (
      SELECT quantile_cont(l_quantity, 0.5) AS quantity, quantile_cont(l_tax, 0.5) AS tax,
             min(l_linestatus) AS lo, max(l_linestatus) AS hi FROM lineitem_n),
    top AS (SELECT l_returnflag AS flag FROM lineitem_n WHERE l_returnflag IS NOT NULL
            GROUP BY l_returnflag ORDER BY count(*) DESC, l_returnflag LIMIT 1),
    filled AS (
      SELECT n.* REPLACE (coalesce(l_quantity, quantity) AS l_quantity,
                          coalesce(l_tax, tax) AS l_tax,
                          coalesce(l_returnflag, flag) AS l_returnflag,
                          CASE WHEN l_linestatus = lo THEN 0 WHEN l_linestatus = hi THEN 1 END
                          AS l_linestatus)
      FROM lineitem_n AS n, fit, top)
    SELECT * EXCLUDE (l_returnflag), {_flags("l_returnflag", ("A", "N", "R"))} FROM filled""")
def autoclean(t):
    return tw.auto_clean(t.lineitem_n)


@QUERIES.add("c7_autoclean_skewed", f"""
    WITH codes AS (SELECT props, row_number() OVER (ORDER BY props) - 1 AS code FROM (SELECT DISTINCT props FROM events))
    SELECT event_id, ts, user_id,
           round(ln(1 + value + (SELECT CASE WHEN min(value) <= 0 THEN 1 - min(value) ELSE 0 END FROM events)), 6) AS value,
           code AS props, {_flags("event_type", EVENT_TYPES)} FROM events LEFT JOIN codes USING (props)""")
def autoclean_skewed(t):
    """A skewed column, and one with too many levels for a column each."""
    return rounded(tw.auto_clean(t.events, max_levels=20), value=6)


@QUERIES.add("c7_clean_saved", f"""
    WITH {LINEITEM_N}, first AS (SELECT * FROM lineitem_n WHERE l_orderkey % 2 = 0),
    fit AS (SELECT quantile_cont(l_quantity, 0.5) AS quantity, min(l_linestatus) AS lo, max(l_linestatus) AS hi FROM first),
    top AS (SELECT l_returnflag AS flag FROM first WHERE l_returnflag IS NOT NULL
            GROUP BY l_returnflag ORDER BY count(*) DESC, l_returnflag LIMIT 1),
    filled AS (
      SELECT n.* REPLACE (coalesce(l_quantity, quantity) AS l_quantity, coalesce(l_returnflag, flag) AS l_returnflag,
                          CASE WHEN l_linestatus = lo THEN 0 WHEN l_linestatus = hi THEN 1 END AS l_linestatus)
      FROM lineitem_n AS n, fit, top WHERE l_orderkey % 2 = 1)
    SELECT * EXCLUDE (l_returnflag), {_flags("l_returnflag", ("A", "N", "R"))} FROM filled""")
def clean_saved(t):
    """Fitted on one half of the table, where l_tax is whole, saved, loaded, applied to the other half, where it's null."""
    half = F.col("l_orderkey") % 2
    path = tw.save_fit(t.spark, tw.fit_clean(t.lineitem_n.where(half == 0)), new_path(t.spark, "fit"))
    return tw.apply_fit(t.lineitem_n.where(half == 1), tw.load_fit(t.spark, path))
