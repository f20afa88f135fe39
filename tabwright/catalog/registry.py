"""What a registered query is, and the tables it may read."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Tables:
    """The Parquet tables of one folder, by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def lineitem_n(self) -> DataFrame:
        """lineitem with nulls in three columns and a constant one; every row stays."""
        return self.lineitem.withColumns({
            "l_quantity": F.when(F.col("l_orderkey") % 11 != 0, F.col("l_quantity")),
            "l_returnflag": F.when(F.col("l_orderkey") % 7 != 0, F.col("l_returnflag")),
            "l_tax": F.when(F.col("l_orderkey") % 2 != 1, F.col("l_tax")),
            "const_col": F.lit(1),
        })

    @property
    def customer_pii(self) -> DataFrame:
        """customer with a text column of which every fifth row is an e-mail address."""
        return self.customer.withColumn(
            "contact", F.when(F.col("c_custkey") % 5 == 0,
                              F.concat("c_name", F.lit("@example.com"))).otherwise(F.col("c_name")))


LINEITEM_N = """lineitem_n AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
         CASE WHEN l_orderkey % 11 <> 0 THEN l_quantity END AS l_quantity,
         l_extendedprice, l_discount,
         CASE WHEN l_orderkey % 2 <> 1 THEN l_tax END AS l_tax,
         CASE WHEN l_orderkey % 7 <> 0 THEN l_returnflag END AS l_returnflag,
         l_linestatus, l_shipdate, 1 AS const_col
  FROM lineitem)"""

CUSTOMER_PII = """customer_pii AS (
  SELECT *, CASE WHEN c_custkey % 5 = 0 THEN c_name || '@example.com' ELSE c_name END AS contact
  FROM customer)"""


@dataclass(frozen=True)
class Query:
    build: Callable[[Tables], DataFrame]
    sql: str | None = None


class Registry(dict):
    """Collects queries: ``@queries.add("name", sql)`` above a function of the tables."""

    def add(self, name: str, sql: str | None = None):
        def register(build: Callable[[Tables], DataFrame]):
            if name in self:
                raise ValueError(f"query {name} is registered twice")
            self[name] = Query(build, sql)
            return build
        return register


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Round floating results, whose last bits depend on the order of addition."""
    return df.withColumns({n: F.round(F.col(n), d) for n, d in digits.items()})
