"""The demo sales table, generated in parallel from row numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the demo table.
CATEGORIES = ("Tech", "Fashion", "Home", "Software")
REGIONS = ("North America", "EMEA", "APAC", "LATAM")
ANSWERS = ("Yes", "No")
FIRST_ORDER = 1001
SALES_SCALE = 500.0
SPEND_MEAN, SPEND_DEVIATION, SPEND_WEIGHT = 100.0, 30.0, 2.5
OUTLIER_ROWS, OUTLIER_VALUE = (0, 10), 99000.0
MISSING_ROWS = (50, 150)


def generate_sales(spark: SparkSession, rows: int = 1000, seed: int = 42) -> DataFrame:
    """Random sales with 11 planted outliers and 101 missing ages; the same rows for a seed."""

    def uniform(stream: int) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(F.col("id"), F.lit(seed), F.lit(stream)), 11)
        return (bits.cast("double") + 0.5) / float(2 ** 53)

    def one_of(stream: int, values: tuple[str, ...]) -> Column:
        place = F.floor(uniform(stream) * len(values)).cast("int")
        return F.get(F.array(*[F.lit(v) for v in values]), place)

    def whole(stream: int, low: int, high: int) -> Column:
        return (F.floor(uniform(stream) * (high - low + 1)) + low).cast("bigint")

    normal = F.sqrt(-2.0 * F.log(uniform(5))) * F.cos(2.0 * math.pi * uniform(6))
    spend = F.round(SPEND_MEAN + SPEND_DEVIATION * normal, 2)
    sales = F.round(-SALES_SCALE * F.log(uniform(2)), 2) + spend * SPEND_WEIGHT
    return spark.range(rows).select(
        (F.col("id") + FIRST_ORDER).alias("Order_ID"),
        one_of(1, CATEGORIES).alias("Product_Category"),
        F.when(F.col("id").between(*OUTLIER_ROWS), OUTLIER_VALUE).otherwise(sales)
        .alias("Sales_Amount"),
        F.when(~F.col("id").between(*MISSING_ROWS), whole(3, 18, 79).cast("double"))
        .alias("Customer_Age"),
        spend.alias("Marketing_Spend"),
        one_of(7, ANSWERS).alias("Smoker"),
        one_of(8, REGIONS).alias("Region"),
        whole(9, 1, 5).alias("Satisfaction_Score"),
    )
