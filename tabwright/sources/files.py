"""Reading and writing CSV and Parquet, previews and schema listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.schema import as_list, column, columns, require
from tabwright.operators.profile import AuditRules, STANDARD, column_metrics, missing_audit

MODES = ("overwrite", "append", "ignore", "error")
BAD_CELLS = "row_key bigint, column string, type string, text string"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header; cells that do not fit their type become null.

    Without a schema the types are inferred, which reads the files once more.
    """
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", True).csv(path)


def _row_key(df: DataFrame) -> Column:
    return F.xxhash64(*columns(df.columns))


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """The table as ``read_csv`` gives it, and an account of the cells that did not fit their type.

    The account has a row for each such cell: row_key (a hash of the raw cells of
    its row, the same for all cells of a row), column, type and the raw text. A
    cell fits when it is empty or casts to the type; whether it does is decided
    in the scan, so both tables read the files once.
    """
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").schema(
        T.StructType([T.StructField(f.name, T.StringType()) for f in wanted])).csv(path)
    parsed = {f.name: column(f.name).try_cast(f.dataType) for f in wanted}
    table = raw.select(*[parsed[f.name].alias(f.name) for f in wanted])
    checked = [f for f in wanted if not isinstance(f.dataType, T.StringType)]
    if not checked:
        return table, spark.createDataFrame([], BAD_CELLS)
    cells = F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), column(f.name).alias("text"),
                               parsed[f.name].isNull().alias("bad")) for f in checked])
    bad = F.filter(cells, lambda c: c["text"].isNotNull() & c["bad"])
    account = raw.select(_row_key(raw).alias("row_key"), F.explode(bad).alias("c")).select("row_key", "c.column", "c.type", "c.text")
    return table, account


def bad_cell_counts(account: DataFrame) -> DataFrame:
    """For each column with unreadable cells: (column, type, bad_cells, bad_texts, example)."""
    return account.groupBy("column", "type").agg(
        F.count(F.lit(1)).alias("bad_cells"), F.count_distinct("text").alias("bad_texts"), F.min("text").alias("example"))


def missing_audit_checked(table: DataFrame, account: DataFrame, rules: AuditRules = STANDARD) -> DataFrame:
    """The audit of missing values, and how many of them are unreadable cells (``bad_cells``)."""
    counts = bad_cell_counts(account).select(F.col("column").alias("feature"), "bad_cells")
    audit = missing_audit(table, rules).join(counts, "feature", "left")
    return audit.withColumn("bad_cells", F.coalesce("bad_cells", F.lit(0).cast("bigint")))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _check_mode(mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; use one of {', '.join(MODES)}")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", single_file: bool = False) -> str:
    """CSV with a header, one file per task; ``single_file`` is for small results only."""
    _check_mode(mode)
    out = df.coalesce(1) if single_file else df
    out.write.mode(mode).option("header", True).csv(path)
    return path


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    _check_mode(mode)
    df.write.mode(mode).parquet(path)
    return path


def schema_info(df: DataFrame, observed: bool = False) -> DataFrame:
    """(column, type, nullable) in column order.

    ``observed=True`` scans the table and adds what its rows show: count, null_count,
    min_text and max_text (of numbers too), and whether a column is constant.
    """
    rows = [(f.name, str(f.dataType), f.nullable) for f in df.schema.fields]
    listed = df.sparkSession.createDataFrame(rows, "column string, type string, nullable boolean")
    if not observed:
        return listed
    seen = column_metrics(df).select(
        F.col("feature").alias("column"), "count", "null_count",
        F.coalesce("min_text", F.col("min").cast("string")).alias("min_text"),
        F.coalesce("max_text", F.col("max").cast("string")).alias("max_text"), "is_constant")
    return listed.join(seen, "column")


def preview(df: DataFrame, n: int = 5, order_by: str | Sequence[str] | None = None) -> DataFrame:
    """First ``n`` rows; give the order when the same rows should come every time."""
    keys = as_list(order_by)
    require(df, *keys)
    return (df.orderBy(*columns(keys)) if keys else df).limit(n)


def shape(df: DataFrame) -> DataFrame:
    """(row_count, column_count)."""
    return df.agg(F.count(F.lit(1)).alias("row_count"),
                  F.lit(len(df.columns)).cast("bigint").alias("column_count"))
