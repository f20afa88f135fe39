"""Tables laid out by key, so that later joins and windows on the key need no shuffle.

The rows of a key share a bucket, a bucket is one file, and its rows are sorted. Spark's catalogue knows the
layout, so scans of two such tables with equal keys and numbers of buckets join bucket by bucket, and windows and
groups by the key start at once. The cost is one shuffle when the table is written; a bucket should have some 256 MB.
A key with more rows than a bucket should hold is not split: use the plain table and its skew plans for such keys.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tabwright.functions.schema import as_list, columns, require
from tabwright.plans.storage import file_system

BUCKET_BYTES = 256 << 20


def buckets_for(spark: SparkSession, path: str, bucket_bytes: int = BUCKET_BYTES) -> int:
    """How many buckets the files of a folder fill, a power of two, so that layouts of different sizes can be joined."""
    files, target = file_system(spark, path)
    size = files.getContentSummary(target).getLength()
    return 1 << max(0, math.ceil(math.log2(max(1, size / bucket_bytes))))


def write_layout(df: DataFrame, table: str, path: str, keys: str | Sequence[str], buckets: int,
                 sort_by: str | Sequence[str] | None = None) -> DataFrame:
    """Store as the catalogue table ``table`` in ``path``: by keys into buckets, sorted by keys and ``sort_by``.

    A table of that name is replaced.
    """
    names, order = as_list(keys), as_list(sort_by)
    if not names or buckets < 1:
        raise ValueError("a layout needs keys and at least one bucket")
    require(df, *names, *order)
    sorting = list(dict.fromkeys([*names, *order]))
    (df.repartition(buckets, *columns(names)).write.mode("overwrite").format("parquet")
     .bucketBy(buckets, *names).sortBy(*sorting).option("path", path).saveAsTable(table))
    return df.sparkSession.table(table)


def read_layout(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)
