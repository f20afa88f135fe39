"""Written intermediates: cut a long lineage, or fix values that must not change between two reads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.functions.schema import same_key

CHECKPOINT_SETTING = "spark.checkpoint.dir"
#: Limits of a broadcast: rows, and bytes as stored (compressed).
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 8 << 20

_own: dict[str, str] = {}
_paths: list[str] = []


def use_folder(path: str) -> None:
    """The folder for sessions that name none; all executors must share it."""
    _own["folder"] = path


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for intermediates."""
    named = spark.conf.get(CHECKPOINT_SETTING, None) or _own.get("folder")
    if not named:
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder all executors share")
    return named.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _paths.append(path)
    return path


def file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def remove_written(spark: SparkSession) -> int:
    """Delete every intermediate written so far by this process; tables that read them end with that."""
    gone = 0
    while _paths:
        files, target = file_system(spark, _paths.pop())
        gone += bool(files.delete(target, True))
    return gone


def may_broadcast(spark: SparkSession, path: str, rows: int) -> bool:
    """Whether a written table is small enough to be sent to every executor."""
    if rows > BROADCAST_ROWS:
        return False
    files, target = file_system(spark, path)
    return files.getContentSummary(target).getLength() <= BROADCAST_BYTES


def written(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write the table to the shared folder and read it back.

    Unlike a cached table it outlives a lost executor, and unlike a checkpoint
    it is computed once and can be read column by column.
    """
    return written_at(df, label)[0]


def written_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``written``, with the path."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def attach(df: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Left-join a per-key table on keys in which null equals null.

    ``small`` has one row per key. It is written first, so its rows can be
    counted from the file footers; only up to the limits above it is
    broadcast. Beyond that it stays a shuffle join, whose hot keys the
    adaptive skew join splits.
    """
    table, path = written_at(small, "per-key")
    if not keys:
        raise ValueError("attach needs keys")
    aliases = {key: f"__key_{i}" for i, key in enumerate(keys)}
    table = table.withColumnsRenamed(aliases)
    if may_broadcast(df.sparkSession, path, table.count()):
        table = F.broadcast(table)
    joined = df.join(table, same_key(df, table, list(aliases.items())), "left")
    return joined.drop(*aliases.values())
