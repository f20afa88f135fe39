"""Versioned tables with their profile.

Each writer fills folders of its own, then claims the next free number by
creating a file that must not exist yet, and only then adds its row to the
``versions`` table. So writers at the same time get different versions, and
nothing is overwritten: a table derived from a version can be stored next to it.

A version may also be the one before plus new rows. Then only these are written
and scanned: their mergeable state and that of the version before give the
profile of the whole.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tabwright.operators.encode import scrub_pii
from tabwright.operators.profile import AuditRules, STANDARD, profile
from tabwright.operators.states import STATE_SCHEMA, audit_of, merge_states, profile_state, stats_of
from tabwright.operators.transforms import transform
from tabwright.plans.storage import file_system as _file_system
from tabwright.plans.storage import written

_VERSION_SCHEMA = ("version bigint, context string, row_count bigint, column_count bigint, "
                   "numeric array<string>, categorical array<string>, folder string, parts array<string>")
#: Seconds that an append waits for writers with a lower number before it takes them for dead.
PATIENCE = 60.0


@dataclass(frozen=True)
class Snapshot:
    version: int
    data: DataFrame
    stats: DataFrame
    audit: DataFrame
    meta: dict


def _versions(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(_VERSION_SCHEMA).parquet(f"{path}/versions").drop("claim")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def latest_version(spark: SparkSession, path: str) -> int | None:
    table = _versions(spark, path)
    return None if table is None else table.agg(F.max("version")).first()[0]


def _claimed(spark: SparkSession, path: str) -> bool:
    """Create an empty file unless it is there; False if it was."""
    files, target = _file_system(spark, path)
    try:
        if files.getUri().getScheme() == "file":
            place = spark._jvm.java.nio.file.Paths.get(files.makeQualified(target).toUri())
            spark._jvm.java.nio.file.Files.createFile(place, spark.sparkContext._gateway.new_array(
                spark._jvm.java.nio.file.attribute.FileAttribute, 0))
        else:
            files.create(target, False).close()
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def save_snapshot(df: DataFrame, path: str, context: str = "", mask_pii: bool = False,
                  rules: AuditRules = STANDARD) -> int:
    """Store the table and its profile as the next version; returns its number."""
    spark = df.sparkSession
    folder = uuid.uuid4().hex
    table = scrub_pii(df) if mask_pii else df
    table.write.parquet(f"{path}/data/{folder}")
    stored = spark.read.schema(table.schema).parquet(f"{path}/data/{folder}")
    found = profile(stored, rules)
    found.stats.write.parquet(f"{path}/stats/{folder}")
    found.audit.write.parquet(f"{path}/audit/{folder}")
    files, claims = _file_system(spark, f"{path}/claims")
    files.mkdirs(claims)
    version = (latest_version(spark, path) or 0) + 1
    while not _claimed(spark, f"{path}/claims/{version}"):
        version += 1
    row = [(version, context, found.rows, found.columns, found.numeric, found.categorical, folder, [folder])]
    # a folder for each version: writers of one folder would clear each other's unfinished files
    spark.createDataFrame(row, _VERSION_SCHEMA).coalesce(1).write.parquet(f"{path}/versions/claim={version}")
    return version


def _row(spark: SparkSession, path: str, version: int | None = None) -> Row:
    table = _versions(spark, path)
    if table is None:
        raise ValueError(f"no snapshot at {path}")
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    row = table.where(F.col("version") == version).first()
    if row is None:
        raise ValueError(f"no version {version} at {path}")
    return row


def _parts(row: Row) -> list[str]:
    return row["parts"] or [row["folder"]]


def _state(spark: SparkSession, path: str, row: Row) -> DataFrame:
    """The state of a version, made from its data if it was stored without one."""
    place = f"{path}/states/{row['folder']}"
    files, target = _file_system(spark, place)
    if files.exists(target):
        return spark.read.schema(STATE_SCHEMA).parquet(place)
    data = spark.read.parquet(*[f"{path}/data/{part}" for part in _parts(row)])
    return written(profile_state(data), "state")


def _claimed_before(spark: SparkSession, path: str, base: int, version: int) -> set[int]:
    """Numbers between a version and one's own that others have claimed."""
    files, claims = _file_system(spark, f"{path}/claims")
    names = {status.getPath().getName() for status in files.listStatus(claims)}
    return {v for v in range(base + 1, version) if str(v) in names}


def append_snapshot(df: DataFrame, path: str, rules: AuditRules = STANDARD, patience: float | None = None) -> int:
    """Store the rows as an addition to the latest version; returns the number of the new one.

    The new version has the rows of the one before and the given ones. The rows
    of the one before are not read again. Of writers at the same time each
    builds on the one with the next lower number.
    """
    spark = df.sparkSession
    latest = _row(spark, path)
    known = spark.read.parquet(*[f"{path}/data/{part}" for part in _parts(latest)]).schema
    if [(f.name, f.dataType) for f in known] != [(f.name, f.dataType) for f in df.schema]:
        raise ValueError("the rows have other columns than the stored version")
    folder = uuid.uuid4().hex
    df.write.parquet(f"{path}/data/{folder}")
    added = written(profile_state(spark.read.schema(df.schema).parquet(f"{path}/data/{folder}")), "state")
    version = latest["version"] + 1
    while not _claimed(spark, f"{path}/claims/{version}"):
        version += 1
    end = time.monotonic() + (PATIENCE if patience is None else patience)
    while True:
        seen = {r["version"] for r in _versions(spark, path).select("version").collect()}
        base = max(v for v in seen if v < version)
        if not _claimed_before(spark, path, base, version) or time.monotonic() > end:
            break
        time.sleep(0.2)
    before = _row(spark, path, base)
    merged = merge_states([_state(spark, path, before), added])
    merged.coalesce(1).write.parquet(f"{path}/states/{folder}")
    whole = spark.read.schema(STATE_SCHEMA).parquet(f"{path}/states/{folder}")
    stats_of(whole).write.parquet(f"{path}/stats/{folder}")
    audit_of(whole, rules).write.parquet(f"{path}/audit/{folder}")
    rows = whole.agg(F.max("rows")).first()[0]
    row = [(version, before["context"], rows, before["column_count"], before["numeric"], before["categorical"], folder,
            [*_parts(before), folder])]
    spark.createDataFrame(row, _VERSION_SCHEMA).coalesce(1).write.parquet(f"{path}/versions/claim={version}")
    return version


def load_snapshot(spark: SparkSession, path: str, version: int | None = None) -> Snapshot:
    """A stored version, the latest by default."""
    row = _row(spark, path, version)
    data = spark.read.parquet(*[f"{path}/data/{part}" for part in _parts(row)])
    stats, audit = (spark.read.parquet(f"{path}/{part}/{row['folder']}") for part in ("stats", "audit"))
    return Snapshot(row["version"], data, stats, audit, row.asDict())


def transform_snapshot(spark: SparkSession, path: str, name: str, kind: str,
                       **options) -> Snapshot:
    """Transform one column of the latest version, store the result as a new one, profile it."""
    current = load_snapshot(spark, path)
    changed = transform(current.data, name, kind, **options)
    return load_snapshot(spark, path, save_snapshot(changed, path, current.meta["context"]))
