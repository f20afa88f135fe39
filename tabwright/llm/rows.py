"""Running a function over whole texts in Arrow batches, and small column helpers."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.llm.arrays import Texts, slices

_ARROW = {
    "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(),
    "string": pa.string(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()), "array<float>": pa.list_(pa.float32()), "array<double>": pa.list_(pa.float64()),
}


def arrow_schema(columns: dict[str, str]) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in columns.items()])


def ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in columns.items())


def lean(run: Callable) -> Callable:
    """A function for ``mapInArrow`` that hands freed memory back to the system when a task ends.

    Python workers live on, and what the allocators keep would add to the next task of the executor.
    """
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            gc.collect()
            if sys.platform == "linux":
                trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
                if trim:
                    trim(0)

    return wrapped


def map_texts(df: DataFrame, columns: dict[str, str],
              start: Callable[[], Callable[[Texts, pa.RecordBatch], list]]) -> DataFrame:
    """Apply a function to slices of rows that have a column ``text``.

    ``start`` runs once in each task; the function it returns gets the texts of a slice and its rows
    (all columns of ``df``), and gives the output columns in the order of ``columns``.
    """
    schema = arrow_schema(columns)

    def run(batches):
        work = start()
        for batch in batches:
            for texts in slices(batch.column("text")):
                found = work(texts, batch.slice(texts.first, texts.rows))
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x, pa.Array) else pa.array(x, kind.type)
                     for x, kind in zip(found, schema, strict=True)], schema=schema)

    return df.mapInArrow(lean(run), ddl(columns))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def extended(df: DataFrame, added: dict[str, str]) -> T.StructType:
    return T.StructType(df.schema.fields + [T.StructField(n, T.DataType.fromDDL(k)) for n, k in added.items()])


def extend_texts(df: DataFrame, added: dict[str, str],
                 start: Callable[[], Callable[[Texts, pa.RecordBatch], list]]) -> DataFrame:
    """All columns of ``df`` as they are, and the added ones, made as in ``map_texts``."""
    extra = list(arrow_schema(added))

    def run(batches):
        work = start()
        for batch in batches:
            for texts in slices(batch.column("text")):
                rows = batch.slice(texts.first, texts.rows)
                found = [x if isinstance(x, pa.Array) else pa.array(x, kind.type)
                         for x, kind in zip(work(texts, rows), extra, strict=True)]
                yield pa.RecordBatch.from_arrays([*rows.columns, *found], schema=pa.schema([*rows.schema, *extra]))

    return df.mapInArrow(lean(run), extended(df, added))


def text_key() -> Column:
    """64 bits that tell texts of one document id apart; null counts as empty."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def remainder(n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n
