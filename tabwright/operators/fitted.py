"""Fits that outlive their session: saved as tables, loaded elsewhere, applied to other tables.

A saved fit is a folder with the table ``entries`` (step, part, field, key, position, type, value), one row for
each fitted number, text or level, and a table for each list of label codes, which may be long.
"""

from __future__ import annotations

import datetime
import decimal
from collections import defaultdict
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tabwright.operators.encode import Cleaning, Encoding, PiiFindings
from tabwright.operators.transforms import Fitted

Step = Fitted | Encoding | Cleaning
ENTRIES = "step int, part string, field string, key string, position int, type string, value string"

_WRITERS = {
    type(None): ("null", lambda v: ""), bool: ("boolean", lambda v: "true" if v else "false"), int: ("integer", str),
    float: ("float", repr), str: ("text", str), decimal.Decimal: ("decimal", str),
    datetime.datetime: ("timestamp", datetime.datetime.isoformat), datetime.date: ("date", datetime.date.isoformat),
}
_READERS = {
    "null": lambda v: None, "boolean": lambda v: v == "true", "integer": int, "float": float, "text": str,
    "decimal": decimal.Decimal, "timestamp": datetime.datetime.fromisoformat, "date": datetime.date.fromisoformat,
}


def _entry(step: int, part: str, field: str, key: str | None, position: int, value: Any) -> tuple:
    if type(value) not in _WRITERS:
        raise ValueError(f"cannot store a value of type {type(value).__name__}")
    kind, text = _WRITERS[type(value)]
    return step, part, field, key, position, kind, text(value)


def _entries(step: int, fit: Step) -> tuple[list[tuple], dict[str, DataFrame]]:
    """The rows of a step and its label codes by column."""
    rows: list[tuple] = []

    def put(part: str, field: str, key: str | None, values: Sequence[Any]) -> None:
        rows.extend(_entry(step, part, field, key, i, v) for i, v in enumerate(values))

    if isinstance(fit, Fitted):
        put("transform", "kind", None, [fit.kind])
        put("transform", "name", None, [fit.name])
        for field in ("params", "options"):
            for key, value in getattr(fit, field).items():
                put("transform", field, key, [value])
        return rows, {} if fit.lookup is None else {fit.name: fit.lookup}
    encoding = fit
    if isinstance(fit, Cleaning):
        put("cleaning", "present", None, [True])
        put("cleaning", "keep", None, fit.keep)
        put("cleaning", "masked_names", None, fit.masks.by_name)
        put("cleaning", "masked_texts", None, fit.masks.by_density)
        for field in ("medians", "tops", "shifts"):
            for key, value in getattr(fit, field).items():
                put("cleaning", field, key, [value])
        encoding = fit.encoding
    put("encoding", "present", None, [True])
    for field in ("binary", "one_hot"):
        for key, levels in getattr(encoding, field).items():
            put("encoding", field, key, [None, *levels])  # a column without levels needs a row too
    return rows, dict(encoding.coded)


def save_fit(spark: SparkSession, fit: Step | Sequence[Step], path: str) -> str:
    """Store a fit, or several in the order in which they are applied. The folder must be new."""
    rows: list[tuple] = []
    for step, one in enumerate([fit] if isinstance(fit, Step) else fit):
        entries, codes = _entries(step, one)
        for i, (name, lookup) in enumerate(codes.items()):
            entries.append(_entry(step, "codes", "folder", name, i, f"codes-{step}-{i}"))
            lookup.write.parquet(f"{path}/codes-{step}-{i}")
        rows += entries
    spark.createDataFrame(rows, ENTRIES).coalesce(1).write.parquet(f"{path}/entries")  # last: it makes the fit complete
    return path


def load_fit(spark: SparkSession, path: str) -> list[Step]:
    """The steps of a saved fit."""
    steps: dict[int, dict] = defaultdict(lambda: defaultdict(lambda: defaultdict(list)))
    for r in spark.read.schema(ENTRIES).parquet(f"{path}/entries").orderBy("step", "part", "field", "position").collect():
        steps[r["step"]][r["part"], r["field"]][r["key"]].append(_READERS[r["type"]](r["value"]))
    fits: list[Step] = []
    for _, parts in sorted(steps.items()):
        codes = {n: spark.read.parquet(f"{path}/{folder[0]}") for n, folder in parts["codes", "folder"].items()}
        if ("transform", "kind") in parts:
            name = parts["transform", "name"][None][0]
            params, options = ({k: v[0] for k, v in parts["transform", f].items()} for f in ("params", "options"))
            fits.append(Fitted(parts["transform", "kind"][None][0], name, params, options, codes.get(name)))
            continue
        encoding = Encoding({n: tuple(v[1:]) for n, v in parts["encoding", "binary"].items()},
                            {n: v[1:] for n, v in parts["encoding", "one_hot"].items()}, codes)
        if ("cleaning", "present") not in parts:
            fits.append(encoding)
            continue
        of = {f: {k: v[0] for k, v in parts["cleaning", f].items()} for f in ("medians", "tops", "shifts")}
        lists = {f: list(parts["cleaning", f][None]) for f in ("keep", "masked_names", "masked_texts")}
        fits.append(Cleaning(of["medians"], of["tops"], of["shifts"], encoding, tuple(lists["keep"]),
                             PiiFindings(lists["masked_names"], lists["masked_texts"])))
    return fits


def apply_fit(df: DataFrame, fit: Step | Sequence[Step]) -> DataFrame:
    """Apply the steps, one after the other, to any table with their columns."""
    for step in [fit] if isinstance(fit, Step) else fit:
        df = step.apply(df)
    return df
