"""Registered queries: each one a call of library operators on the test tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabwright.catalog import (
    charts, columns, encoding, models, profiling, relational, sources, transforms, windows,
)
from tabwright.catalog.registry import Query, Tables

_MODULES = (sources, columns, relational, windows, transforms, profiling, encoding, charts, models)


def all_queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for module in _MODULES:
        found.update(module.QUERIES)
    return found


def runnable() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(query: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: query.build(Tables(spark, sf_dir))

    return {name: bind(query) for name, query in all_queries().items()}


def oracle() -> dict[str, str]:
    return {name: q.sql for name, q in all_queries().items() if q.sql is not None}
