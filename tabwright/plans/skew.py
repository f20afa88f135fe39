"""Which keys hold so many rows that one task should not take them whole."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions.schema import column, columns, same_key
from tabwright.plans import storage

HOT_ROWS = 1_000_000
_COUNT = "__rows"


@dataclass(frozen=True)
class HotKeys:
    """A written table of the keys above the threshold, with their row counts."""

    keys: list[str]
    table: DataFrame
    rows: int
    covers_all: bool
    small: bool

    def hinted(self, table: DataFrame) -> DataFrame:
        """A table with a row for each hot key, marked for a broadcast where its size allows it."""
        return F.broadcast(table) if self.small else table

    def _joined(self, df: DataFrame, how: str) -> DataFrame:
        aliases = {key: f"__hot_{i}" for i, key in enumerate(self.keys)}
        marks = self.hinted(self.table.select([column(k).alias(a) for k, a in aliases.items()]))
        return df.join(marks, same_key(df, marks, list(aliases.items())), how)

    def rows_of(self, df: DataFrame) -> DataFrame:
        return self._joined(df, "left_semi")

    def rest_of(self, df: DataFrame) -> DataFrame:
        return self._joined(df, "left_anti")


def find_hot_keys(df: DataFrame, keys: list[str], hot_rows: int | None = None) -> HotKeys | None:
    """Keys with more than ``hot_rows`` rows, or None.

    Counting combines on the map side, so a hot key costs its final task one row per input task. The
    threshold doesn't grow with the table; the keys are kept in a written table, however many there are.
    """
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    sizes = df.groupBy(*columns(keys)).agg(F.count(F.lit(1)).alias(_COUNT))
    table, path = storage.written_at(sizes.where(F.col(_COUNT) > hot_rows), "hot-keys")
    number, rows = table.agg(F.count(F.lit(1)), F.sum(_COUNT)).first()
    if not number:
        return None
    small = storage.may_broadcast(df.sparkSession, path, number)
    return HotKeys(list(keys), table, rows, rows == df.count(), small)
