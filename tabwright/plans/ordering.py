"""Positions and running totals along an order, without one task per key.

A window over a key that holds a third of the table would run in a single
task. Here the rows are range-partitioned by key *and* order, so one key spans
many tasks; each task numbers its own rows, and a small table of per-range
totals supplies what came before.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.functions.schema import column, columns, same_key
from tabwright.plans.storage import may_broadcast, written, written_at

ROWS_PER_RANGE = 1_000_000
BROADCAST_ROWS = 100_000

POSITION = "__position"
RUNNING = "__running"
_ID = "__id"
_RANGE = "__range"
_FIRST = "__first"
_LAST = "__last"
_ROWS = "__rows"
_SUM = "__sum"
_SALT = "__salt"


def number_rows(df: DataFrame, keys: list[str], order: list[Column], rows: int,
                weight: Column | None = None, rows_per_range: int | None = None) -> DataFrame:
    """Add ``POSITION`` (1-based, within key) and, given a weight, its ``RUNNING`` total; see ``Placed``."""
    placed = place(df, keys, order, rows, rows_per_range)
    extra = [POSITION] + ([RUNNING] if weight is not None else [])
    return placed.numbered(weight).select(*columns(df.columns), *extra)


def place(df: DataFrame, keys: list[str], order: list[Column], rows: int, rows_per_range: int | None = None) -> Placed:
    """Write ``df``, of ``rows`` rows, range-partitioned and sorted by keys and order.

    It is written once, so that range numbers stay what they were when read
    again. Rows equal in keys and order are spread by a random number, so that
    many of them don't share a range.
    """
    per_range = ROWS_PER_RANGE if rows_per_range is None else rows_per_range
    ranges = max(2, math.ceil(rows / per_range))
    sort_keys = columns(keys) + order + [F.col(_SALT)]
    # monotonically_increasing_id is (partition number << 33) + row number in the partition
    sorted_rows = (
        df.withColumn(_SALT, F.rand(11))
        .repartitionByRange(ranges, *sort_keys)
        .sortWithinPartitions(*sort_keys)
        .drop(_SALT)
        .withColumn(_ID, F.monotonically_increasing_id())
    )
    table = written(sorted_rows, "ranges").withColumn(_RANGE, F.shiftright(_ID, 33))
    return Placed(keys, ranges, table, table)


@dataclass(frozen=True)
class Placed:
    """A table written in ranges of its keys and order: ``rows`` is ``table`` with the columns added since.

    The rows of a key in a range are a chunk. Tables of chunks have at most
    ``number of keys + number of ranges`` rows and are broadcast while that is
    at most ``BROADCAST_ROWS``; callers pass only hot keys or no key at all.
    All windows have the same chunks and order, so any number of functions
    take one exchange and one sort of the rows.
    """

    keys: list[str]
    ranges: int
    table: DataFrame
    rows: DataFrame
    order: tuple[str, ...] = ()
    changed: frozenset[str] = frozenset()

    def _window(self, *last: str):
        return Window.partitionBy(*columns(self.keys), F.col(_RANGE)).orderBy(*columns([*self.order, *last]))

    def _of(self, *names: str) -> DataFrame:
        """The written table where it has the columns, unchanged: then nothing added is computed again."""
        return self.table if set(names) <= set(self.table.columns) - self.changed else self.rows

    def with_rows(self, rows: DataFrame, output: str) -> Placed:
        return replace(self, rows=rows, changed=self.changed | {output})

    def _chunks(self, source: DataFrame, *measures: Column) -> DataFrame:
        return source.groupBy(*columns(self.keys), _RANGE).agg(
            F.min(_ID).alias(_FIRST), F.max(_ID).alias(_LAST), F.count(F.lit(1)).alias(_ROWS), *measures)

    def _attach(self, rows: DataFrame, chunks: DataFrame, *wanted: Column) -> DataFrame:
        aliases = {key: f"__key_{i}" for i, key in enumerate(self.keys)}
        small = chunks.select(*[column(key).alias(alias) for key, alias in aliases.items()],
                              F.col(_RANGE).alias("__in_range"), *wanted)
        if 2 * self.ranges <= BROADCAST_ROWS:  # a hot key fills most of a range at least
            small = F.broadcast(small)
        joined = rows.join(small, same_key(rows, small, list(aliases.items())) & (rows[_RANGE] == small["__in_range"]), "left")
        return joined.drop("__in_range", *aliases.values())

    def _before(self, name: str) -> Column:
        over = Window.partitionBy(*columns(self.keys)).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
        return F.sum(name).over(over)

    def _positions(self, source: DataFrame, rows: DataFrame, *measures: Column) -> DataFrame:
        """``rows`` with ``POSITION``, the bounds of its chunk and, of one measure, the sum over the chunks before."""
        wanted = [self._before(_SUM).alias("__sum_before")] if measures else []
        joined = self._attach(rows, self._chunks(source, *measures), F.col(_FIRST), F.col(_LAST),
                              F.coalesce(self._before(_ROWS), F.lit(0)).alias("__rows_before"), *wanted)
        return joined.withColumn(POSITION, F.col(_ID) - F.col(_FIRST) + F.col("__rows_before") + 1)

    def numbered(self, weight: Column | None = None, name: str | None = None) -> DataFrame:
        """Add ``POSITION`` and, given a weight (of the column ``name``), its ``RUNNING`` total."""
        if weight is None:
            return self._positions(self.table, self.rows).drop(_FIRST, _LAST, "__rows_before")
        source = self.table if name is None else self._of(name)
        joined = self._positions(source, self.rows, F.sum(weight).alias(_SUM))
        local = F.sum(weight).over(self._window(_ID).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        earlier = F.col("__sum_before")
        result = joined.withColumn("__local", local).withColumn(
            RUNNING,
            F.when(earlier.isNull(), F.col("__local"))
            .otherwise(earlier + F.coalesce(F.col("__local"), F.lit(0))),
        )
        return result.drop(_FIRST, _LAST, "__rows_before", "__sum_before", "__local")

    def shifted(self, name: str, step: int, output: str) -> DataFrame:
        """Add the value of a column ``step`` rows before (after, if negative).

        Within a chunk a window has it; the ends of chunks that are needed beyond it are a table of
        ``step`` rows a chunk, joined by position.
        """
        joined = self._positions(self.table, self.rows)
        inside = (F.col(_ID) - step).between(F.col(_FIRST), F.col(_LAST))
        local = (F.lag if step >= 0 else F.lead)(column(name), abs(step)).over(self._window(_ID))
        source = self._of(name)
        aliases = {key: f"__of_{i}" for i, key in enumerate(self.keys)}
        near = F.col(_LAST) - F.col(_ID) < step if step >= 0 else F.col(_ID) - F.col(_FIRST) < -step
        ends, path = written_at(self._positions(self.table, source).where(near).select(
            *[column(k).alias(a) for k, a in aliases.items()],
            (F.col(POSITION) + step).alias("__for"), column(name).alias("__beyond")), "ends")
        if may_broadcast(ends.sparkSession, path, ends.count()):
            ends = F.broadcast(ends)
        joined = joined.withColumn("__local", local).withColumn("__inside", inside)
        both = joined.join(ends, same_key(joined, ends, list(aliases.items())) & (joined[POSITION] == ends["__for"]), "left")
        value = F.when(F.col("__inside"), F.col("__local")).otherwise(F.col("__beyond"))
        return both.withColumn(output, value).drop(
            POSITION, _FIRST, _LAST, "__rows_before", "__local", "__inside", "__for", "__beyond", *aliases.values())

    def ranked_down(self, kind: str, output: str) -> DataFrame:
        """Add ``rank`` or ``dense_rank`` along the order reversed. Equal order values may fill many chunks."""
        names = [*self.keys, *self.order]
        source = self._of(*names).select(*columns(dict.fromkeys(names)), _ID, _RANGE)
        value, dense = F.struct(*columns(self.order)), F.dense_rank().over(self._window())
        chunks = self._chunks(
            source.withColumn("__dense", dense), F.max("__dense").alias("__groups"),
            F.count_if(F.col("__dense") == 1).alias("__head"),
            F.min_by(value, F.col(_ID)).alias("__low"), F.max_by(value, F.col(_ID)).alias("__high"))
        by_key = Window.partitionBy(*columns(self.keys)).orderBy(_RANGE)
        every = Window.partitionBy(*columns(self.keys))
        # a group that goes on from the chunk before is counted there
        chunks = chunks.withColumn("__joined", F.coalesce(
            (F.row_number().over(by_key) > 1) & F.col("__low").eqNullSafe(F.lag("__high").over(by_key)), F.lit(False)))
        chunks = chunks.withColumns({
            "__own": F.col("__groups") - F.col("__joined").cast("int"),
            "__rows_before": F.coalesce(self._before(_ROWS), F.lit(0)),
            "__more": F.coalesce(F.lead("__joined").over(by_key), F.lit(False))})
        chunks = chunks.withColumn("__dense_before", F.coalesce(self._before("__own"), F.lit(0)) - F.col("__joined").cast("int"))
        # how far the first group of a chunk goes, with all chunks that it opens
        group = Window.partitionBy(*columns(self.keys), F.col("__dense_before"))
        chunks = chunks.withColumn("__head_end", F.max(F.when(
            F.col("__joined"), F.col("__rows_before") + F.col("__head"))).over(group))
        chunks = written(chunks.withColumns({
            "__end": F.when(F.col("__more"), F.lead("__head_end").over(by_key)).otherwise(F.col("__rows_before") + F.col(_ROWS)),
            "__all_rows": F.sum(_ROWS).over(every), "__all_groups": F.sum("__own").over(every)}), "chunks")
        wanted = [_ROWS, "__rows_before", "__dense_before", "__end", "__all_rows", "__all_groups"]
        # the rows up to this one and its equals
        upto = F.count(F.lit(1)).over(self._window().rangeBetween(Window.unboundedPreceding, Window.currentRow))
        joined = self._attach(self.rows, chunks, *map(F.col, wanted))
        if kind == "dense_rank":
            rank = F.col("__all_groups") - F.col("__dense_before") - dense + 1
        else:
            last = F.when(upto == F.col(_ROWS), F.col("__end")).otherwise(F.col("__rows_before") + upto)
            rank = F.col("__all_rows") - last + 1
        return joined.withColumn(output, rank.cast("bigint")).drop(*wanted)
