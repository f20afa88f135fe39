"""Groups of rows inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def by_group(df: DataFrame, keys: Sequence[str], *then) -> DataFrame:
    """All rows of a key in one partition, next to each other, ordered by ``then`` inside it."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *then)


def starts(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    """Where a new group begins in rows that are sorted by ``names`` (which hold no null)."""
    new = np.ones(table.num_rows, bool)
    new[1:] = False
    for name in names:
        column = table[name].combine_chunks()
        codes = column.to_numpy() if pa.types.is_integer(column.type) else \
            column.dictionary_encode().indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def whole_groups(batches: Iterable[pa.RecordBatch], names: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with their bounds (begins, and the end); a group may span many batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        begins = starts(pa.Table.from_batches([held[0].slice(held[0].num_rows - 1), batch]
                                              if len(held) > 1 else [batch]).select(names), names)
        shift = len(held) > 1
        cut = begins[-1] - shift
        if cut > 0 or (shift and len(begins) > 1):
            table = pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
            yield table, np.append(starts(table, names), table.num_rows)
            held = [batch.slice(cut)]
    if held:
        table = pa.Table.from_batches(held)
        yield table, np.append(starts(table, names), table.num_rows)
