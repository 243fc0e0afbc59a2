"""Problem 3: the top N items within every group, with a consistent tie rule."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _best(rows: pa.Table, group: list[str], score: str, item: str, n: int) -> pa.Table:
    """The first ``n`` different items of each group, each at its lowest score, by score, then item; rows must have no null in these columns."""
    order = pc.sort_indices(rows, [(c, "ascending") for c in [*group, score, item]])
    rows = rows.take(order)
    size = rows.num_rows
    if not size:
        return rows
    new_group = np.zeros(size, bool)
    new_group[0] = True
    codes = [pc.dictionary_encode(rows[c].combine_chunks()) for c in [*group, item]]
    ids = [np.asarray((c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).indices) for c in codes]
    for v in ids[:-1]:
        new_group[1:] |= v[1:] != v[:-1]
    # rows of an item lie by score within its group, so a stable sort by group and item puts its lowest score first
    number = np.cumsum(new_group)
    by_item = np.lexsort((ids[-1], number))
    again = np.zeros(size, bool)
    again[by_item[1:]] = (number[by_item[1:]] == number[by_item[:-1]]) & (ids[-1][by_item[1:]] == ids[-1][by_item[:-1]])
    kept = np.flatnonzero(~again)
    first = np.flatnonzero(new_group[kept])
    place = np.arange(len(kept)) - np.repeat(first, np.diff([*first, len(kept)]))
    return rows.take(pa.array(kept[place < n]))


def _partial(group: list[str], score: str, item: str, n: int, held_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap, fresh, fresh_rows = None, [], 0
        for batch in batches:
            fresh.append(batch)
            fresh_rows += batch.num_rows
            if fresh_rows < max(50_000, heap.num_rows if heap is not None else 0):
                continue
            heap = _best(pa.concat_tables([*([heap] if heap is not None else []), pa.Table.from_batches(fresh)]), group, score, item, n)
            fresh, fresh_rows = [], 0
            if heap.num_rows > held_rows:  # millions of small groups: pass on what is held; the merge sees all of it
                yield from heap.to_batches(10_000)
                heap = None
        if fresh:
            heap = _best(pa.concat_tables([*([heap] if heap is not None else []), pa.Table.from_batches(fresh)]), group, score, item, n)
        if heap is not None:
            yield from heap.to_batches(10_000)

    return run


def top_n(df: DataFrame, group: list[str], score: str, item: str, n: int, held_rows: int = 500_000, carried: tuple[str, ...] = ()) -> DataFrame:
    """The ``n`` rows of each group with the lowest ``score``, equal scores by ``item`` (strings in byte order).

    Returns the group, item, ``carried`` (the same for all rows of an item) and score columns and ``place`` (from 1). An item counts once in a group at its lowest
    score. Rows with a null group, score or item, or a NaN score, are left out; groups smaller than ``n`` come out whole;
    other columns of ``df`` are ignored. Negate the score for the highest.

    Each task keeps a bounded heap of ``n`` items per group as its batches pass, before the shuffle. The heaps are merged
    after it: a group of any size brings at most ``n`` rows from each task. A task holding more than ``held_rows`` rows
    passes them on to the merge and goes on, so memory is bounded whatever the number of groups.
    """
    columns = [*group, item, *carried]
    rows = df.select(*columns, F.col(score).cast("double").alias(score)).na.drop(subset=[*group, item, score]).where(~F.isnan(score))
    heaps = rows.mapInArrow(_partial(group, score, item, n, held_rows), rows.schema)
    # one shuffle by group serves both: an item that two tasks kept, at perhaps different scores, counts once; then the places
    once = heaps.repartition(*group).groupBy(*columns).agg(F.min(score).alias(score))
    order = Window.partitionBy(*group).orderBy(score, item)
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def latest_value(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The ``value`` of each key's row with the highest ``order``, null where that row has none."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))
