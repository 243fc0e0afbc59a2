"""Problem 7: items of varying length in containers of fixed capacity.

The plan is made over the lengths' counts, not over documents: its size is bounded by the capacity, however many
documents there are. Documents then take the planned slots by their rank within their length.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzfold.operators.ranking import ranked_in_order
from quartzfold.session import cut


@dataclass(frozen=True)
class Slots:
    """``per`` items of one length in each of ``repeat`` containers from ``first`` on, for ranks from ``start`` on."""

    length: int
    start: int
    per: int
    first: int
    repeat: int


def plan(counts: dict[int, int], capacity: int) -> tuple[list[Slots], int]:
    """Slots for all items of the given counts by length (from 1 to ``capacity``), and the number of containers.

    Containers alike are planned at once: the longest length left opens one, then the room takes as many as it can of
    the longest length that fits, that is the one that leaves the least room, and so on. One container is open at a time,
    and the longest items come first, so this fills as best fit over the sorted lengths does. The same filling is
    repeated while the counts last, so there are few more plans than different lengths.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("a length must be from 1 to the capacity")
    lengths, taken = sorted(left), dict.fromkeys(left, 0)
    slots, containers = [], 0
    while lengths:
        room, upto, filling = capacity, len(lengths), []
        while room and upto:
            upto = bisect_right(lengths, room, 0, upto)
            if not upto:
                break
            n = lengths[upto - 1]
            per = min(left[n], room // n)
            filling.append((n, per))
            room -= n * per
            upto -= 1
        repeat = min(left[n] // per for n, per in filling)
        for n, per in filling:
            slots.append(Slots(n, taken[n], per, containers, repeat))
            taken[n] += per * repeat
            left[n] -= per * repeat
            if not left[n]:
                lengths.remove(n)
        containers += repeat
    return slots, containers


def pieces(sizes: DataFrame, containers: DataFrame, key: str) -> DataFrame:
    """Every item once for each container kind, those above the capacity in pieces: all full but the last.

    ``sizes``: key, n_tokens; ``containers``: container_kind, capacity_tokens. Kinds with a null or non-positive
    capacity are left out, of repeated kinds the least capacity counts. Columns: container_kind, capacity_tokens, key, part_no (from 0), start_token, n_tokens.
    """
    kinds = containers.where("container_kind is not null and capacity_tokens > 0").groupBy("container_kind").agg(F.min("capacity_tokens").alias("capacity_tokens"))
    n, size = F.col("n_tokens"), F.col("capacity_tokens")
    last = F.greatest(F.ceil(n / size).cast("int") - 1, F.lit(0))
    rows = sizes.select(key, "n_tokens").crossJoin(F.broadcast(kinds))  # container kinds are a few rows of configuration
    return rows.withColumn("part_no", F.explode(F.sequence(F.lit(0), last))).select(
        "container_kind", "capacity_tokens", key, "part_no", (F.col("part_no") * size).alias("start_token"), F.least(size, n - F.col("part_no") * size).alias("n_tokens")
    )


def pack(sizes: DataFrame, containers: DataFrame, key: str) -> DataFrame:
    """The container of every item or piece: container_kind, container_id, key, part_no, start_token, n_tokens.

    No container holds more than its capacity; only items above it are split. Items of size 0 take no room and are
    spread evenly over the containers. Equal sizes go by key, then part. Null sizes count as 0. Repeated keys are items
    of their own. An empty table gives no rows.

    One count per length comes to the driver (at most the sum of the capacities), and goes out as the plan.
    """
    # written once: ranking samples its input before it sorts, which would count the tokens twice
    rows = pieces(cut(sizes.select(key, F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))), containers, key)
    ranked = ranked_in_order(rows, ["container_kind", "n_tokens"], [F.col(key), F.col("part_no")])
    hist: dict[str, dict[int, int]] = {}
    capacity: dict[str, int] = {}
    for kind, size, n, c in ranked.groupBy("container_kind", "capacity_tokens", "n_tokens").count().collect():
        hist.setdefault(kind, {})[n] = c
        capacity[kind] = size
    plans = {}
    for kind, counts in hist.items():
        slots, total = plan({n: c for n, c in counts.items() if n}, capacity[kind])
        slots.sort(key=lambda s: (s.length, s.start))
        base, at = np.zeros(capacity[kind] + 2, np.int64), 0
        for n in sorted(counts):
            base[n] = at
            at += counts[n]
        columns = [np.array([f(s) for s in slots], np.int64) for f in (lambda s: base[s.length] + s.start, lambda s: s.per, lambda s: s.first)]
        plans[kind] = (base, total, *columns)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = np.array(batch.column("container_kind").to_pylist(), object)
            n, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n_tokens", "rank"))
            out = np.zeros(len(n), np.int64)
            for kind, (base, total, starts, per, first) in plans.items():
                mine = np.flatnonzero((kinds == kind) & (n > 0))
                at = base[n[mine]] + rank[mine]
                slot = np.searchsorted(starts, at, side="right") - 1
                out[mine] = first[slot] + (at - starts[slot]) // per[slot]
                none = (kinds == kind) & (n == 0)
                out[none] = rank[none] % max(total, 1)
            yield pa.RecordBatch.from_arrays([batch.column("container_kind"), pa.array(out), *(batch.column(c) for c in (key, "part_no", "start_token", "n_tokens"))], ["container_kind", "container_id", key, "part_no", "start_token", "n_tokens"])

    kind = dict(ranked.dtypes)
    return ranked.mapInArrow(take, f"container_kind string, container_id bigint, `{key}` {kind[key]}, part_no int, start_token {kind['start_token']}, n_tokens {kind['n_tokens']}")


def filling(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """Per container kind: items or pieces, containers, tokens, the fullest container and the share of room used."""
    kinds = containers.where("container_kind is not null and capacity_tokens > 0").groupBy("container_kind").agg(F.min("capacity_tokens").alias("capacity_tokens"))  # as in ``pieces``
    each = packed.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("items"))
    return (
        each.groupBy("container_kind")
        .agg(F.sum("items").alias("n_items"), F.count(F.lit(1)).alias("n_containers"), F.sum("tokens").alias("n_tokens"), F.max("tokens").alias("max_tokens"))
        .join(F.broadcast(kinds), "container_kind")
        .withColumn("filled", F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")))
    )
