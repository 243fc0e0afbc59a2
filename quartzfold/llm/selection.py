"""Problem 4: a varied subset of given size, with a limit per group.

Vectors are quantised to cells, and cells are put in order along a Hilbert curve, so that neighbours in the order are
neighbours in space. Evenly spaced distinct cells then cover the variety of the data, however many records crowd in one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartzfold.llm.top_n import top_n
from quartzfold.operators.ranking import ranked_in_order
from quartzfold.session import cut

BITS = 4


def hilbert(q: np.ndarray, bits: int) -> np.ndarray:
    """The place of each row of cell numbers (below 2**bits) along a Hilbert curve, as (rows, bits) groups of one bit per dimension, coarsest first.

    Each step of the curve goes to a neighbouring cell, and the first groups alone are the curve over coarser cells. The
    groups are found from coarse to fine: the bits of a cell, in the curve's own orientation, are the Gray code of the
    group, and the orientation (one exchange and mirror per dimension) is carried on to the next.
    """
    x = q.astype(np.int64).copy()
    n, d = x.shape
    top = 1 << (bits - 1)
    level = top
    while level > 1:  # undo the turns of coarser cells
        low = level - 1
        for i in range(d):
            on = (x[:, i] & level) > 0
            x[on, 0] ^= low
            swap = np.where(on, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= swap
            x[:, i] ^= swap
        level >>= 1
    for i in range(1, d):  # Gray code over the dimensions
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(n, np.int64)
    level = top
    while level > 1:
        turn ^= np.where((x[:, -1] & level) > 0, level - 1, 0)
        level >>= 1
    x ^= turn[:, None]
    weights = 1 << np.arange(d - 1, -1, -1)
    return np.stack([(((x >> b) & 1) * weights).sum(axis=1) for b in range(bits - 1, -1, -1)], axis=1)


def curve_keys(items: DataFrame, vector: str, dim: int, bits: int = BITS) -> DataFrame:
    """``items`` with ``key`` (binary, ordered along the curve; each ``ceil(dim / 8)`` bytes are one level) instead of the vector, and ``along`` (its place from 0 to 1).

    Each dimension is cut into 2**bits equal parts between its percentiles 1 and 99; values beyond lie in the outer ones.
    """
    ends = items.agg(*[F.percentile_approx(F.col(vector)[i].cast("double"), [0.01, 0.99], 1000).alias(f"d{i}") for i in range(dim)]).first()
    low = np.array([e[0] if e else 0.0 for e in ends], float)
    step = np.maximum(np.array([e[1] if e else 1.0 for e in ends], float) - low, 1e-12) / (1 << bits)
    width = -(-dim // 8)
    others = [c for c in items.columns if c != vector]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(vector).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
            groups = hilbert(np.clip(np.floor((v - low) / step), 0, (1 << bits) - 1), bits)
            raw = (groups[:, :, None] >> (8 * np.arange(width - 1, -1, -1))).astype(np.uint8).reshape(len(v), -1)
            along = (groups * (2.0 ** -(dim * np.arange(1, bits + 1)))).sum(axis=1)
            key = pa.FixedSizeBinaryArray.from_buffers(pa.binary(bits * width), len(v), [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), key, pa.array(along)], [*others, "key", "along"])

    kinds = dict(items.dtypes)
    return items.select(*others, vector).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in others) + ", key binary, along double")


def _evenly(at: Column, count: Column, wanted: Column, offset: Column) -> Column:
    """Whether place ``at`` of ``count`` is one of exactly ``wanted`` evenly spaced places, shifted by ``offset``."""
    x = F.pmod(at + offset, count)
    part = lambda v: F.floor(v.cast("decimal(38,0)") * wanted.cast("decimal(20,0)") / count.cast("decimal(20,0)")).cast("long")
    return part(x + 1) > part(x)


def varied_subset(items: DataFrame, specs: DataFrame, dim: int, bits: int = BITS) -> DataFrame:
    """For each row of ``specs`` a varied subset of ``items``: spec_id, item.

    ``items``: item (bigint, unique), group (bigint: the cluster), preferred (boolean, the better record of a cell),
    vector (array of ``dim`` finite values). ``specs`` (configuration, a few rows): spec_id, k_per_cluster, seed,
    draw_sample, and subset_size or subset_share (of all items, rounded half up). Specs with a null or non-positive
    limit are left out; neither size nor share asks for all. As many items come out as asked for, fewer only where the
    limit leaves no more. The best record of a cell is a preferred one, then the least item, or with ``draw_sample``
    the least hash of seed and item.

    First each group is cut into ``k_per_cluster`` stretches of the curve, and keeps the best of each stretch, then the
    second best, up to its limit: bounded heaps, however large the group. Among what is kept, the coarsest cells that
    are at least as many as the items asked for are put in order over the whole table, and evenly spaced ones give their
    best record; if there are fewer cells than that, all give one, then evenly spaced ones a second, and so on.
    """
    width = -(-dim // 8)
    keyed = cut(curve_keys(items.select("item", "group", F.coalesce("preferred", F.lit(False)).alias("preferred"), "vector"), "vector", dim, bits))
    total = keyed.count()
    rows = [r.asDict() for r in specs.where("spec_id is not null and k_per_cluster > 0").collect()]  # configuration
    wanted = {r["spec_id"]: total if r["subset_size"] is None and r["subset_share"] is None else r["subset_size"] if r["subset_size"] is not None else int(r["subset_share"] * total + 0.5) for r in rows}
    spark = items.sparkSession
    small = spark.createDataFrame([(r["spec_id"], int(r["k_per_cluster"]), int(r["seed"] or 0), bool(r["draw_sample"]), int(wanted[r["spec_id"]])) for r in rows], "spec_id int, k int, seed long, draw boolean, wanted long")
    span = keyed.groupBy("group").agg(F.min("along").alias("lo"), F.max("along").alias("hi"))
    each = keyed.join(span, "group").crossJoin(F.broadcast(small))
    score = F.when(F.col("draw"), F.xxhash64("seed", "item").cast("double")).when(F.col("preferred"), 0.0).otherwise(1.0)
    stretch = F.least(F.floor((F.col("along") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-18) * F.col("k")).cast("int"), F.col("k") - 1)
    each = each.withColumn("score", score).withColumn("stretch", stretch)
    most = max((r["k_per_cluster"] for r in rows), default=1)
    best = top_n(each, ["spec_id", "group", "stretch"], "score", "item", int(most), carried=("key",))
    turn = Window.partitionBy("spec_id", "group").orderBy("place", "stretch", "item")
    kept = best.withColumn("turn", F.row_number().over(turn)).join(F.broadcast(small), "spec_id").where("turn <= k")
    kept = cut(kept.select("spec_id", "item", "key", "score", "seed", "draw", "wanted"))
    # distinct cells of each level from those of the next finer one
    found, finer = None, kept.select("spec_id", F.col("key").alias("cell"))
    for n in range(bits, 0, -1):
        finer = finer.select("spec_id", F.col("cell").substr(F.lit(1), F.lit(width * n)).alias("cell")).distinct()
        counted = finer.groupBy("spec_id").agg(F.count(F.lit(1)).alias("n")).withColumn("level", F.lit(n))
        found = counted if found is None else found.unionByName(counted)
    counts: dict[int, dict[int, int]] = {}
    for r in found.collect():  # a row per spec and level
        counts.setdefault(r["spec_id"], {})[r["level"]] = r["n"]
    level = {s: next((n for n in range(1, bits + 1) if c[n] >= wanted[s]), bits) for s, c in counts.items()}
    bytes_of = F.coalesce(*[F.when(F.col("spec_id") == s, F.lit(width * n)) for s, n in level.items()]) if level else F.lit(width)
    cells = kept.withColumn("cell", F.col("key").substr(F.lit(1), bytes_of))
    in_cell = ranked_in_order(cells, ["spec_id", "cell"], [F.col("score"), F.col("item")], "round")
    placed = cut(ranked_in_order(in_cell, ["spec_id", "round"], [F.col("cell")], "at"))
    sizes = placed.groupBy("spec_id", "round").agg(F.count(F.lit(1)).alias("count"))
    upto = Window.partitionBy("spec_id").orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("before", F.coalesce(F.sum("count").over(upto), F.lit(0)))
    take = placed.join(before, ["spec_id", "round"]).withColumn("due", F.least(F.col("wanted") - F.col("before"), F.col("count"))).where("due > 0")
    offset = F.when(F.col("draw"), F.pmod(F.xxhash64("seed", "round"), F.col("count"))).otherwise(F.floor(F.col("count") / F.col("due") / 2).cast("long"))
    return take.where(_evenly(F.col("at"), F.col("count"), F.col("due"), offset)).select("spec_id", "item")
