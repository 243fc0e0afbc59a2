"""Row numbers over whole tables and over groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartzfold.session import cut


def ranked_in_order(df: DataFrame, group: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """Add ``rank`` (bigint, from 0): the place of each row within its group in the given order.

    Rows are range-partitioned on group and order together, so a group with a third of all rows spreads over many tasks.
    Each task numbers its own sorted rows; what earlier tasks hold of the same group is added from a table with at most
    one row per (task, group that spans tasks). ``order`` must be total within a group, else equal rows get either number.
    Null groups form one group. An empty table stays empty. ``df`` must not hold columns named ``_part`` or ``_at``.
    """
    keys = [F.col(c) for c in group] + order
    placed = cut(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    by_task = Window.partitionBy("_part", *group).orderBy(*order)
    numbered = placed.withColumn("_at", F.row_number().over(by_task).cast("long") - 1)
    held = placed.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_held"))
    if group:
        # only the first and last group of a task can span tasks; all others start at 0
        edge = Window.partitionBy(*group)
        held = held.withColumn("_tasks", F.count(F.lit(1)).over(edge)).where("_tasks > 1")
        before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    else:
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select(
        F.col("_part").alias("_p"),
        *[F.col(c).alias(f"_g_{c}") for c in group],
        F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_before"),
    )
    same = F.col("_part") == F.col("_p")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    # at most two spanning groups a task, and as many tasks as shuffle partitions
    joined = numbered.join(F.broadcast(starts), same, "left")
    return joined.withColumn(rank, F.col("_at") + F.coalesce("_before", F.lit(0))).select(*df.columns, rank)
