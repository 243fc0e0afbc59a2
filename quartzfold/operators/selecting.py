"""Choosing ids: set relations, limits in order, samples per cluster, running caps, and the latest of several attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quartzfold.session import cut


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key with the highest ``order``; rows with a null key are left out. Combined before the shuffle."""
    others = [c for c in df.columns if c not in (key, order)]
    last = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(order, *others)).alias("_row"))
    return last.select(*[F.col(key) if c == key else F.col(f"_row.{c}") for c in df.columns])


def only(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti")


def first_in_order(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` rows in order; each task keeps ``n``, so nothing is sorted as a whole."""
    if n < 1:
        raise ValueError("n must be positive")
    return df.orderBy(order).limit(n)


def per_cluster(assigned: DataFrame, k: int, seed: int | None = None) -> DataFrame:
    """``k`` variants of each (template, cluster): the first by id, or with a seed those with the least MD5 of seed and id.

    Rows without a template or cluster are left out; a variant counts once in a cluster. Spark cuts each task's groups
    to ``k`` rows before the shuffle, so a group of any size brings few rows to the merge.
    """
    if k < 1:
        raise ValueError("k must be positive")
    rows = assigned.where("template_id is not null and cluster_id is not null and variant_id is not null").select("template_id", "cluster_id", "variant_id").distinct()
    order = [F.col("variant_id")] if seed is None else [F.md5(F.concat(F.lit(f"{seed}|"), "variant_id")), F.col("variant_id")]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("template_id", "cluster_id").orderBy(*order))).where(F.col("place") <= k)


def running_total(df: DataFrame, order: str | list[str], value: str, total: str = "total_before", group: list[str] | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before each, of its ``group`` if given, in a unique order; null values count as 0.

    Rows are range-partitioned on group and order; each task sums its own, and adds the totals of the tasks before it:
    one row per task, or per task and group that spans tasks. Null groups form one group.
    """
    group, order = group or [], [order] if isinstance(order, str) else order
    placed = cut(df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()))
    v = F.coalesce(F.col(value), F.lit(0))
    within = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("_part", *group).agg(F.sum(v).alias("_sum"))
    if group:
        sums = sums.withColumn("_tasks", F.count(F.lit(1)).over(Window.partitionBy(*group))).where("_tasks > 1")
    upto = Window.partitionBy(*[F.col(g) for g in group]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = sums.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g_{i}") for i, g in enumerate(group)], F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_earlier"))
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{i}"))
    summed = placed.withColumn("_within", F.coalesce(F.sum(v).over(within), F.lit(0))).join(F.broadcast(earlier), same, "left")
    return summed.withColumn(total, F.col("_within") + F.coalesce("_earlier", F.lit(0))).select(*df.columns, total)


def capped(df: DataFrame, order: str, value: str, most: int) -> DataFrame:
    """Rows in order until the sum of ``value`` reaches ``most``, with ``used``: the last row counts in part."""
    return running_total(df, order, value).where(F.col("total_before") < most).withColumn("used", F.least(F.coalesce(F.col(value), F.lit(0)), F.lit(most) - F.col("total_before"))).drop("total_before")


def select_ids(all_ids: DataFrame, mode: str, order: str, ids: DataFrame | None = None, assigned: DataFrame | None = None, k: int = 5, seed: int | None = None) -> DataFrame:
    """``all_ids`` (order, variant_id) in a mode: all, ids_file (those in ``ids``), or cluster_sample_k (``per_cluster`` of ``assigned``); the order is kept."""
    mode = mode.strip().lower()
    if mode == "all":
        return all_ids.orderBy(order)
    if mode == "ids_file" and ids is not None:
        return only(all_ids, ids.withColumnRenamed("id", "variant_id"), "variant_id").orderBy(order)
    if mode == "cluster_sample_k" and assigned is not None:
        return only(all_ids, per_cluster(assigned, k, seed), "variant_id").orderBy(order)
    raise ValueError(f"mode {mode!r} is unknown or lacks its table")
