"""Problem 2: references to records that do not exist, or did not at the time, per table and period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def same_path(path: Column) -> Column:
    """A path in the spelling in which equal files have equal paths: no leading ``./``, no ``/./``, no repeated slash."""
    return F.regexp_replace(F.regexp_replace(path, r"^(?:\./)+", ""), r"/(?:\.?/)+", "/")


def missing_references(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Rows of ``children`` whose key had no live row in ``parents`` at their time.

    ``children``: table_name, parent_table, key, at, row_id; ``parents``: parent_table, key, start_at, end_at. A parent
    is live from ``start_at``, inclusive, to ``end_at``, exclusive, or for ever if that is null; rows with a null start,
    or an end not after their start, are never live. Children with a null key refer to nothing and are left out; those
    with a null ``at`` refer to a record that can't be found and come out. Repeated rows are kept.

    Parents (+1 at their start, -1 at their end) and children (0) are united in long form and summed by parent table, key
    and hour, on the map side too; the running sum over a key's hours says how many parents are live as an hour begins.
    Of the hours with a child, those become spans in which no parent is live: the whole hour where nothing changes, else
    what lies between the hour's changes. Children within a span are missing. So a key with a third of all rows is
    spread over its hours, children are never sorted or collected by key, and a hot hour is a join with few spans, which
    adaptive execution splits.
    """
    hour = lambda c: F.unix_date(F.to_date(c)) * 24 + F.hour(c)
    group = ["parent_table", "key", "hour"]
    alive = parents.where("key is not null and start_at is not null and (end_at is null or end_at > start_at)")
    step = lambda at, by: alive.where(F.col(at).isNotNull()).select("parent_table", "key", F.col(at).alias("at"), F.lit(by).alias("step"))
    changes = step("start_at", 1).unionByName(step("end_at", -1)).withColumn("hour", hour(F.col("at")))
    asked = children.where("key is not null and at is not null").withColumn("hour", hour(F.col("at")))
    events = changes.select(*group, "at", "step").unionByName(asked.select(*group, F.lit(None).cast("timestamp").alias("at"), F.lit(0).alias("step")))
    by_hour = events.groupBy(group).agg(F.sum("step").alias("change"), F.min("at").alias("first"), F.count_if(F.col("at").isNull()).alias("asked"))
    earlier = Window.partitionBy("parent_table", "key").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    carried = by_hour.withColumn("live", F.coalesce(F.sum("change").over(earlier), F.lit(0))).where("asked > 0 and (live <= 0 or first is not null)").select(*group, "first", "live")
    # from when to when no parent is live in an hour, null for its ends
    begin = carried.where("live <= 0").select(*group, F.lit(None).cast("timestamp").alias("since"), F.col("first").alias("until"))
    within = Window.partitionBy(group).orderBy("at")
    # joined by hour, the changes of one moment are summed and ordered where they are
    after = changes.join(carried.where("first is not null").select(*group, "live"), group).groupBy(*group, "at").agg(F.sum("step").alias("step"), F.min("live").alias("live"))
    after = after.withColumns({"live": F.col("live") + F.sum("step").over(within.rowsBetween(Window.unboundedPreceding, 0)), "until": F.lead("at").over(within)})
    spans = begin.unionByName(after.where("live <= 0").select(*group, F.col("at").alias("since"), "until"))
    columns = ["table_name", "parent_table", "key", "at", "row_id"]
    found = asked.join(spans, group).where("(since is null or at >= since) and (until is null or at < until)").select(columns)
    return found.unionByName(children.where("key is not null and at is null").select(columns))


def missing_by_period(missing: DataFrame) -> DataFrame:
    """The number of missing references per table, parent table and month (``ref_month`` as yyyy-MM, null if unknown)."""
    month = F.date_format(F.to_date("at"), "yyyy-MM")
    return missing.groupBy("table_name", "parent_table", month.alias("ref_month")).agg(F.count(F.lit(1)).alias("n_missing"))
