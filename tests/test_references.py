"""Missing references against a loop over all parents."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quartzfold.operators.references import missing_by_period, missing_references, same_path

C, P = "table_name string, parent_table string, key string, at timestamp, row_id long, start_at string", "parent_table string, key string, start_at timestamp, end_at timestamp, row_id long"


def test_against_loop(spark):
    draw = random.Random(1)
    t0 = datetime(2024, 1, 1)
    when = lambda: t0 + timedelta(minutes=draw.choice([0, 1, 30, 59, 60, 61, 90, 119, 600, 9000]))
    key = lambda: draw.choice(["hot"] * 10 + ["a", "b", "c", "d", "", None])
    parents = [("t" + draw.choice("12"), key(), draw.choice([when(), when(), when(), None]), draw.choice([when(), when(), None]), 5) for _ in range(40)]
    children = [("c", "t" + draw.choice("12"), key(), draw.choice([when(), when(), when(), None]), i, "x") for i in range(600)] + [("c", "t9", "z", t0, 601, "x")]
    got = sorted(r["row_id"] for r in missing_references(spark.createDataFrame(children, C), spark.createDataFrame(parents, P)).collect())
    live = lambda c: any(p[0] == c[1] and p[1] == c[2] and p[2] and c[3] and p[2] <= c[3] and (p[3] is None or c[3] < p[3]) for p in parents)
    assert got == [c[4] for c in children if c[2] is not None and not live(c)]
    months = missing_by_period(missing_references(spark.createDataFrame(children, C), spark.createDataFrame(parents, P)))
    assert months.agg(F.sum("n_missing")).first()[0] == len(got)


def test_empty_tables(spark):
    none = spark.createDataFrame([], P)
    assert missing_references(spark.createDataFrame([], C), none).count() == 0
    assert missing_references(spark.createDataFrame([("c", "t", "k", datetime(2024, 1, 1), 1, "")], C), none).count() == 1


def test_a_child_without_row_id_counts(spark):
    children = spark.createDataFrame([("c", "t", "k", datetime(2024, 1, 1), None, "")], C)
    assert missing_references(children, spark.createDataFrame([], P)).count() == 1


def test_same_path(spark):
    cases = {"a/b": "a/b", "./a//b": "a/b", "././a/./b": "a/b", "a/././/b": "a/b", "a/.b": "a/.b", "a/b.": "a/b.", "a/..//b": "a/../b", "A/b ": "A/b ", "": ""}
    rows = spark.createDataFrame(list(cases.items()), "path string, wanted string").select("wanted", same_path(F.col("path")).alias("got")).collect()
    assert all(r["wanted"] == r["got"] for r in rows)
