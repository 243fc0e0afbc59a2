"""Ranks, running sums, components and selections against pandas and plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from quartzfold.operators.components import connected_components
from quartzfold.operators.ranking import ranked_in_order
from quartzfold.operators.selecting import capped, first_in_order, latest, only, per_cluster, running_total, without


def test_ranks_within_groups(spark):
    draw = random.Random(2)
    rows = [(draw.choice(["hot"] * 8 + ["a", "b", None]), draw.randint(0, 5), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, v int, id int").repartition(7)
    got = {r["id"]: r["rank"] for r in ranked_in_order(df, ["g"], [F.col("v"), F.col("id")]).collect()}
    for g in {r[0] for r in rows}:
        for n, (_, i) in enumerate(sorted((v, i) for h, v, i in rows if h == g)):
            assert got[i] == n
    whole = {r["id"]: r["rank"] for r in ranked_in_order(df, [], [F.col("id")]).collect()}
    assert whole == {i: i for i in range(2000)}
    assert ranked_in_order(df.where("false"), ["g"], [F.col("id")]).count() == 0


def test_running_total_and_cap(spark):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else i % 5, "x") for i in range(500)], "id int, n int, total string").repartition(5)
    got = {r["id"]: r["total_before"] for r in running_total(df, "id", "n").collect()}
    total = 0
    for i in range(500):
        assert got[i] == total
        total += 0 if i % 7 == 0 else i % 5
    used = capped(df, "id", "n", 100).agg(F.sum("used")).first()[0]
    assert used == 100


@pytest.mark.parametrize("shape", ["random", "chain", "hub", "none"])
def test_components(spark, shape):
    draw = random.Random(3)
    edges = {
        "random": [(draw.randint(0, 400), draw.randint(0, 400)) for _ in range(300)] + [(None, 1), (5, 5)],
        "chain": [(i, i + 1) for i in range(150)] + [(151, 150)] * 3,
        "hub": [(1000, i) for i in range(500)],
        "none": [],
    }[shape]
    head: dict[int, int] = {}
    find = lambda x: x if head.setdefault(x, x) == x else find(head[x])
    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            head[b] = a
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(head)}


def test_selections(spark):
    df = spark.createDataFrame([("t", 1, f"v{i % 30}", i) for i in range(60)] + [("t", 2, "w", 99), (None, 1, "x", 100), ("t", None, "y", 101), ("t", 1, None, 102)], "template_id string, cluster_id int, variant_id string, row_id int")
    assert [r["variant_id"] for r in per_cluster(df, 3).where("cluster_id = 1").orderBy("place").collect()] == ["v0", "v1", "v10"]
    assert {r[0] for r in per_cluster(df, 3, seed=1).select("variant_id").collect()} == {r[0] for r in per_cluster(df.repartition(9), 3, seed=1).select("variant_id").collect()}
    assert {r["variant_id"]: r["row_id"] for r in latest(df, "variant_id", "row_id").collect()}["v3"] == 33
    some = df.where("variant_id = 'v3'")
    assert only(df, some, "variant_id").count() == 2 and without(df, some, "variant_id").count() == df.count() - 2
    assert [r["row_id"] for r in first_in_order(df, "row_id", 3).collect()] == [0, 1, 2]
    with pytest.raises(ValueError):
        per_cluster(df, 0)
