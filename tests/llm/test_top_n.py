"""The top items of groups against sorting everything."""

import random

import pytest

from quartzfold.llm.top_n import latest_value, top_n


@pytest.mark.parametrize("held", [10, 500_000])
def test_against_sorting(spark, held):
    draw = random.Random(7)
    rows = [
        (draw.choice(["hot"] * 20 + ["a", "b", "ü", None]), draw.choice([1, 2, None]), draw.choice([0.1, 0.2, 0.2, 0.3, -0.5, None, float("nan"), float("inf")]), draw.choice(["x", "y", "ä", ""]) + str(draw.randint(0, 40)) if draw.random() < 0.95 else None, 1)
        for _ in range(4000)
    ]
    df = spark.createDataFrame(rows, "g string, h int, score double, item string, place int").repartition(6)
    best = {}
    for g, h, s, i, _ in rows:
        if None not in (g, h, s, i) and s == s:
            best[g, h, i] = min(s, best.get((g, h, i), s))
    wanted = {}
    for (g, h, i), s in best.items():
        wanted.setdefault((g, h), []).append((s, i.encode(), i))
    got = {}
    for r in top_n(df, ["g", "h"], "score", "item", 5, held_rows=held).collect():
        got.setdefault((r["g"], r["h"]), {})[r["place"]] = (r["score"], r["item"])
    assert got == {k: {n + 1: (s, i) for n, (s, _, i) in enumerate(sorted(v)[:5])} for k, v in wanted.items()}


@pytest.mark.parametrize("parts", [1, 4])
def test_an_item_with_several_scores_takes_one_place(spark, parts):
    rows = [("g", 1.0, "A"), ("g", 2.0, "A"), ("g", 3.0, "A"), ("g", 4.0, "B"), ("h", 2.0, "A"), ("h", 1.0, "B"), ("h", 1.5, "B"), ("h", 3.0, "C")]
    df = spark.createDataFrame(rows, "g string, score double, item string").repartition(parts)
    got = {(r["g"], r["place"], r["item"], r["score"]) for r in top_n(df, ["g"], "score", "item", 2).collect()}
    assert got == {("g", 1, "A", 1.0), ("g", 2, "B", 4.0), ("h", 1, "B", 1.0), ("h", 2, "A", 2.0)}


def test_carried_columns(spark):
    df = spark.createDataFrame([("g", 2.0, "A", None), ("g", 1.0, "B", b"x"), ("g", 1.5, "B", b"x")], "g string, score double, item string, key binary")
    assert sorted(tuple(r) for r in top_n(df, ["g"], "score", "item", 2, carried=("key",)).collect()) == [("g", "A", None, 2.0, 2), ("g", "B", bytearray(b"x"), 1.0, 1)]


def test_empty(spark):
    none = spark.createDataFrame([], "g string, score double, item string")
    assert top_n(none, ["g"], "score", "item", 3).count() == 0


def test_latest_value(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, None), ("b", 3, 1.0), ("b", 2, 9.0)], "k string, row_id int, v double")
    assert {r["k"]: r["v"] for r in latest_value(df, "k", "row_id", "v").collect()} == {"a": None, "b": 1.0}
