"""Varied subsets: exact sizes, limits kept, crowds held down, the same every time."""

import itertools
from collections import Counter

import numpy as np
import pytest

from quartzfold.llm.queries import choosable_variants
from quartzfold.llm.selection import hilbert, varied_subset

SPECS = "spec_id int, selection_mode string, k_per_cluster int, seed int, draw_sample boolean, subset_size int, subset_share double"
ITEMS = "item long, group long, preferred boolean, vector array<float>, key string"


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (4, 2), (2, 5)])
def test_curve_steps_to_neighbours(dims, bits):
    q = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    key = (hilbert(q, bits) * (1 << (dims * np.arange(bits - 1, -1, -1)))).sum(axis=1)
    path = q[np.argsort(key)]
    assert sorted(key) == list(range(len(q))) and (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_sizes_limits_and_crowds(spark):
    draw = np.random.default_rng(8)
    centres = draw.normal(size=(50, 16)) * 7
    crowd = np.r_[np.zeros(700, int), draw.integers(0, 50, 300)]
    x = centres[crowd] + draw.normal(size=(1000, 16)) * 0.05
    x[:200] = centres[0]
    groups = draw.integers(0, 25, 1000)
    items = spark.createDataFrame([(i, int(groups[i]), None if i % 9 == 0 else i % 5 == 0, v.tolist(), "k") for i, v in enumerate(x)], ITEMS).repartition(5)
    specs = [(1, "m", 5, 0, False, 40, None), (2, "m", 2, 3, True, 45, None), (3, "m", 1, 0, False, 60, None), (4, "m", 100, 1, True, None, 0.3), (5, "m", 3, None, None, None, None), (6, "m", 0, 0, False, 5, None), (7, "m", 100, 0, False, 950, None), (8, "m", 1, 0, False, 0, None)]
    chosen = [tuple(r) for r in varied_subset(items, spark.createDataFrame(specs, SPECS), 16).collect()]
    assert len(chosen) == len(set(chosen))
    of = {s: [i for t, i in chosen if t == s] for s in range(1, 9)}
    room = lambda k: sum(min(k, n) for n in Counter(groups).values())
    assert {s: len(v) for s, v in of.items()} == {1: 40, 2: min(45, room(2)), 3: min(60, room(1)), 4: 300, 5: room(3), 6: 0, 7: 950, 8: 0}
    for s, k in ((1, 5), (2, 2), (3, 1), (4, 100), (5, 3)):
        assert max(Counter(groups[of[s]]).values()) <= k
    assert len(set(crowd[of[1]])) >= 25 and Counter(crowd[of[1]])[0] <= 10  # a crowd of 700 in 1000 would fill 28 of 40
    again = varied_subset(items.repartition(2), spark.createDataFrame(specs, SPECS), 16)
    assert sorted(tuple(r) for r in again.collect()) == sorted(chosen)


def test_covers_more_than_chance(spark):
    """On the real vectors: how many clusters of alike variants a subset meets, and how near it comes to each, against random subsets of its size."""
    items = choosable_variants(spark, "/root/testdata/sf0.01").select("item", "group", "preferred", "vector").toPandas().sort_values("item")
    x = np.stack(items.vector).astype(float)
    off = np.concatenate([np.sqrt(((x[i : i + 500, None] - x) ** 2).sum(axis=2)) for i in range(0, len(x), 500)])
    cluster, near = np.arange(len(x)), off <= 1
    while (new := np.where(near, cluster, len(x)).min(axis=1)).tolist() != cluster.tolist():
        cluster = new
    specs = spark.createDataFrame([(1, "m", 1000, 0, False, 150, None), (2, "m", 1000, 0, False, 600, None)], SPECS)
    rows = spark.createDataFrame([(int(r.item), int(r.group), bool(r.preferred), [float(v) for v in r.vector], "") for r in items.itertuples()], ITEMS)
    chosen = [tuple(r) for r in varied_subset(rows, specs, 16).collect()]

    def met(at):
        nearest = off[:, at].min(axis=1)
        return len(set(cluster[at])), np.mean([nearest[cluster == c].min() for c in np.unique(cluster)])

    draw = np.random.default_rng(0)
    for spec, size in ((1, 150), (2, 600)):
        own = met(np.flatnonzero(np.isin(items.item, [i for s, i in chosen if s == spec])))
        others = [met(draw.choice(len(x), size, replace=False)) for _ in range(5)]
        assert own[0] > 1.1 * max(n for n, _ in others) and own[1] < min(d for _, d in others)


def test_empty(spark):
    none = spark.createDataFrame([], ITEMS)
    assert varied_subset(none, spark.createDataFrame([(1, "m", 1, 0, False, 5, None)], SPECS), 16).count() == 0
    one = spark.createDataFrame([(1, 1, True, [1.0] * 16, "")], ITEMS)
    assert varied_subset(one, spark.createDataFrame([], SPECS), 16).count() == 0
