"""Clusters of vectors against all pairs."""

import numpy as np
import pytest

from quartzfold.llm import clusters
from quartzfold.llm.clusters import Alike, alike, band_keys, cells, loose_parts, similar_groups, typical, usable
from pyspark.sql import functions as F

SCHEMA = "node long, name string, vector array<float>, clash int"


def brute(x):
    label = np.arange(len(x))
    near = ((x[:, None] - x[None]) ** 2).sum(axis=2) <= 1
    while True:
        new = np.where(near, label[None], len(x)).min(axis=1)
        if (new == label).all():
            return label
        label = new


def vectors():
    draw = np.random.default_rng(6)
    centres = draw.normal(size=(60, 16)) * 7
    x = [c + draw.normal(size=16) * 0.1 for c in centres for _ in range(draw.integers(1, 8))]
    x += [centres[0] + draw.normal(size=16) * 0.08 for _ in range(500)]  # a third alike
    x += [centres[1] + np.eye(16)[0] * 0.8 * k for k in range(12)]  # a chain
    x += [centres[2] + np.eye(16)[3] * 1.6]  # near, but apart
    x += [centres[3]] * 40  # equal
    x = np.array(x, np.float32).astype(float)
    return x[draw.permutation(len(x))]


@pytest.mark.parametrize("chunk", [100, 32_768])
def test_against_all_pairs(spark, chunk):
    x, how = vectors(), Alike(chunk=chunk)
    nodes = spark.createDataFrame([(i, f"n{i}", v.tolist(), 0) for i, v in enumerate(x)], SCHEMA).repartition(5)
    labels, links = similar_groups(nodes, how)
    got = {r["node"]: r["cluster"] for r in labels.collect()}
    wanted = brute(x)
    assert got == {i: int(w) for i, w in enumerate(wanted)}
    assert all(((x[a] - x[b]) ** 2).sum() <= 1 for a, b in links.collect())
    parts = {r["node"]: (r["cluster"], r["part"]) for r in loose_parts(labels, links, nodes, how).collect()}
    assert all(wanted[p] == c for c, p in parts.values())
    chain = [i for i in range(len(x)) if (wanted == wanted[i]).sum() >= 12 and parts[i][0] != parts[i][1]]
    assert chain, "the chain is split"
    best = {r["cluster"]: r for r in typical(labels, nodes, 3, how).collect()}
    for c, r in best.items():
        own = np.flatnonzero(wanted == c)
        assert r["size"] == len(own)
        off = ((x[own] - x[own].mean(axis=0)) ** 2).sum(axis=1)
        assert len(r["typical"]) == min(3, len(own)) and np.isclose(((x[int(r["typical"][0][1:])] - x[own].mean(axis=0)) ** 2).sum(), off.min(), atol=1e-6)


@pytest.mark.parametrize(("chunk", "block"), [(100, 40), (32_768, 4096)])
def test_parts_against_all_pairs(spark, chunk, block):
    draw, how = np.random.default_rng(8), Alike(chunk=chunk)
    x = draw.normal(size=(260, 16)) * 0.17 + np.eye(16)[2] * draw.uniform(0, 4, (260, 1))  # a long crowd
    x = np.concatenate([x, x[[200] * 30], vectors()[:80]]).astype(np.float32).astype(float)
    x = x[draw.permutation(len(x))]
    nodes = spark.createDataFrame([(i, f"n{i}", v.tolist(), 0) for i, v in enumerate(x)], SCHEMA).repartition(5)
    labels, links = similar_groups(nodes, how)
    wanted = brute(x)
    near = ((x[:, None] - x[None]) ** 2).sum(axis=2) <= 1
    most = near.sum(axis=1)
    loose = {c: np.sqrt(((x[wanted == c] - x[wanted == c].mean(axis=0)) ** 2).sum(axis=1)).max() > 1 for c in set(wanted)}
    part = [min(np.flatnonzero(near[i]), key=lambda j: (-most[j], j)) if loose[wanted[i]] else wanted[i] for i in range(len(x))]
    assert len({p for p, c in zip(part, wanted, strict=True) if loose[c]}) > 3
    got = {r["node"]: (r["cluster"], r["part"]) for r in loose_parts(labels, links, nodes, how, **({} if block == 4096 else {"block": block})).collect()}
    assert got == {i: (c, p) for i, (c, p) in enumerate(zip(wanted, part, strict=True))}


def test_no_alike_pair_is_below_the_bound():
    draw, how = np.random.default_rng(1), Alike()
    x = draw.normal(size=(20_000, 16)) * 5
    step = draw.normal(size=x.shape)
    y = x + step / np.sqrt((step**2).sum(axis=1, keepdims=True)) * draw.uniform(0, 1, (len(x), 1))
    assert alike(x, y, how).all() and not alike(x, x + 0.3, how).any()
    same = (band_keys(cells(x[:500], how), how) == band_keys(cells(x[:500], how), how)).all()
    assert same and (band_keys(cells(x, how), how) == band_keys(cells(y, how), how)).any(axis=1).mean() > 0.9999


def test_components_apart_are_paired_once_however_many_chunks_hold_them(spark, monkeypatch):
    draw, chunks = np.random.default_rng(4), 30
    at = draw.normal(size=16) * 7
    x = np.concatenate([at + side * 1.14 * np.eye(16)[0] + draw.normal(size=(chunks * 8, 16)) * 0.02 for side in (0, 1)])  # near by, and in the same buckets
    pairs = []

    def counted(df):
        made = cut(df)
        if {"p", "q"} <= set(df.columns):
            pairs.append(made.count())
        return made

    cut = clusters.cut
    monkeypatch.setattr(clusters, "cut", counted)
    nodes = spark.createDataFrame([(i, f"n{i}", v.tolist(), 0) for i, v in enumerate(x)], SCHEMA).repartition(chunks)
    got = {r["node"]: r["cluster"] for r in similar_groups(nodes)[0].collect()}
    assert got == {i: int(w) for i, w in enumerate(brute(x.astype(np.float32)))} and len(set(got.values())) == 2
    assert max(pairs) <= 8 * chunks, "not every chunk's part against every other's"


@pytest.mark.parametrize("times", [2, 8])
def test_alike_vectors_share_a_stretch_and_few_others_do(times):
    draw, how = np.random.default_rng(2), Alike()
    x = draw.normal(size=(5_000, 16)) * 6
    step = draw.normal(size=x.shape)
    y = x + step / np.sqrt((step**2).sum(axis=1, keepdims=True)) * draw.uniform(0, 1, (len(x), 1))
    (i, k), (j, m) = clusters.stretches(x, how, times), clusters.stretches(y, how, times)
    mine, others = set(zip(i.tolist(), k.tolist(), strict=True)), set(zip(j.tolist(), m.tolist(), strict=True))
    assert len(mine) == len(i) and {r for r, _ in mine & others} == set(range(len(x)))
    assert len(mine & {((r + 1) % len(x), key) for r, key in others}) < len(x) * 0.6**times
    assert len(i) < len(x) * 1.2**times


def test_split_buckets_against_all_pairs(spark, monkeypatch):
    x = vectors()
    monkeypatch.setattr(clusters, "splits", lambda n: 8)
    nodes = spark.createDataFrame([(i, f"n{i}", v.tolist(), 0) for i, v in enumerate(x)], SCHEMA).repartition(5)
    assert {r["node"]: r["cluster"] for r in similar_groups(nodes, Alike(chunk=100))[0].collect()} == {i: int(w) for i, w in enumerate(brute(x))}


def test_empty_and_single(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert similar_groups(none)[0].count() == 0
    one = spark.createDataFrame([(5, "a", [1.0] * 16, 1)], SCHEMA)
    assert [tuple(r) for r in similar_groups(one)[0].collect()] == [(5, "a", 5)]


def test_usable(spark):
    rows = [[1.0] * 16, [0.0] * 16, None, [1.0] * 15, [1.0] * 15 + [None], [1.0] * 15 + [float("nan")], [1.0] * 15 + [float("inf")]]
    df = spark.createDataFrame([(r,) for r in rows], "v array<float>")
    assert [r[0] for r in df.select(usable(F.col("v"), 16)).collect()] == [True] + [False] * 6
