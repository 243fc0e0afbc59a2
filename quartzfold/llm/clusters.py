"""Problem 5: clusters of mutually similar vectors.

A vector becomes a set: for each dimension and each of several shifted grids, the cell it lies in. Close vectors share
nearly all cells, so MinHash banding over these sets finds the candidate pairs; the exact Jaccard similarity of the sets,
then the exact distance, verify them. Connected components of the verified links are the clusters.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzfold.llm.top_n import top_n
from quartzfold.operators.components import connected_components
from quartzfold.session import cut


@dataclass(frozen=True)
class Alike:
    """Two vectors are alike at a Euclidean distance of at most ``radius``.

    ``cell`` is the width of a grid cell, ``grids`` the number of shifted grids; ``bands`` of ``rows`` hashes each make
    the candidates. A pair at the full radius shares about 0.95 of its cells with these values and is missed by all
    bands about once in 10^4 (at 0.7 of it 1.3, at half of it 0.2 in 10^5); pairs with alike neighbours in common far
    less often.
    """

    dim: int = 16
    radius: float = 1.0
    cell: float = 4.0
    grids: int = 8
    bands: int = 14
    rows: int = 6
    seed: int = 1
    chunk: int = 32_768

    @property
    def least_jaccard(self) -> float:
        """No pair within the radius has a lower similarity: its coordinates differ by at most radius x sqrt(dim) in all."""
        differ = min(self.radius * math.sqrt(self.dim) * self.grids / self.cell + self.dim, self.dim * self.grids)
        return (self.dim * self.grids - differ) / (self.dim * self.grids + differ)


def usable(vector: Column, dim: int) -> Column:
    """Whether the vector has ``dim`` finite values that are not all zero; false for null."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def cells(x: np.ndarray, how: Alike) -> np.ndarray:
    """The cell of each row in each dimension and grid, as (rows, dim x grids) integers."""
    shift = np.arange(how.grids) * (how.cell / how.grids)
    return np.floor((x[:, :, None] + shift) / how.cell).astype(np.int64).reshape(len(x), -1)


def band_keys(c: np.ndarray, how: Alike) -> np.ndarray:
    """The key of each row in each band, as (rows, bands) 64-bit integers."""
    random = np.random.default_rng(how.seed)
    width = c.shape[1]
    xor, odd = (random.integers(0, 2**32, how.bands * how.rows, dtype=np.uint32) for _ in range(2))
    mix = random.integers(0, 2**63, how.bands * how.rows, dtype=np.uint64) | np.uint64(1)
    out = np.empty((len(c), how.bands), np.int64)
    with np.errstate(over="ignore"):
        token = (c.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        token = (token ^ (token >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        token = (token >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(c), 512):
            t = np.ascontiguousarray(token[at : at + 512].T)
            for b in range(how.bands):
                key = np.full(t.shape[1], b + 1, np.uint64)
                for k in range(b * how.rows, (b + 1) * how.rows):
                    least = ((t ^ xor[k]) * (odd[k] | np.uint32(1))).min(axis=0)
                    key = (key ^ least) * mix[k]
                    key ^= key >> np.uint64(31)
                out[at : at + 512, b] = key.view(np.int64)
    return out


def splits(n: int) -> int:
    """How many directions split the buckets of ``n`` vectors: one more for each doubling, since false company in a bucket grows with the table."""
    return min(max(round(math.log2(max(n, 1) / 2**17)), 2), 8)


def stretches(x: np.ndarray, how: Alike, times: int) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of space each row lies in, as rows and 64-bit keys, a row and key at most once.

    Each of ``times`` orthogonal directions falls into stretches of eight times the radius, and a row within the radius
    of the next stretch counts there too. So two alike rows always share a key, and few others do.
    """
    along = x @ np.linalg.qr(np.random.default_rng(how.seed).normal(size=(how.dim, how.dim)))[0]
    edge = how.radius * (1 + 1e-6) + 1e-12 * np.sqrt((x**2).sum(axis=1))
    width = 8 * how.radius
    at = np.arange(len(x))
    key = np.zeros(len(x), np.uint64)
    for d in range(min(times, how.dim)):
        place = np.floor(along[:, d] / width)
        next_too = (place + 1) * width - along[:, d] <= edge
        place = place.astype(np.int64)[at]
        more = next_too[at]
        at, place, key = np.r_[at, at[more]], np.r_[place, place[more] + 1], np.r_[key, key[more]]
        key = (key ^ place.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return at, key


def alike(x: np.ndarray, y: np.ndarray, how: Alike) -> np.ndarray:
    """Which pairs of rows are alike, by the Jaccard similarity of their sets and by distance."""
    same = (cells(x, how) == cells(y, how)).sum(axis=1)
    jaccard = same / (2 * how.dim * how.grids - same)
    return (jaccard >= how.least_jaccard) & (((x - y) ** 2).sum(axis=1) <= how.radius**2)


def _matrix(v: pa.Array, dim: int) -> np.ndarray:
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index connected to each of ``n``."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        np.minimum.at(label, before[a], least)
        np.minimum.at(label, before[b], least)
        label = label[label]
        if (label == before).all():
            break
    return label


def _local(nodes: np.ndarray, x: np.ndarray, names: pa.Array, how: Alike, times: int) -> pa.RecordBatch:
    order = np.argsort(nodes)
    nodes, x, names = nodes[order], x[order], names.take(pa.array(order))
    n = len(nodes)
    keys = band_keys(cells(x, how), how)
    pairs = []
    for b in range(how.bands):
        by = np.argsort(keys[:, b], kind="stable")
        k = keys[by, b]
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        leader = by[np.repeat(starts, np.diff(np.r_[starts, n]))]
        pairs.append((by * n + leader)[by != leader])
    member, leader = np.divmod(np.unique(np.concatenate(pairs)), n)
    keep = np.concatenate([alike(x[member[i : i + 50_000]], x[leader[i : i + 50_000]], how) for i in range(0, len(member), 50_000)] or [np.zeros(0, bool)])
    member, leader = member[keep], leader[keep]
    root = _components(n, member, leader)
    # a component counts once in each band, key and stretch, by its first member there
    who, stretch = stretches(x, how, times)
    bucket, at = [], []
    for b in range(how.bands):
        key = (keys[who, b].view(np.uint64) ^ stretch) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(31)
        by = np.lexsort((who, root[who], key))
        k, r = key[by], root[who][by]
        first = by[np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (r[1:] != r[:-1])])]
        bucket.append(key[first].view(np.int64))
        at.append(who[first])
    bucket, at = np.concatenate(bucket), np.concatenate(at)
    heads, group, size = np.unique(root, return_inverse=True, return_counts=True)
    centre = np.stack([np.bincount(group, x[:, d]) / size for d in range(how.dim)], axis=1)
    reach = np.zeros(len(heads))
    np.maximum.at(reach, group, np.sqrt(((x - centre[group]) ** 2).sum(axis=1)))
    kind = np.repeat(np.array([0, 1, 2, 3], np.int8), [n, len(member), len(at), len(heads)])
    a = np.concatenate([nodes, nodes[member], nodes[at], nodes[heads]])
    b = np.concatenate([nodes[root], nodes[leader], nodes[root[at]], nodes[heads]])
    key = np.concatenate([np.zeros(n + len(member), np.int64), bucket, np.zeros(len(heads), np.int64)])
    before, after = len(kind) - len(heads), len(kind) - n
    ball = pa.concat_arrays([pa.nulls(before, pa.list_(pa.float64())), pa.FixedSizeListArray.from_arrays(pa.array(centre.ravel()), how.dim).cast(pa.list_(pa.float64()))])
    return pa.RecordBatch.from_arrays(
        [pa.array(kind), pa.array(key), pa.array(a), pa.array(b), pa.concat_arrays([names, pa.nulls(after, pa.string())]), ball, pa.concat_arrays([pa.nulls(before, pa.float64()), pa.array(reach)])],
        ["kind", "key", "a", "b", "name", "centre", "reach"],
    )


def _banded(nodes: DataFrame, how: Alike, times: int) -> DataFrame:
    """Rows of four kinds: 0 node a (by name) and its root b within its chunk, 1 alike pair a, b, 2 key of band and stretch with node a of root b, 3 the ball around the members of root a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= how.chunk:
                yield whole(held)
                held, n = [], 0
        if n:
            yield whole(held)

    def whole(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        node, vector, name = (c.chunk(0) for c in t.columns)
        return _local(node.to_numpy(), _matrix(vector, how.dim), name, how, times)

    return nodes.select("node", "vector", "name").mapInArrow(run, "kind tinyint, key bigint, a bigint, b bigint, name string, centre array<double>, reach double")


def _verified(pairs: DataFrame, nodes: DataFrame, how: Alike) -> DataFrame:
    """The pairs a, b whose vectors are alike; other columns are kept."""
    others = [c for c in pairs.columns if c not in ("a", "b")]
    kinds = dict(pairs.dtypes)
    va = nodes.select(F.col("node").alias("a"), F.col("vector").alias("_x"))
    vb = nodes.select(F.col("node").alias("b"), F.col("vector").alias("_y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = alike(_matrix(batch.column("_x"), how.dim), _matrix(batch.column("_y"), how.dim), how)
            yield batch.select(["a", "b", *others]).filter(pa.array(keep))

    schema = ", ".join(f"{c} {kinds[c]}" for c in ["a", "b", *others])
    return pairs.join(va, "a").join(vb, "b").select("a", "b", *others, "_x", "_y").mapInArrow(run, schema)


def _across(shared: DataFrame, banded: DataFrame, merged: DataFrame, nodes: DataFrame, how: Alike) -> DataFrame:
    """Links between components that share a bucket and are still apart: all their members are held against each other.

    Only components whose balls (centre, reach) come near enough, and of these only members near enough to the other's
    ball, in neighbouring slabs between the two, can hold an alike pair; so nothing is left out. p and q are whole
    components, not their parts in chunks: of two that many chunks repeat, one pair is looked at.
    """
    dims = range(how.dim)
    by = lambda v, w: F.sqrt(sum(((v[i] - w[i]) * (v[i] - w[i]) for i in dims), F.lit(0.0)))
    apart = shared.select("key", "root").join(merged, "root", "left").select("key", F.coalesce("component", "root").alias("component"))
    many = apart.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    members = cut(apart.join(many, "key").distinct())
    near = members.select("key", F.col("component").alias("p")).join(members.select("key", F.col("component").alias("q")), "key").where("p < q").select("p", "q").distinct()
    # a component is named by its least root: the ball around that root's centre that holds the balls of all its roots
    balls = banded.where("kind = 3").select(F.col("a").alias("component"), "centre", "reach")
    parts = balls.withColumnRenamed("component", "root").join(merged, "root").join(balls.select("component", F.col("centre").alias("middle")), "component")
    whole = parts.groupBy("component").agg(F.max(by(F.col("centre"), F.col("middle")) + F.col("reach")).alias("whole"))
    balls = balls.join(whole, "component", "left").select("component", "centre", F.coalesce("whole", "reach").alias("reach"))
    bp, bq = (balls.select(F.col("component").alias(r), F.col("centre").alias(f"c{r}"), F.col("reach").alias(f"r{r}")) for r in "pq")
    slack = how.radius + 1e-9
    close = cut(near.join(bp, "p").join(bq, "q").where(by(F.col("cp"), F.col("cq")) <= F.col("rp") + F.col("rq") + slack))
    if close.isEmpty():
        return banded.where("false").select("a", "b", F.col("a").alias("p"), F.col("b").alias("q"))
    touched = close.select(F.col("p").alias("component")).unionByName(close.select(F.col("q").alias("component"))).distinct()
    touched = merged.join(touched, "component").select("root", "component").unionByName(touched.select(F.col("component").alias("root"), "component")).distinct()
    inside = banded.where("kind = 0").select(F.col("a").alias("node"), F.col("b").alias("root")).join(touched, "root")
    # equal vectors of a component are one member
    inside = cut(inside.join(nodes.select("node", "vector"), "node").groupBy("component", "vector").agg(F.min("node").alias("node")))
    # along the line between two centres alike members are no further apart than the radius, so only neighbouring slabs pair
    length = F.greatest(by(F.col("cp"), F.col("cq")), F.lit(1e-9))
    along = sum(((F.col("vector")[i] - F.col("cp")[i]) * (F.col("cq")[i] - F.col("cp")[i]) for i in dims), F.lit(0.0)) / length
    slab = F.floor(along / (how.radius * (1 + 1e-6))).alias("slab")
    member = lambda r, c, reach: close.join(inside.select(F.col("component").alias(r), "node", "vector"), r).where(by(F.col("vector"), F.col(c)) <= F.col(reach) + slack).select("p", "q", slab, "node")
    left = member("p", "cq", "rq").withColumnRenamed("node", "a").withColumn("slab", F.explode(F.array(*[F.col("slab") + k for k in (-1, 0, 1)])))
    pairs = left.join(member("q", "cp", "rp").withColumnRenamed("node", "b"), ["p", "q", "slab"])
    return _verified(pairs.select("a", "b", "p", "q"), inside, how).select("a", "b", "p", "q")


def similar_groups(nodes: DataFrame, how: Alike = Alike()) -> tuple[DataFrame, DataFrame]:
    """Clusters of all that is connected through alike pairs: labels (node, name, cluster) and the links found (a, b).

    ``nodes``: node (bigint, unique), name, vector (array of ``dim`` finite values). Every node has a label, the least
    node of its cluster, also if it is alone. Equal vectors are alike; an empty table gives empty results.

    Where nodes are read, those of one chunk that share a band key are held against its first node, and components
    within the chunk are found; each brings one row per key to the shuffle, so a key with a third of all rows shrinks
    first. Keys of bands are split along ``splits`` directions, without loss, so that unlike vectors rarely meet however
    many there are. Across chunks, components that share a key are held against the first of the key by one pair of members.
    Those that stay apart are compared member by member within the reach of their balls; no candidate is left out.
    """
    banded = cut(_banded(nodes, how, splits(nodes.count())))
    bucket = banded.where("kind = 2").select("key", "a", F.col("b").alias("root"))
    first = bucket.groupBy("key").agg(F.min(F.struct("root", "a")).alias("first"), F.max("root").alias("last")).where("first.root < last").drop("last")
    shared = cut(bucket.join(first, "key").select("key", "a", "root", F.col("first.a").alias("b"), F.col("first.root").alias("q")))
    star = shared.where("root <> q").groupBy(F.col("root").alias("p"), "q").agg(F.min(F.struct("a", "b")).alias("pair")).select("pair.a", "pair.b", "p", "q")
    links = cut(_verified(star, nodes, how))
    merged = connected_components(links.select(F.col("p").alias("a"), F.col("q").alias("b"))).select(F.col("node").alias("root"), "component")
    more = cut(_across(shared, banded, merged, nodes, how))
    if not more.isEmpty():
        # labels so far are stars of their own: only components need joining
        joined = connected_components(more.select(F.col("p").alias("a"), F.col("q").alias("b")))
        again = joined.select(F.col("node").alias("component"), F.col("component").alias("whole"))
        merged = (
            merged.join(again, "component", "left").select("root", F.coalesce("whole", "component").alias("component"))
            .unionByName(again.join(merged, "component", "left_anti").select(F.col("component").alias("root"), F.col("whole").alias("component")))
        )
        links = links.unionByName(more)
    labels = banded.where("kind = 0").select(F.col("a").alias("node"), F.col("b").alias("root"), "name").join(merged, "root", "left").select("node", "name", F.coalesce("component", "root").alias("cluster"))
    return labels, banded.where("kind = 1").select("a", "b").unionByName(links.select("a", "b"))


def _facing(x: np.ndarray, y: np.ndarray, how: Alike) -> Iterator[tuple[slice, np.ndarray]]:
    """Which of all pairs of rows of two blocks are within the radius, for slices of the first; pairs at the limit are computed exactly."""
    x, y = x - y[0], y - y[0]
    xx, yy = (x**2).sum(axis=1), (y**2).sum(axis=1)
    for at in range(0, len(x), 512):
        rows = slice(at, at + 512)
        over = xx[rows, None] + yy - 2 * (x[rows] @ y.T) - how.radius**2
        slack = 1e-9 * (1 + xx[rows].max() + yy.max())
        hit = over < -slack
        i, j = np.nonzero(np.abs(over) <= slack)
        hit[i, j] = ((x[rows][i] - y[j]) ** 2).sum(axis=1) <= how.radius**2
        yield rows, hit


def _by_blocks(members: DataFrame, how: Alike, block: int, best: bool) -> DataFrame:
    """What each member (cluster, node, weight, n, vector) meets among all alike members of its cluster, itself included.

    Without ``best`` node and n, the sum of their weights; with it node and medoid, the one with the greatest n (equal
    ones: the least node). A cluster of more than ``block`` members falls into slabs along its widest dimension, of which
    only neighbours can hold alike pairs, and these into blocks by hash; each two blocks are one unit of work. Small
    clusters share units.
    """
    dims = range(how.dim)
    wide = F.array(*[F.max(F.col("vector")[i]) - F.min(F.col("vector")[i]) for i in dims])
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), wide.alias("wide")).select("cluster", "size", (F.array_position("wide", F.array_max("wide")) - 1).cast("int").alias("axis"))
    placed = members.join(sizes, "cluster")
    small = placed.where(F.col("size") <= block)
    lots = max(1, small.count() // block)
    shared = small.select(F.pmod(F.xxhash64("cluster"), F.lit(lots)).alias("lot"), *[F.lit(-1).cast("bigint").alias(c) for c in ("s", "t")], *[F.lit(0).alias(c) for c in ("p", "q")], F.lit(True).alias("left"), F.lit(True).alias("right"), "cluster", "node", "weight", "n", "vector")
    slab = placed.where(F.col("size") > block).withColumn("slab", F.floor(F.element_at("vector", F.col("axis") + 1) / (how.radius * (1 + 1e-6))).cast("bigint"))
    many = slab.groupBy("cluster", "slab").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    slab = slab.join(many, ["cluster", "slab"]).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = many.select("cluster", F.col("slab").alias("oslab"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("oblock"))
    sent = slab.withColumn("oslab", F.explode(F.array(*[F.col("slab") + k for k in (-1, 0, 1)]))).join(other, ["cluster", "oslab"])
    own, far = F.struct(F.col("slab").alias("s"), F.col("mine").alias("p")), F.struct(F.col("oslab").alias("s"), F.col("oblock").alias("p"))
    lo, hi = F.least(own, far), F.greatest(own, far)
    apart = sent.select(F.col("cluster").alias("lot"), lo["s"].alias("s"), hi["s"].alias("t"), lo["p"].alias("p"), hi["p"].alias("q"), (own == lo).alias("left"), (own == hi).alias("right"), "cluster", "node", "weight", "n", "vector")

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        cluster, node, weight, n, left, right = (t[c].to_numpy() for c in ("cluster", "node", "weight", "n", "left", "right"))
        x = _matrix(t["vector"].chunk(0), how.dim)
        order = np.argsort(cluster, kind="stable")
        nodes, found = [], []
        for own in np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1):
            sides = [own[left[own]], own[right[own]]]
            if not (len(sides[0]) and len(sides[1])):
                continue
            for a, b in [sides] if np.array_equal(*sides) else [sides, sides[::-1]]:
                b = b[np.lexsort((node[b], -n[b]))]
                for rows, hit in _facing(x[a], x[b], how):
                    some = hit.any(axis=1)
                    nodes.append(node[a[rows]][some])
                    found.append(b[hit[some].argmax(axis=1)] if best else hit[some] @ weight[b])
        nodes, found = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (nodes, found))
        return pa.table({"node": nodes, "n": n[found], "medoid": node[found]} if best else {"node": nodes, "n": found})

    each = shared.unionByName(apart).groupBy("lot", "s", "t", "p", "q").applyInArrow(run, "node bigint, n bigint, medoid bigint" if best else "node bigint, n bigint")
    if not best:
        return each.groupBy("node").agg(F.sum("n").alias("n"))
    return each.groupBy("node").agg((-F.max(F.struct("n", (-F.col("medoid")).alias("who")))["who"]).alias("medoid"))


def loose_parts(labels: DataFrame, links: DataFrame, nodes: DataFrame, how: Alike = Alike(), block: int = 4096) -> DataFrame:
    """``node``, ``cluster`` and ``part``: loose clusters are split around the medoids with the most alike members.

    A cluster is loose if a member lies further than the radius from its mean. There each member follows the node with
    the most alike members among itself and those it is alike to (equal numbers: the least node); a compact cluster is
    one part, named by its label. ``links`` join clusters, but most end at the first of a bucket: they are not used.

    All pairs of a loose cluster count, held against each other in blocks, with equal vectors as one weighted member. The
    work grows with the square of the different vectors in a slab of a loose cluster, in units of ``block``.
    """
    dims = range(how.dim)
    placed = labels.join(nodes.select("node", "vector"), "node")
    mean = placed.groupBy("cluster").agg(F.array(*[F.avg(F.col("vector")[i]) for i in dims]).alias("centre"))
    off = F.sqrt(sum(((F.col("vector")[i] - F.col("centre")[i]) * (F.col("vector")[i] - F.col("centre")[i]) for i in dims), F.lit(0.0)))
    loose = cut(placed.join(mean, "cluster").groupBy("cluster").agg(F.max(off).alias("reach")).where(F.col("reach") > how.radius).select("cluster", F.lit(True).alias("loose")))
    inside = placed.join(loose, "cluster").select("cluster", "node", F.col("vector").cast("array<double>").alias("vector"))
    inside = cut(inside)
    members = cut(inside.groupBy("cluster", "vector").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("weight")).withColumn("n", F.lit(0).cast("bigint")))
    degree = _by_blocks(members, how, block, False)
    ranked = cut(members.drop("n").join(degree, "node"))
    medoid = members.select("cluster", "vector", "node").join(_by_blocks(ranked, how, block, True), "node").drop("node")
    medoid = inside.join(medoid, ["cluster", "vector"]).select("node", "medoid")
    return labels.join(loose, "cluster", "left").join(medoid, "node", "left").select("node", "name", "cluster", F.when(F.col("loose"), F.coalesce("medoid", "node")).otherwise(F.col("cluster")).alias("part"))


def typical(labels: DataFrame, nodes: DataFrame, n: int = 3, how: Alike = Alike()) -> DataFrame:
    """Per cluster its size and the ``n`` members nearest to its mean, nearest first (equal distances: the least name).

    Distances are rounded to 9 digits, so that the order of summation doesn't matter.
    """
    dims = range(how.dim)
    placed = labels.join(nodes.select("node", "vector"), "node")
    mean = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.array(*[F.avg(F.col("vector")[i]) for i in dims]).alias("centre"))
    off = F.sqrt(sum(((F.col("vector")[i] - F.col("centre")[i]) * (F.col("vector")[i] - F.col("centre")[i]) for i in dims), F.lit(0.0)))
    best = top_n(placed.join(mean, "cluster").select("cluster", "name", F.round(off, 9).alias("off")), ["cluster"], "off", "name", n)
    names = best.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda s: s["name"]).alias("typical"))
    return mean.select("cluster", "size").join(names, "cluster")
