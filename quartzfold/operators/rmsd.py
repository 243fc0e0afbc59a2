"""Distances between structures after superposition, and single-linkage clusters at a fixed cutoff."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzfold.operators.components import connected_components


def superpose(fixed: np.ndarray, moving: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotation (n, 3, 3) and shift (n, 3) that bring each ``moving`` (n, atoms, 3) onto ``fixed``; no reflections."""
    cf, cm = fixed.mean(axis=1, keepdims=True), moving.mean(axis=1, keepdims=True)
    u, _, vt = np.linalg.svd(np.einsum("nai,naj->nij", moving - cm, fixed - cf))
    sign = np.sign(np.linalg.det(u @ vt))
    u[:, :, -1] *= np.where(sign == 0, 1, sign)[:, None]
    rotation = u @ vt
    return rotation, (cf - cm @ rotation)[:, 0]


def rmsd(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Root mean square distance of each pair of structures (n, atoms, 3) after superposition."""
    rotation, shift = superpose(x, y)
    return np.sqrt((((y @ rotation + shift[:, None]) - x) ** 2).sum(axis=2).mean(axis=1))


def distances(points: np.ndarray, others: np.ndarray, superposed: bool) -> np.ndarray:
    """All distances between two blocks of structures; Euclidean ones of flat vectors without superposition."""
    if not superposed:
        step = max(1, 2**22 // max(1, others.size))  # bounds the differences held at once
        return np.concatenate([np.sqrt(((points[i : i + step, None] - others[None]) ** 2).sum(axis=2)) for i in range(0, len(points), step)])
    x, y = points.reshape(len(points), -1, 3), others.reshape(len(others), -1, 3)
    step = max(1, 2**18 // max(1, len(y)))  # bounds the 3 x 3 matrices held at once
    return np.concatenate([_superposed(x[i : i + step], y) for i in range(0, len(x), step)])


def _superposed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All superposed distances of two blocks from the singular values of their products, without turning any structure.

    Nearly equal structures would lose digits that way, so their distances are computed on the turned ones.
    """
    x, y = x - x.mean(axis=1, keepdims=True), y - y.mean(axis=1, keepdims=True)
    h = np.tensordot(x, y, axes=(1, 1)).transpose(0, 2, 1, 3)
    s = np.linalg.svd(h, compute_uv=False)
    s[..., 2] *= np.where(np.linalg.det(h) < 0, -1, 1)
    whole = (x**2).sum(axis=(1, 2))[:, None] + (y**2).sum(axis=(1, 2))
    square = np.maximum(whole - 2 * s.sum(axis=2), 0)
    out = np.sqrt(square / x.shape[1])
    i, j = np.nonzero(square < 1e-5 * whole)
    for at in range(0, len(i), 4096):
        k = slice(at, at + 4096)
        out[i[k], j[k]] = rmsd(x[i[k]], y[j[k]])
    return out


def block_pairs(structures: DataFrame, block: int) -> DataFrame:
    """Rows of ``structures`` (group_id, item) for each unit of work: ``mine``, the row's block by hash, and the unit's blocks ``p`` <= ``q``."""
    sizes = structures.groupBy("group_id").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    placed = structures.join(sizes, "group_id").withColumn("mine", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int"))
    # an item goes to its own block's row and column of the triangle of block pairs
    each = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return each.select(*structures.columns, F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "mine")


def near_blocks(structures: DataFrame, cutoff: float, superposed: bool, block: int) -> DataFrame:
    """Rows of ``structures`` for each unit of work as in ``block_pairs``, but only for blocks that can hold pairs within ``cutoff``.

    Distances to one structure of the group (a pivot: its first item) differ by no more than the distance of the two. So
    a group falls into slabs of the cutoff's width, of which only neighbours pair, and these into blocks by hash: an item
    goes to the blocks of three slabs, however large its group. ``p`` <= ``q`` name slab and block. Structures of another
    length than the pivot are slabs of their own length.
    """
    kind = dict(structures.dtypes)["group_id"]
    pivot = structures.groupBy("group_id").agg(F.min(F.struct("item", "coords"))["coords"].alias("fixed"))
    pivot = pivot.select("group_id", F.when(F.size("fixed") > 0, F.col("fixed")).alias("fixed"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            off, sizes = np.zeros(len(pdf)), pdf.coords.map(len)
            same = sizes == pdf.fixed.map(lambda f: 0 if f is None else len(f))
            for n in sizes[same].unique():
                at = np.flatnonzero(same & (sizes == n))
                if n:
                    x, y = np.stack(pdf.fixed.iloc[at]).astype(float), np.stack(pdf.coords.iloc[at]).astype(float)
                    off[at] = rmsd(x.reshape(len(at), -1, 3), y.reshape(len(at), -1, 3)) if superposed else np.sqrt(((x - y) ** 2).sum(axis=1))
            yield pdf[["group_id", "item", "coords"]].assign(slab=np.floor(off / (cutoff * (1 + 1e-6) + 1e-9)).astype(np.int64), n=sizes)

    slabs = structures.join(pivot, "group_id").select("group_id", "item", "coords", "fixed").mapInPandas(run, f"group_id {kind}, item {dict(structures.dtypes)['item']}, coords {dict(structures.dtypes)['coords']}, slab bigint, n int")
    many = slabs.groupBy("group_id", "n", "slab").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    placed = slabs.join(many, ["group_id", "n", "slab"]).withColumn("mine", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int"))
    other = many.select("group_id", "n", F.col("slab").alias("oslab"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("oblock"))
    sent = placed.withColumn("oslab", F.explode(F.array(*[F.col("slab") + k for k in (-1, 0, 1)]))).join(other, ["group_id", "n", "oslab"])
    own, far = F.struct("n", F.col("slab").alias("slab"), F.col("mine").alias("block")), F.struct("n", F.col("oslab").alias("slab"), F.col("oblock").alias("block"))
    return sent.select("group_id", "item", "coords", F.least(own, far).alias("p"), F.greatest(own, far).alias("q"), (own == F.least(own, far)).alias("left"), (own == F.greatest(own, far)).alias("right"))


def close_pairs(structures: DataFrame, cutoff: float, superposed: bool = True, block: int = 256) -> DataFrame:
    """Pairs a < b of one group within ``cutoff``: group_id, a, b.

    ``structures``: group_id, item (bigint, unique), coords (array of numbers; those of other lengths never pair). Each two
    blocks that can hold such pairs are one unit of work, so a large group spreads over many tasks, and only pairs
    within the cutoff come out.
    """

    def pairs(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf.left], pdf[pdf.right]
        out = pd.DataFrame({"a": [], "b": []})
        if len(left) and len(right) and len(left.coords.iloc[0]):
            d = distances(np.stack(left.coords), np.stack(right.coords), superposed)
            i, j = np.nonzero(d <= cutoff)
            a, b = left.item.to_numpy()[i], right.item.to_numpy()[j]
            out = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})[a != b].drop_duplicates()
        return out.assign(group_id=key[0])[["group_id", "a", "b"]]

    kind = dict(structures.dtypes)["group_id"]
    return near_blocks(structures, cutoff, superposed, block).groupBy("group_id", "p", "q").applyInPandas(pairs, f"group_id {kind}, a bigint, b bigint")


def single_linkage(structures: DataFrame, cutoff: float, superposed: bool = True) -> DataFrame:
    """group_id, item, cluster (the least item of the cluster): items joined by steps of at most ``cutoff`` within a group."""
    found = connected_components(close_pairs(structures, cutoff, superposed).select("a", "b"))
    return structures.select("group_id", "item").join(found, F.col("item") == F.col("node"), "left").select("group_id", "item", F.coalesce("component", "item").alias("cluster"))


def rmsd_to(reference: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """``members`` (key, item, coords) with ``rmsd`` to their key's ``reference`` (key, coords); null for other lengths."""
    kinds = dict(members.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = np.full(len(pdf), np.nan)
            sizes = pdf.coords.map(len)
            for n in sizes[sizes == pdf.fixed.map(len)].unique():
                at = np.flatnonzero((sizes == n) & (pdf.fixed.map(len) == n))
                if n:
                    out[at] = rmsd(np.stack(pdf.fixed.iloc[at]).reshape(len(at), -1, 3), np.stack(pdf.coords.iloc[at]).reshape(len(at), -1, 3))
            yield pd.DataFrame({key: pdf[key], "item": pdf["item"], "rmsd": out})

    joined = members.join(reference.select(key, F.col("coords").alias("fixed")), key).select(key, "item", "coords", "fixed")
    out = joined.mapInPandas(run, f"`{key}` {kinds[key]}, item {kinds['item']}, rmsd double")
    return out.withColumn("rmsd", F.when(~F.isnan("rmsd"), F.col("rmsd")))
