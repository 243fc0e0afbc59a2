"""Agglomerative clusters of the structures of a template, with the cutoff chosen by silhouette."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzfold.operators.blocks import cluster_large, label_sums, quantiles
from quartzfold.operators.rmsd import distances


@dataclass(frozen=True)
class ClusterSpec:
    """``most`` bounds the structures of a group whose distances one task may hold; larger groups are clustered in blocks, with the same result."""

    linkage: str = "single"
    cutoffs: int = 50
    low: float = 0.05
    high: float = 0.95
    least: int = 2
    greatest: int = 20
    fixed: float | None = None
    superposed: bool = True
    most: int = 5000

    def __post_init__(self) -> None:
        if self.linkage not in ("single", "complete", "average"):
            raise ValueError("linkage must be single, complete or average")


def merges(d: np.ndarray, linkage: str) -> list[tuple[float, int, int]]:
    """The merges of an agglomerative clustering as (height, kept, gone) of item numbers, nearest clusters first."""
    d, n, out = d.astype(float).copy(), len(d), []
    np.fill_diagonal(d, np.inf)
    size, near = np.ones(n), d.argmin(axis=1)
    best = d[np.arange(n), near]
    for _ in range(n - 1):
        i = int(best.argmin())
        j = int(near[i])
        i, j = min(i, j), max(i, j)
        out.append((float(d[i, j]), i, j))
        a, b = d[i], d[j]
        new = np.minimum(a, b) if linkage == "single" else np.maximum(a, b) if linkage == "complete" else (a * size[i] + b * size[j]) / (size[i] + size[j])
        new[[i, j]] = np.inf
        size[i] += size[j]
        d[i], d[:, i], d[j], d[:, j] = new, new, np.inf, np.inf
        stale = np.flatnonzero((near == i) | (near == j) | (np.arange(n) == i))
        near[stale] = d[stale].argmin(axis=1)
        best[stale] = d[stale, near[stale]]
        closer = np.flatnonzero(new < best)
        near[closer], best[closer] = i, new[closer]
        best[j] = np.inf
    return out


def labels_at(steps: list[tuple[float, int, int]], n: int, cutoff: float) -> np.ndarray:
    """Labels from 1, in order of each cluster's first item, after all merges up to ``cutoff``."""
    head, highest = np.arange(n), 0.0
    for height, kept, gone in steps:
        highest = max(highest, height)  # heights never fall along a path to the root
        if highest <= cutoff:
            head[head == gone] = kept
    return np.unique(head, return_inverse=True)[1] + 1


def silhouette(d: np.ndarray, labels: np.ndarray) -> float:
    """The mean of (b - a) / max(a, b) over items, 0 for an item alone in its cluster."""
    return silhouette_of(d @ (labels[:, None] == np.arange(1, labels.max() + 1)).astype(float), labels)


def silhouette_of(total: np.ndarray, labels: np.ndarray) -> float:
    """The silhouette from the sums of each item's distances by label."""
    size = np.bincount(labels - 1).astype(float)
    own = labels - 1
    rows = np.arange(len(total))
    alone = size[own] == 1
    a = total[rows, own] / np.maximum(size[own] - 1, 1)
    mean = total / size
    mean[rows, own] = np.inf
    b = mean.min(axis=1)
    top = np.maximum(a, b)
    return float(np.where(alone | (top == 0), 0, (b - a) / np.where(top == 0, 1, top)).mean())


def medoids(d: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Whether each item is its cluster's medoid: the least sum of distances, rounded to 9 digits, the first of equal ones."""
    out = np.zeros(len(d), bool)
    for c in np.unique(labels):
        at = np.flatnonzero(labels == c)
        out[at[np.round(d[np.ix_(at, at)].sum(axis=1), 9).argmin()]] = True
    return out


def cutoff_search(d: np.ndarray, spec: ClusterSpec) -> tuple[float, float | None, np.ndarray]:
    """The cutoff of the best silhouette (the lowest of equal ones), that silhouette, and the labels.

    Cutoffs are evenly spaced between two quantiles of the distances; those with too few or too many clusters don't
    count; if none counts, the last one, with a null silhouette.
    """
    n, steps = len(d), merges(d, spec.linkage)
    if spec.fixed is not None:
        return spec.fixed, None, labels_at(steps, n, spec.fixed)
    upper = d[np.triu_indices(n, 1)]
    upper = upper[np.isfinite(upper)]
    low, high = np.quantile(upper, [spec.low, spec.high]) if len(upper) else (0.0, 0.0)
    tried = np.linspace(low, high, spec.cutoffs) if high > low else np.array([low])
    best = (float(tried[-1]), None, labels_at(steps, n, tried[-1]))
    for cutoff in tried:
        labels = labels_at(steps, n, cutoff)
        if spec.least <= labels.max() <= min(spec.greatest, n - 1):
            s = silhouette(d, labels)
            if best[1] is None or s > best[1]:
                best = (float(cutoff), s, labels)
    return best


OUT = "cluster_id int, is_medoid boolean, cutoff double, silhouette double, n_clusters int, note string"


def cluster_groups(structures: DataFrame, spec: ClusterSpec = ClusterSpec()) -> DataFrame:
    """One row per structure (group_id, item, coords): its cluster, whether it is the medoid, the cutoff, and a note.

    Items are taken in their own order. Groups with fewer than two structures or with unequal lengths get null clusters
    and the reason as note; no group fails another, and none is too large.
    """
    kinds = dict(structures.dtypes)
    sized = structures.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.size("coords")).alias("lengths"))
    note = F.when(F.col("n") < 2, "too_few_structures").when(F.col("lengths") > 1, "cluster_failed: structures differ in length")
    noted = structures.join(sized.select("group_id", note.alias("note"), (F.col("n") > spec.most).alias("large")), "group_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item")
        x = np.stack(pdf.coords)
        d = distances(x, x, spec.superposed)
        d = (d + d.T) / 2
        np.fill_diagonal(d, 0)
        cutoff, s, labels = cutoff_search(d, spec)
        return pdf[["group_id", "item"]].assign(cluster_id=labels, is_medoid=medoids(d, labels), cutoff=cutoff, silhouette=s, n_clusters=int(labels.max()), note="")

    done = noted.where("note is null and not large").select("group_id", "item", "coords").groupBy("group_id").applyInPandas(run, f"group_id {kinds['group_id']}, item {kinds['item']}, {OUT}")
    rest = noted.where("note is not null").selectExpr("group_id", "item", "cast(null as int) cluster_id", "cast(null as boolean) is_medoid", "cast(null as double) cutoff", "cast(null as double) silhouette", "cast(null as int) n_clusters", "note")
    done = done.unionByName(rest)
    large = noted.where("note is null and large").select("group_id", "item", "coords")
    return done if large.isEmpty() else done.unionByName(cluster_large(large, spec, silhouette_of))


def distance_summary(structures: DataFrame, spec: ClusterSpec = ClusterSpec()) -> DataFrame:
    """Per group the number of pairs, the mean distance and the two quantiles between which cutoffs are sought; groups above ``spec.most`` are held against each other in blocks."""
    kinds = dict(structures.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.coords)
        d = distances(x, x, spec.superposed)[np.triu_indices(len(x), 1)]
        low, high = np.quantile(d, [spec.low, spec.high])
        return pd.DataFrame({"group_id": [pdf.group_id.iloc[0]], "n_pairs": [len(d)], "mean_distance": [d.mean()], "low_cutoff": [low], "high_cutoff": [high]})

    schema = f"group_id {kinds['group_id']}, n_pairs bigint, mean_distance double, low_cutoff double, high_cutoff double"
    sized = structures.join(structures.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")), "group_id")
    pick = lambda where: sized.where(where).select("group_id", "item", "coords")
    done, large = pick(f"n between 2 and {spec.most}").groupBy("group_id").applyInPandas(run, schema), pick(f"n > {max(spec.most, 1)}")
    if large.isEmpty():
        return done
    return done.unionByName(structures.sparkSession.createDataFrame([(g, *v) for g, v in quantiles(large, [spec.low, spec.high], spec.superposed).items()], schema))


def label_quality(structures: DataFrame, spec: ClusterSpec = ClusterSpec()) -> DataFrame:
    """Per group (group_id, item, label, coords) the silhouette of given labels and each label's medoid: group_id, label, size, medoid, silhouette.

    Sums of distances by item and label come from pairs of blocks; an item alone in its label counts 0. With one label,
    or as many as items, the silhouette is null. A group of any size is never gathered.
    """
    by = ["group_id", "item", "label"]
    sizes = structures.groupBy("group_id", "label").agg(F.count(F.lit(1)).alias("size"))
    total = label_sums(structures.select(*by, "coords"), spec.superposed)
    own, far = F.col("label") == F.col("far"), F.col("label") != F.col("far")
    each = total.groupBy(by).agg(F.sum(F.when(own, F.col("s"))).alias("s"), F.sum(F.when(own, F.col("n"))).alias("n"), F.min(F.when(far, F.col("s") / F.col("n"))).alias("b"))
    each = structures.select(by).join(each, by, "left")
    a, top = F.col("s") / F.col("n"), F.greatest(F.col("s") / F.col("n"), "b")
    score = F.when(F.col("n").isNull() | (top == 0), 0.0).otherwise((F.col("b") - a) / top)
    medoid = F.min(F.struct(F.round(F.coalesce("s", F.lit(0.0)), 9).alias("s"), "item"))["item"].alias("medoid")
    named = each.groupBy("group_id", "label").agg(medoid, F.sum(score).alias("s"))
    whole = named.join(sizes, ["group_id", "label"]).groupBy("group_id").agg(F.count(F.lit(1)).alias("labels"), F.sum("size").alias("items"), F.sum("s").alias("sum"))
    value = F.when((F.col("labels") > 1) & (F.col("labels") < F.col("items")), F.col("sum") / F.col("items"))
    return named.join(sizes, ["group_id", "label"]).join(whole.select("group_id", value.alias("silhouette")), "group_id").select("group_id", "label", "size", "medoid", "silhouette")


def assignment_rows(clustered: DataFrame, missing: DataFrame, filtered: DataFrame) -> DataFrame:
    """All rows of a clustering run: clustered ones, and those of missing and filtered structures, with a note and the run's values of their template.

    ``clustered``: template_id, variant_id, cluster_id, is_medoid, cutoff, silhouette, n_clusters, note; the others:
    template_id, variant_id.
    """
    run = clustered.groupBy("template_id").agg(F.max("cutoff").alias("cutoff"), F.max("silhouette").alias("silhouette"), F.max("n_clusters").alias("n_clusters"))
    rest = missing.select("template_id", "variant_id", F.lit("missing_pdb").alias("note")).unionByName(filtered.select("template_id", "variant_id", F.lit("filtered_bad_topology_among_rasa_passers").alias("note")))
    rest = rest.join(run, "template_id", "left").select("template_id", "variant_id", F.lit(None).cast("int").alias("cluster_id"), F.lit(None).cast("boolean").alias("is_medoid"), "cutoff", "silhouette", "n_clusters", "note")
    return clustered.select(rest.columns).unionByName(rest)
