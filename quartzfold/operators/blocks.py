"""Distances within groups of any size: exact quantiles, clusters, silhouettes and medoids from pairs of blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quartzfold.operators.rmsd import block_pairs, distances
from quartzfold.session import cut, discard

BLOCK = 512
SHIFTS = (44, 26, 8, 0)  # leading bits of a distance, as a double, that each pass tells apart


def _unit(key: tuple, pdf: pd.DataFrame, superposed: bool) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray]:
    """The rows of both blocks of a unit of work, by item, and their distances."""
    _, p, q = key
    pdf = pdf.sort_values("item")
    left, right = pdf[pdf.mine == p], pdf[pdf.mine == q]
    if not (len(left) and len(right)):
        return left, right, np.zeros((len(left), len(right)))
    d = distances(np.stack(left.coords), np.stack(right.coords), superposed)
    if p == q:
        d = (d + d.T) / 2
        np.fill_diagonal(d, 0)
    return left, right, d


def _each(structures: DataFrame, superposed: bool, f: Callable, schema: str) -> DataFrame:
    """``f(group, same, left, right, distances)`` for each two blocks of a group."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, d = _unit(key, pdf, superposed)
        out = f(key[0], key[1] == key[2], left, right, d)
        return out.assign(group_id=key[0])

    kind = dict(structures.dtypes)["group_id"]
    # pandas' columns are matched by name
    return block_pairs(structures, BLOCK).groupBy("group_id", "p", "q").applyInPandas(run, f"group_id {kind}, {schema}")


def _pairs_of(d: np.ndarray, same: bool) -> np.ndarray:
    return d[np.triu_indices(len(d), 1)] if same else d.ravel()


def quantiles(structures: DataFrame, at: list[float], superposed: bool) -> dict:
    """By group the number of pairs, their mean distance and the quantiles ``at``, interpolated between exact order statistics.

    The bits of a distance are in the order of the distances. Each pass counts the pairs by some more leading bits, within
    the bucket that the passes before found for a rank; the last one knows the distance. No pair is stored.
    """
    spark, kind = structures.sparkSession, dict(structures.dtypes)["group_id"]

    def totals(group: object, same: bool, left: pd.DataFrame, right: pd.DataFrame, d: np.ndarray) -> pd.DataFrame:
        v = _pairs_of(d, same)
        return pd.DataFrame({"n": [len(v)], "s": [v.sum()]})

    sums = {r[0]: (r["n"], r["s"] / r["n"]) for r in _each(structures, superposed, totals, "n bigint, s double").groupBy("group_id").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).where("n > 0").collect()}
    places = {g: [q * (n - 1) for q in at] for g, (n, _) in sums.items()}
    found = {(g, k): (0, k) for g, hs in places.items() for h in hs for k in {int(h), min(int(h) + 1, sums[g][0] - 1)}}
    known = 64
    for shift in SHIFTS:
        wanted: dict = {}
        for (g, _), (prefix, _) in found.items():
            wanted.setdefault(g, set()).add(prefix)

        def counts(group: object, same: bool, left: pd.DataFrame, right: pd.DataFrame, d: np.ndarray, wanted: dict = wanted, shift: int = shift, known: int = known) -> pd.DataFrame:
            bits = np.ascontiguousarray(_pairs_of(d, same) + 0.0).view(np.int64)
            if known < 64:
                bits = bits[np.isin(bits >> known, list(wanted.get(group, ())))]
            bucket, n = np.unique(bits >> shift, return_counts=True)
            return pd.DataFrame({"prefix": bucket >> (known - shift) if known < 64 else bucket * 0, "bucket": bucket, "n": n})

        hist = _each(structures, superposed, counts, "prefix bigint, bucket bigint, n bigint").groupBy("group_id", "prefix", "bucket").agg(F.sum("n").alias("n"))
        hist = hist.withColumn("until", F.sum("n").over(Window.partitionBy("group_id", "prefix").orderBy("bucket")))
        ranks = spark.createDataFrame([(g, k, prefix, rest) for (g, k), (prefix, rest) in found.items()], f"group_id {kind}, k bigint, prefix bigint, rest bigint") if found else None
        if ranks is None:
            break
        hit = hist.join(ranks, ["group_id", "prefix"]).where("rest < until and rest >= until - n")
        found = {(r["group_id"], r["k"]): (r["bucket"], r["rest"] - r["until"] + r["n"]) for r in hit.collect()}
        known = shift
    value = {key: float(np.array([bits], np.int64).view(np.float64)[0]) for key, (bits, _) in found.items()}
    out = {}
    for g, hs in places.items():
        ends = [(value[g, int(h)], value[g, min(int(h) + 1, sums[g][0] - 1)], h - int(h)) for h in hs]
        out[g] = (*sums[g], *[a + (b - a) * t if t < 0.5 else b - (b - a) * (1 - t) for a, b, t in ends])
    return out


def _tree(d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A least spanning tree of a full matrix, infinite where there is no edge: one end, other end and height of each edge."""
    n = len(d)
    near, best, inside = np.zeros(n, int), d[0].copy(), np.zeros(n, bool)
    inside[0], best[0] = True, np.inf
    a, b, h = (np.zeros(n - 1, t) for t in (int, int, float))
    for k in range(n - 1):
        j = int(best.argmin())
        a[k], b[k], h[k] = near[j], j, best[j]
        inside[j] = True
        closer = (d[j] < best) & ~inside
        near[closer], best[closer] = j, d[j][closer]
        best[j] = np.inf
    return a, b, h


def _edges(group: object, same: bool, left: pd.DataFrame, right: pd.DataFrame, d: np.ndarray) -> pd.DataFrame:
    if same:
        items, full = left["item"].to_numpy(), d.copy()
        np.fill_diagonal(full, np.inf)
    else:
        n = len(left)
        items, full = np.concatenate([left["item"].to_numpy(), right["item"].to_numpy()]), np.full((n + len(right), n + len(right)), np.inf)
        full[:n, n:], full[n:, :n] = d, d.T
    if not d.size or len(items) < 2:
        return pd.DataFrame({"a": items[:0], "b": items[:0], "d": np.zeros(0)})
    a, b, h = _tree(full)
    return pd.DataFrame({"a": items[a], "b": items[b], "d": h})


def _all_pairs(group: object, same: bool, left: pd.DataFrame, right: pd.DataFrame, d: np.ndarray) -> pd.DataFrame:
    i, j = np.triu_indices(len(d), 1) if same else (x.ravel() for x in np.indices(d.shape))
    a, b = left["item"].to_numpy()[i], right["item"].to_numpy()[j]
    return pd.DataFrame({"a": np.where(a < b, a, b), "b": np.where(a < b, b, a), "d": d[i, j]})


def merges_of(structures: DataFrame, linkage: str, superposed: bool) -> DataFrame:
    """The merges of complete or average linkage as edges (group_id, a, b, d): two clusters, by their first items, and their height.

    Distances of clusters are a table of pairs. In each round all pairs of clusters merge that are each other's nearest
    (equal distances: the first items); complete and average linkage never bring others nearer, so these are merges of
    the agglomeration one by one. Maxima and sums of the pairs are then added up for the merged clusters. A round is
    written to the shared folder; there are about as many as the logarithm of the items, more if clusters grow in a row.
    """
    item = dict(structures.dtypes)["item"]
    pairs = _each(structures, superposed, _all_pairs, f"a {item}, b {item}, d double").withColumns({"s": F.col("d"), "n": F.lit(1).cast("long")})
    pairs, found = cut(pairs), []
    columns = ["group_id", "a", "b", "d"]
    while not pairs.isEmpty():
        both = pairs.select("group_id", "a", "b", "d").union(pairs.select("group_id", "b", "a", "d"))
        near = both.groupBy("group_id", "a").agg(F.min(F.struct("d", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))).alias("m"))
        merged = cut(near.groupBy("group_id", F.col("m.lo").alias("a"), F.col("m.hi").alias("b")).agg(F.max("m.d").alias("d"), F.count(F.lit(1)).alias("n")).where("n = 2").select(columns))
        found.append(merged)
        last = pairs
        head = merged.select("group_id", F.col("b").alias("gone"), F.col("a").alias("kept"))
        for end in ("a", "b"):
            to = head.withColumnsRenamed({"gone": end})
            pairs = pairs.join(to, ["group_id", end], "left").withColumn(end, F.coalesce("kept", end)).drop("kept")
        joined = pairs.where("a <> b").groupBy("group_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("d").alias("most"), F.sum("s").alias("s"), F.sum("n").alias("n"))
        pairs = cut(joined.select("group_id", "a", "b", (F.col("most") if linkage == "complete" else F.col("s") / F.col("n")).alias("d"), "s", "n"))
        discard(last)
    out = structures.select("group_id", F.col("item").alias("a"), F.col("item").alias("b"), F.lit(0.0).alias("d")).where("false")
    for merged in found:
        out = out.unionByName(merged)
    return out


def label_sums(structures: DataFrame, superposed: bool) -> DataFrame:
    """group_id, item, label, far, n, s: for each item the number of items of each label of its group but itself, and the sum of its distances to them."""
    kinds = dict(structures.dtypes)

    def sums(group: object, same: bool, left: pd.DataFrame, right: pd.DataFrame, d: np.ndarray) -> pd.DataFrame:
        out = []
        for own, far, m in [(left, right, d)] if same else [(left, right, d), (right, left, d.T)]:
            names, at = np.unique(far.label.to_numpy(), return_inverse=True)
            of = (at[:, None] == np.arange(len(names))).astype(float)
            n = np.broadcast_to(of.sum(axis=0), (len(own), len(names))) - (of if same else 0)
            i, j = np.nonzero(n > 0)
            out.append(pd.DataFrame({"item": own["item"].to_numpy()[i], "label": own.label.to_numpy()[i], "far": names[j], "n": n[i, j].astype(np.int64), "s": (m @ of)[i, j] if m.size else np.zeros(0)}))
        return pd.concat(out)

    each = _each(structures, superposed, sums, f"item {kinds['item']}, label {kinds['label']}, far {kinds['label']}, n bigint, s double")
    return each.groupBy("group_id", "item", "label", "far").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def _labels(n: int, a: np.ndarray, b: np.ndarray, d: np.ndarray, cutoffs: np.ndarray) -> list[np.ndarray]:
    """Labels from 0, in order of first items, of the components by edges up to each of the rising ``cutoffs``."""
    head, out, at = np.arange(n), [], 0
    order = np.argsort(d, kind="stable")

    def root(i: int) -> int:
        while head[i] != i:
            head[i] = head[head[i]]
            i = head[i]
        return i

    for cutoff in cutoffs:
        while at < len(order) and d[order[at]] <= cutoff:
            i, j = root(a[order[at]]), root(b[order[at]])
            head[max(i, j)] = min(i, j)
            at += 1
        out.append(np.unique([root(i) for i in range(n)], return_inverse=True)[1])
    return out


def cluster_large(structures: DataFrame, spec, score: Callable[[np.ndarray, np.ndarray], float]) -> DataFrame:
    """group_id, item, cluster_id, is_medoid, cutoff, silhouette, n_clusters, for groups of any size.

    Single linkage: a spanning tree of a group lies within the trees of its pairs of blocks, and gives the labels at every
    cutoff. Other linkages: the merges are such a tree. The labels of a higher cutoff join those of a lower one, so one pass of sums of distances by item and label of the lowest
    cutoff that counts is enough for all silhouettes (``score`` of sums and labels) and medoids. One task holds a group's
    edges and sums, never its distances.
    """
    kinds = dict(structures.dtypes)
    item = kinds["item"]
    tried: dict = {}
    if spec.fixed is None:
        for g, (_, _, low, high) in quantiles(structures, [spec.low, spec.high], spec.superposed).items():
            tried[g] = np.linspace(low, high, spec.cutoffs) if high > low else np.array([low])

    def label(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        items, ends = np.unique(np.concatenate([pdf.a.to_numpy(), pdf.b.to_numpy()]), return_inverse=True)
        a, b = ends[: len(pdf)], ends[len(pdf) :]
        cutoffs = np.array([spec.fixed]) if spec.fixed is not None else tried[key[0]]
        all_labels = _labels(len(items), a, b, pdf.d.to_numpy(), cutoffs)
        chosen, seen = [], set()
        for c, of in zip(cutoffs, all_labels, strict=True):
            k = int(of.max()) + 1
            if spec.fixed is None and spec.least <= k <= min(spec.greatest, len(items) - 1) and k not in seen:
                seen.add(k)
                chosen.append((float(c), of))
        counts = bool(chosen)
        chosen = chosen or [(float(cutoffs[-1]), all_labels[-1])]
        each = np.stack([of for _, of in chosen], axis=1)
        return pd.DataFrame({"group_id": key[0], "item": items, "labels": list(each.astype(np.int32)), "cutoffs": [[c for c, _ in chosen]] * len(items), "counts": counts})

    edges = _each(structures, spec.superposed, _edges, f"a {item}, b {item}, d double") if spec.linkage == "single" else merges_of(structures, spec.linkage, spec.superposed)
    labelled = cut(edges.groupBy("group_id").applyInPandas(label, f"group_id {kinds['group_id']}, item {item}, labels array<int>, cutoffs array<double>, counts boolean"))

    def sums(group: object, same: bool, left: pd.DataFrame, right: pd.DataFrame, d: np.ndarray) -> pd.DataFrame:
        out = []
        for own, far, m in [(left, right, d)] if same else [(left, right, d), (right, left, d.T)]:
            if not m.size:
                continue
            names, at = np.unique(far.label.to_numpy(), return_inverse=True)
            total = m @ (at[:, None] == np.arange(len(names))).astype(float)
            i, j = np.nonzero(own.counts.to_numpy()[:, None] | (own.label.to_numpy()[:, None] == names))
            out.append(pd.DataFrame({"item": own["item"].to_numpy()[i], "label": names[j], "s": total[i, j]}))
        return pd.concat(out) if out else pd.DataFrame({"item": left["item"].to_numpy()[:0], "label": np.zeros(0, int), "s": np.zeros(0)})

    ready = structures.join(labelled.select("group_id", "item", F.col("labels")[0].alias("label"), "counts"), ["group_id", "item"])
    total = _each(ready, spec.superposed, sums, f"item {item}, label int, s double").groupBy("group_id", "item", "label").agg(F.sum("s").alias("s"))
    whole = labelled.join(total.groupBy("group_id", "item").agg(F.collect_list(F.struct("label", "s")).alias("sums")), ["group_id", "item"])
    whole = whole.select("group_id", "item", "labels", "cutoffs", "counts", F.col("sums.label").alias("at"), F.col("sums.s").alias("s"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item")
        each, cutoffs = np.stack(pdf.labels), pdf.cutoffs.iloc[0]
        fine, rows = each[:, 0], np.arange(len(pdf))
        if pdf.counts.iloc[0]:
            by_fine = np.zeros((len(pdf), fine.max() + 1))
            for i, (at, s) in enumerate(zip(pdf["at"], pdf.s, strict=True)):
                by_fine[i, at] = s
            best = None
            for c in range(each.shape[1]):
                labels = each[:, c]
                of = np.zeros(fine.max() + 1, int)
                of[fine] = labels
                joined = by_fine @ (of[:, None] == np.arange(labels.max() + 1)).astype(float)
                s = score(joined, labels + 1)
                if best is None or s > best[0]:
                    best = (s, float(cutoffs[c]), labels, joined[rows, labels])
            s, cutoff, labels, own = best
        else:
            s, cutoff, labels, own = None, float(cutoffs[0]), fine, np.array([v[0] for v in pdf.s])
        first = np.lexsort((rows, np.round(own, 9), labels))
        medoid = np.zeros(len(pdf), bool)
        medoid[first[np.flatnonzero(np.r_[True, np.diff(labels[first]) > 0])]] = True
        return pdf[["group_id", "item"]].assign(cluster_id=labels + 1, is_medoid=medoid, cutoff=cutoff, silhouette=s, n_clusters=int(labels.max()) + 1, note="")

    return whole.groupBy("group_id").applyInPandas(choose, f"group_id {kinds['group_id']}, item {item}, cluster_id int, is_medoid boolean, cutoff double, silhouette double, n_clusters int, note string")
