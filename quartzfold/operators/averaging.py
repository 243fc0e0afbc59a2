"""Mean structures of clusters, superposed on their medoid."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzfold.operators.rmsd import superpose


def _aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out: list = [None] * len(pdf)
        shape = [(len(c), len(m)) for c, m in zip(pdf.coords, pdf.moved, strict=True)]
        for n in set(shape):
            at = [i for i, m in enumerate(shape) if m == n]
            if at:
                fixed, moving, rest = (np.stack(c.iloc[at]).reshape(len(at), -1, 3) for c in (pdf.fixed, pdf.coords, pdf.moved))
                rotation, shift = superpose(fixed, moving)
                for i, m in zip(at, rest @ rotation + shift[:, None], strict=True):
                    out[i] = m.ravel()
        yield pd.DataFrame({"group_id": pdf.group_id, "cluster_id": pdf.cluster_id, "item": pdf["item"], "coords": out})


def average_clusters(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The mean coordinates of each cluster, and its manifest.

    ``members``: group_id, cluster_id, item, is_medoid, coords (array of x, y, z in atom order, null if missing), and, if
    other atoms than those superposed are to be averaged, moved (their coordinates) and layout (what they are). The
    reference is the medoid, else the first member with coordinates. Members without coordinates or of another length
    are skipped and named. Mean: group_id, cluster_id, atom (from 0), x, y, z. Manifest: group_id, cluster_id,
    reference, n_total, n_used, n_skipped, skipped (sorted).

    Each member is turned onto the reference on its own, and atoms are averaged with partial sums: a cluster of any size
    is never gathered in one task.
    """
    kinds = dict(members.dtypes)
    if "moved" not in members.columns:
        members = members.withColumns({"moved": F.col("coords"), "layout": F.lit("")})
    rows = members.where("group_id is not null and cluster_id is not null")
    order = F.struct((~F.coalesce("is_medoid", F.lit(False))).alias("later"), "item", "coords", F.size("moved").alias("n_moved"), "layout")
    fixed = rows.groupBy("group_id", "cluster_id").agg(F.min(F.when(F.col("coords").isNotNull(), order)).alias("r"))
    fixed = fixed.select("group_id", "cluster_id", F.col("r.item").alias("reference"), F.col("r.coords").alias("fixed"), F.col("r.n_moved").alias("n_moved"), F.col("r.layout").alias("fixed_layout"))
    joined = rows.join(fixed, ["group_id", "cluster_id"])
    same = (F.size("coords") == F.size("fixed")) & (F.size("moved") == F.col("n_moved")) & (F.col("layout") == F.col("fixed_layout"))
    fits = F.coalesce(same, F.lit(False)) & F.col("coords").isNotNull()
    turned = joined.where(fits & (F.size("coords") > 0)).select("group_id", "cluster_id", "item", "coords", "fixed", "moved").mapInPandas(_aligned, f"group_id {kinds['group_id']}, cluster_id {kinds['cluster_id']}, item {kinds['item']}, coords array<double>")
    atoms = turned.where("coords is not null").select("group_id", "cluster_id", F.expr("posexplode(transform(sequence(0, size(coords) div 3 - 1), i -> struct(coords[3 * i] as x, coords[3 * i + 1] as y, coords[3 * i + 2] as z)))").alias("atom", "p"))
    mean = atoms.groupBy("group_id", "cluster_id", "atom").agg(F.avg("p.x").alias("x"), F.avg("p.y").alias("y"), F.avg("p.z").alias("z"))
    manifest = joined.groupBy("group_id", "cluster_id").agg(
        F.max("reference").alias("reference"), F.count(F.lit(1)).alias("n_total"), F.count_if(fits).alias("n_used"), F.count_if(~fits).alias("n_skipped"),
        F.array_sort(F.collect_list(F.when(~fits, F.col("item")))).alias("skipped"),
    )
    return mean, manifest
