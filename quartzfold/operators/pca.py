"""Principal components of vectors: exact, from sums that are combined in Spark."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


FAN = 32  # matrices added at once


@dataclass(frozen=True)
class PCAModel:
    """Mean (d), components (k, d), share of variance and singular value of each component, and the vectors used."""

    mean: np.ndarray
    components: np.ndarray
    explained: np.ndarray
    singular: np.ndarray
    n: int


def fit_pca(vectors: DataFrame, vector: str, k: int) -> PCAModel:
    """The first ``k`` components of a column of equally long arrays; rows with null or non-finite values are left out.

    Each task sums its vectors and their products, less one vector, so that a large mean costs no digits. Rows of the
    product matrices are added up by row number, first of ``FAN`` tasks each, then all; there are at most as many tasks
    as cores, so what is shuffled is bounded however many rows and files there are. The driver gets one d x d matrix.
    The entry of a component with the largest absolute value is positive.
    """
    ok = vectors.select(F.col(vector).cast("array<double>").alias("v")).where("v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    one = ok.first()
    if one is None:
        raise ValueError("no usable vectors")
    shift = np.array(one["v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, task = None, TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) - shift
            x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
            total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(total), task // FAN, np.int32)), pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["lot", "i", "row"])

    def add(part: pa.Table) -> pa.Table:
        rows = np.stack(part["row"].to_numpy()).sum(axis=0)
        return pa.table({"lot": part["lot"].slice(0, 1), "i": part["i"].slice(0, 1), "row": pa.array([rows], pa.list_(pa.float64()))})

    schema = "lot int, i int, row array<double>"
    sums = ok.coalesce(max(FAN, ok.sparkSession.sparkContext.defaultParallelism)).mapInArrow(run, schema)
    rows = sums.groupBy("lot", "i").applyInArrow(add, schema).groupBy("i").applyInArrow(add, schema).orderBy("i").collect()
    m = np.array([r["row"] for r in rows])
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    if k > len(mean):
        raise ValueError(f"{k} components of vectors of length {len(mean)}")
    values, axes = np.linalg.eigh(m[1:, 1:] - n * np.outer(mean, mean))
    order = np.argsort(-values)
    values, axes = np.maximum(values[order], 0), axes[:, order].T
    axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
    return PCAModel(mean + shift, axes[:k], values[:k] / max(values.sum(), 1e-300), np.sqrt(values[:k]), int(n))


def project(vectors: DataFrame, vector: str, model: PCAModel, kind: str = "float") -> DataFrame:
    """``vectors`` with ``pc`` (array of ``kind``, float or double): the centred vector along each component; null for a null vector."""
    d = len(model.mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(vector)
            ok = v.is_valid().to_numpy(zero_copy_only=False)
            pc = (v.drop_null().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d) - model.mean) @ model.components.T
            starts = np.concatenate([[0], np.cumsum(ok) * pc.shape[1]]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(pc.ravel().astype(kind.replace("float", "float32"))), mask=pa.array(~ok))
            yield batch.append_column("pc", lists)

    return vectors.mapInArrow(run, f"{', '.join(f'`{n}` {t}' for n, t in vectors.dtypes)}, pc array<{kind}>")


def report(model: PCAModel) -> list[tuple[int, float, float]]:
    """Component (from 1), share of variance and singular value."""
    return [(i + 1, float(e), float(s)) for i, (e, s) in enumerate(zip(model.explained, model.singular, strict=True))]


def save_pca(spark: SparkSession, model: PCAModel, path: str) -> None:
    """The model as a table of one row."""
    row = (model.mean.tolist(), model.components.tolist(), model.explained.tolist(), model.singular.tolist(), model.n)
    spark.createDataFrame([row], "mean array<double>, components array<array<double>>, explained array<double>, singular array<double>, n long").coalesce(1).write.mode("overwrite").parquet(path)


def load_pca(spark: SparkSession, path: str) -> PCAModel:
    r = spark.read.parquet(path).first()
    return PCAModel(np.array(r["mean"]), np.array(r["components"]), np.array(r["explained"]), np.array(r["singular"]), r["n"])
