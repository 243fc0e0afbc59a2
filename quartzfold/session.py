"""Session helpers: reading tables and cutting lineage in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the session names none (local tests), a temporary folder is made once and kept in the session's settings.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = spark.conf.get("quartzfold.local.dir", None)
        if not found:
            found = tempfile.mkdtemp(prefix="spark-")
            spark.conf.set("quartzfold.local.dir", found)
    return found.rstrip("/")


def _cuts(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/quartzfold-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession) -> str:
    """The path of a new folder in the shared folder, for files; ``drop_cuts`` deletes it."""
    return f"{_cuts(spark)}/{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of this name, in whatever file system it names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def drop_cuts(spark: SparkSession) -> None:
    """Delete the tables that this application has written with ``cut``; frames read from them can't be used after that."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_cuts(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back, so that lineage ends there.

    Survives the loss of executors and, unlike a cached frame, takes no executor memory. ``drop_cuts`` deletes the tables.
    """
    spark = df.sparkSession
    path = f"{_cuts(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.cut_path = path
    return made


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, for work that costs far more than moving its rows; unchanged if it has as many splits already, as any large table has."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def discard(df: DataFrame) -> None:
    """Delete a table that ``cut`` made and nothing reads any more."""
    path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.cut_path)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python, once per application."""
    done = f"quartzfold.shipped.{spark.sparkContext.applicationId}"
    if spark.conf.get(done, None):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "quartzfold.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    spark.conf.set(done, "yes")
