"""Lines and records of text files with their place in the file, for files of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzfold.operators.ranking import ranked_in_order


def numbered_pieces(spark: SparkSession, path: str, between: str, inner: str) -> DataFrame:
    """file, at (bigint, from 0 in each file), piece: the files under ``path`` cut where ``between`` stands, and then where the pattern ``inner`` matches.

    Spark splits a file at any ``between``, so a large one is read by many tasks. Rows of a split keep their order, and
    splits are ordered by their start; the places come from ranges of these, not from one task per file.
    """
    rows = spark.read.option("lineSep", between).text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row"), "value")
    pieces = rows.select("file", "_start", "_row", F.posexplode(F.split("value", inner)).alias("_in", "piece"))
    return ranked_in_order(pieces, ["file"], [F.col("_start"), F.col("_row"), F.col("_in")], "at").select("file", "at", "piece")
