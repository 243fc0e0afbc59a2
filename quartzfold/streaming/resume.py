"""Resumable processing of new rows with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quartzfold.session import exists


def process_new(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, step: Callable[[DataFrame], DataFrame], key: str) -> StreamingQuery:
    """Run ``step`` on rows that arrive as Parquet files under ``source`` and add its results to the table ``target``.

    Keys that ``target`` already has are left out, so a batch that ran before a failure adds nothing twice. Ends when
    all files present at the start are done; a later call goes on from there.
    """

    def add(batch: DataFrame, number: int) -> None:
        new = batch.dropDuplicates([key])
        if exists(spark, f"{target}/_SUCCESS"):  # only the keys' column is read
            new = new.join(spark.read.parquet(target).select(key), key, "left_anti")
        step(new).write.mode("append").parquet(target)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
