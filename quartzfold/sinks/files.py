"""FASTA, CSV, id-list and structure-line sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzfold.functions.sequences import wrap


def fasta_text(name: Column, description: Column, seq: Column, width: int = 80) -> Column:
    """One record as text: the header, and the sequence in lines of ``width``."""
    head = F.concat(F.lit(">"), F.rtrim(F.concat_ws(" ", name, F.when(description != "", description))))
    return F.when(F.length(seq) > 0, F.concat(head, F.lit("\n"), wrap(seq, width))).otherwise(head)


def write_fasta(records: DataFrame, path: str, order: str = "rec_no", upper: bool = True, by: str | None = None) -> None:
    """Write records (order, id, description, seq) as FASTA in order, in one folder per ``by`` if given.

    Files of a folder follow each other in name order; each is sorted, and no task holds the whole.
    """
    seq = F.upper("seq") if upper else F.col("seq")
    text = fasta_text(F.col("id"), F.coalesce("description", F.lit("")), seq).alias("value")
    if by is None:
        records.repartitionByRange(order).sortWithinPartitions(order).select(text).write.mode("overwrite").text(path)
    else:
        records.repartitionByRange(by, order).sortWithinPartitions(by, order).select(by, text).write.mode("overwrite").partitionBy(by).text(path)


def write_token_fasta(records: DataFrame, path: str, original: bool = False, by: str | None = None) -> None:
    """Write token records (rec_no, id, description, seq, tokens) with their tokens as they are; with ``original`` the header names the sequence (``orig=``)."""
    said = F.concat_ws(" ", F.when(F.col("description") != "", F.col("description")), F.concat(F.lit("orig="), "seq")) if original else F.col("description")
    others = [by] if by else []
    write_fasta(records.select("rec_no", "id", said.alias("description"), F.col("tokens").alias("seq"), *others), path, upper=False, by=by)


def with_skipped(variants: DataFrame, skipped: DataFrame) -> DataFrame:
    """Variants (rec_no, id, description, seq) and after them the skipped templates, marked ``*`` with their reason."""
    marked = skipped.select("rec_no", F.concat(F.lit("*"), "id").alias("id"), F.concat(F.lit("skipped_reason="), "reason").alias("description"), F.coalesce("seq", F.lit("")).alias("seq"))
    return variants.select(F.struct(F.lit(0).alias("section"), "rec_no").alias("rec_no"), "id", "description", "seq").unionByName(marked.withColumn("rec_no", F.struct(F.lit(1).alias("section"), "rec_no")))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header in every file, also for an empty table; nulls are empty, arrays joined by semicolons."""
    flat = [F.array_join(F.transform(n, lambda x: x.cast("string")), ";").alias(n) if t.startswith("array") else F.col(n) for n, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_ids(df: DataFrame, path: str, key: str = "variant_id") -> None:
    df.select(F.col(key).cast("string").alias("value")).write.mode("overwrite").text(path)


def append_index(df: DataFrame, path: str, append: bool = True) -> None:
    """Add rows to an index table; earlier rows stay unless ``append`` is false, and readers take the latest of each key."""
    df.write.mode("append" if append else "overwrite").parquet(path)


def write_structures(lines: DataFrame, path: str) -> None:
    """One folder per variant with its lines in order."""
    lines.repartition("variant_id").sortWithinPartitions("variant_id", "line_no").select("variant_id", F.col("line").alias("value")).write.mode("overwrite").partitionBy("variant_id").text(path)
