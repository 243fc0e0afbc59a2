"""FASTA files as records in file order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzfold.functions.sequences import token_reason
from quartzfold.sources.lines import numbered_pieces


def read_fasta(spark: SparkSession, path: str, keep_case: bool = False) -> DataFrame:
    """Records of the FASTA files under ``path``: file, rec_no (from 1 in each file), id, description, seq.

    Lines are trimmed and blank ones skipped; text before the first header is dropped; the id is the first word of a
    header, which may be null for a bare ``>``; a header without lines has an empty sequence. Blanks within a sequence
    go, and it is upper-cased unless ``keep_case``. A file is read by as many tasks as it has splits.
    """
    pieces = numbered_pieces(spark, path, "\n>", r"[\r\n][ \t]*>")
    # only the first piece of a file still has its own mark, or is text before the first header
    first, marked = F.col("at") == 0, F.ltrim(F.translate("piece", "\r\n\t", "   ")).startswith(">")
    before = pieces.where(first).select("file", (~marked).cast("long").alias("_before"))
    records = pieces.where(~first | marked).join(before, "file").select(
        "file", (F.col("at") + 1 - F.col("_before")).alias("rec_no"), F.when(first, F.regexp_replace("piece", r"^\s*>", "")).otherwise(F.col("piece")).alias("piece")
    )
    head = F.regexp_extract("piece", r"^[^\r\n]*", 0)
    name, rest = (F.regexp_extract(F.trim(F.translate(head, "\t", " ")), r"^(\S*)\s*(.*)$", i) for i in (1, 2))
    seq = F.translate(F.expr("substring(piece, length(regexp_extract(piece, '^[^\\\\r\\\\n]*', 0)) + 1)"), " \t\r\n", "")
    return records.select("file", "rec_no", F.when(name != "", name).alias("id"), rest.alias("description"), (seq if keep_case else F.upper(seq)).alias("seq"))


def read_token_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Token records in their own case, each with ``reason``, null if its pattern is valid."""
    return read_fasta(spark, path, keep_case=True).withColumn("reason", token_reason(F.col("seq")))


def require_valid(records: DataFrame, shown: int = 20) -> DataFrame:
    """``records`` itself; ValueError with the first reasons if any record is not valid."""
    bad = records.where("reason is not null")
    first = [f"{r['id']}: {r['reason']}" for r in bad.orderBy("file", "rec_no").limit(shown).collect()]
    if first:
        more = bad.count() - len(first)
        raise ValueError("; ".join(first) + (f"; ... plus {more} more." if more else ""))
    return records
