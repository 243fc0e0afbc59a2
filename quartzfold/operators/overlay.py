"""Component scores written into the B-factor columns of structure lines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_ordinal(lines: DataFrame) -> DataFrame:
    """``lines`` (variant_id, line_no, line) with ``ordinal``: the number, from 0, of each CA line within its variant; null for others."""
    ca = F.col("line").startswith("ATOM") & (F.trim(F.substring("line", 13, 4)) == "CA")
    numbered = lines.where(ca).withColumn("ordinal", F.row_number().over(Window.partitionBy("variant_id").orderBy("line_no")) - 1)
    return numbered.unionByName(lines.where(~F.coalesce(ca, F.lit(False))).withColumn("ordinal", F.lit(None).cast("int")))


def _fixed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        text = pdf.score.map(lambda s: "" if s != s or s in (float("inf"), float("-inf")) else f"{s:6.2f}")
        put = text.map(len) == 6
        pdf.loc[put, "line"] = [f"{line:<66}"[:60] + t + line[66:] for line, t in zip(pdf.line[put], text[put], strict=True)]
        yield pdf[["variant_id", "line_no", "line"]].assign(written=put, overflow=pdf.ordinal.notna() & pdf.given & ~put)


def overlay(lines: DataFrame, scores: DataFrame) -> DataFrame:
    """Lines with the k-th CA line of a variant carrying its k-th score: variant_id, line_no, line, written, overflow.

    ``scores``: variant_id, pos (from 0), score. Lines without a score stay as they are, as do those whose score six
    columns can't hold or is no number (``overflow``); scores beyond the last CA line are left out.
    """
    given = scores.select("variant_id", F.col("pos").alias("ordinal"), F.col("score").cast("double").alias("score"), F.col("score").isNotNull().alias("given"))
    joined = with_ordinal(lines).join(given, ["variant_id", "ordinal"], "left")
    return joined.select("variant_id", "line_no", "line", "ordinal", "score", F.coalesce("given", F.lit(False)).alias("given")).mapInPandas(_fixed, "variant_id string, line_no int, line string, written boolean, overflow boolean")


def available_scores(stored: DataFrame, projected: DataFrame, which: int) -> DataFrame:
    """Component ``which`` (from 1) of each position: variant_id, pos, score; a variant's stored scores come first, else the projected ones.

    Both: variant_id, pos, pc (array).
    """
    if which < 1:
        raise ValueError("components are counted from 1")
    fresh = projected.join(stored.select("variant_id").distinct(), "variant_id", "left_anti")
    both = stored.select("variant_id", "pos", "pc").unionByName(fresh.select("variant_id", "pos", "pc"))
    return both.select("variant_id", "pos", F.get("pc", F.lit(which - 1)).cast("double").alias("score"))


def usable_scores(scores: DataFrame) -> DataFrame:
    """variant_id and a reason for the variants whose scores lack the component asked for at any place."""
    return scores.groupBy("variant_id").agg(F.count_if(F.col("score").isNull()).alias("n")).where("n > 0").select("variant_id", F.lit("pc_scores_shape_mismatch").alias("reason"))


def overlay_report(written: DataFrame, scores: DataFrame) -> DataFrame:
    """Per variant: n_ca_written, n_pc_available and a reason where they differ.

    Too few CA lines are the first reason, then scores that their columns can't hold (``bfactor_overflow``).
    """
    a = written.groupBy("variant_id").agg(F.count_if("written").alias("n_ca_written"), F.count_if("overflow").alias("n_overflow"))
    b = scores.groupBy("variant_id").agg(F.count("score").alias("n_pc_available"))
    both = a.join(b, "variant_id", "full").na.fill(0, ["n_ca_written", "n_overflow", "n_pc_available"])
    reason = (
        F.when(F.col("n_pc_available") == 0, "missing_embeddings_and_scores")
        .when(F.col("n_ca_written") + F.col("n_overflow") < F.col("n_pc_available"), F.format_string("pc_longer_than_ca: wrote %d CA values, had %d", "n_ca_written", "n_pc_available"))
        .when(F.col("n_overflow") > 0, F.format_string("bfactor_overflow: %d values", "n_overflow"))
    )
    return both.select("variant_id", "n_ca_written", "n_pc_available", reason.alias("reason"))


def whole_report(selected: DataFrame, structures: DataFrame, existing: DataFrame, unusable: DataFrame, report: DataFrame) -> DataFrame:
    """One row per variant of ``selected``: variant_id, ok, reason, n_ca_written, n_pc_available.

    The first reason holds: no structure (``structures``: variant_id), a result from before (``existing``), scores without
    the component (``unusable``: variant_id, reason), then what ``report`` of the written ones says.
    """
    has = lambda df, name: df.select("variant_id").distinct().withColumn(name, F.lit(True))
    rows = selected.select("variant_id").distinct().join(has(structures, "_in"), "variant_id", "left").join(has(existing, "_old"), "variant_id", "left")
    rows = rows.join(unusable.select("variant_id", F.col("reason").alias("_bad")), "variant_id", "left").join(report.withColumnRenamed("reason", "_said"), "variant_id", "left")
    none = F.coalesce("n_pc_available", F.lit(0)) == 0
    reason = F.when(F.col("_in").isNull(), "missing_pdb").when(F.col("_old"), "skipped_exists").when(F.col("_bad").isNotNull(), F.col("_bad")).when(none, "missing_embeddings_and_scores").otherwise(F.col("_said"))
    ok = F.col("_in").isNotNull() & (F.coalesce("_old", F.lit(False)) | (F.col("_bad").isNull() & ~none))
    written = lambda c: F.when(ok & F.col("_old").isNull(), F.coalesce(c, F.lit(0))).otherwise(0).alias(c)
    return rows.select("variant_id", ok.alias("ok"), reason.alias("reason"), written("n_ca_written"), written("n_pc_available"))


