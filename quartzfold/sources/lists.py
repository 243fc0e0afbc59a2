"""Configuration, id lists, residue lists and CSV tables with required columns."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quartzfold.operators.library import LibrarySpec
from quartzfold.sources.lines import numbered_pieces


def _first(block: dict, names: tuple[str, ...], default: int) -> tuple[str, int]:
    """The first of several names for a setting that a block has, with its value."""
    name = next((n for n in names if n in block), names[0])
    return name, int(block.get(name, default))


def _settings(path: str) -> dict:
    import yaml

    return yaml.safe_load(Path(path).read_text()) or {}


def load_library_spec(path: str) -> LibrarySpec:
    """A library's settings from a YAML file (read on the driver); ValueError names a number that must be positive."""
    data = _settings(path)
    made, pools = data.get("randomization") or {}, data.get("replacement_pools") or {}
    name, number = _first(made, ("num_variants_per_input", "num_variants_per_template"), 100)
    if number < 1:
        raise ValueError(f"randomization.{name} must be positive")
    return LibrarySpec(tuple(pools.get("hydrophobic") or ()), tuple(pools.get("polar") or ()), number, _first(made, ("rng_seed", "seed"), 42)[1])


def load_output_names(path: str) -> tuple[str, str]:
    """The names of a library's sequences and of its metadata from the same file, without suffixes."""
    named = _settings(path).get("outputs") or {}
    return tuple(Path(named.get(k) or default).stem for k, default in (("variants_fasta_name", "variants_fasta"), ("metadata_table_name", "metadata")))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 0, in file order), id: one per line, trimmed, without blank lines and ``#`` comments; repeated ids are kept."""
    lines = numbered_pieces(spark, path, "\n", "(?!)").select(F.col("at").alias("line_no"), F.trim(F.translate("piece", "\r\t", " ")).alias("id"))
    return lines.where((F.col("id") != "") & ~F.col("id").startswith("#"))


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """The different positions of a file of comma-separated whole numbers with ``#`` comment lines."""
    lines = spark.read.text(path).where(~F.trim("value").startswith("#"))
    return lines.select(F.explode(F.split("value", ",")).alias("p")).select(F.trim("p").try_cast("int").alias("position")).where("position is not null").distinct()


def read_csv(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """The columns of ``schema`` from a CSV table with a header, whatever others it has and in whatever order.

    Nothing is inferred: ids stay text, values that don't fit their type are null, absent columns are null. ValueError
    names the required columns that the table lacks.
    """
    found = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    absent = sorted(set(required) - set(found.columns))
    if absent:
        raise ValueError(f"missing columns in {path}: {absent}")
    return found.select(*[(F.col(f"`{f.name}`") if f.name in found.columns else F.lit(None)).try_cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)])
