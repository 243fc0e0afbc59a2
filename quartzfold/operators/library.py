"""Template validation and seeded expansion into variant libraries."""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzfold.constants import AA20
from quartzfold.functions.sequences import instantiate, natural_reason, recovery, token_reason, tokens, variant_id


@dataclass(frozen=True)
class LibrarySpec:
    """How many variants per template, the seed, and the residues that may stand for H and P, in order."""

    hydrophobic: tuple[str, ...]
    polar: tuple[str, ...]
    variants: int = 100
    seed: int = 42
    prefix: str = "var"

    def __post_init__(self) -> None:
        for name, pool in (("hydrophobic", self.hydrophobic), ("polar", self.polar)):
            if not pool or set(pool) - set(AA20):
                raise ValueError(f"the {name} pool must hold letters of the 20 amino acids, and at least one")
        if set(self.hydrophobic) & set(self.polar):
            raise ValueError(f"pools overlap: {sorted(set(self.hydrophobic) & set(self.polar))}")
        if self.variants < 1:
            raise ValueError("variants must be positive")


def templates(records: DataFrame, kind: str) -> DataFrame:
    """Templates from records (rec_no, id, description, seq) of ``kind`` natural or token, each with ``reason``, null if valid.

    Columns: rec_no, template_id, template_type, token_pattern, natural_sequence, description, reason.
    """
    if kind not in ("natural", "token"):
        raise ValueError("kind must be natural or token")
    seq = F.upper(F.trim("seq")) if kind == "natural" else F.replace(F.trim("seq"), F.lit(" "), F.lit(""))
    reason = natural_reason(F.col("seq")) if kind == "natural" else token_reason(F.col("seq"))
    return records.select(
        "rec_no", F.col("id").alias("template_id"), F.lit(kind).alias("template_type"), (tokens(seq) if kind == "natural" else seq).alias("token_pattern"),
        (seq if kind == "natural" else F.lit(None).cast("string")).alias("natural_sequence"), "description", reason.alias("reason"),
    )


def build_library(spec: LibrarySpec, natural: DataFrame | None = None, token: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Variants of one kind of records, and the skipped templates with their reasons; exactly one kind must be given."""
    if (natural is None) == (token is None):
        raise ValueError("give either natural or token records")
    t = templates(natural, "natural") if natural is not None else templates(token, "token")
    return generate(t, spec), t.where("reason is not null")


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """``df`` itself; ValueError naming up to 20 keys that occur more than once."""
    twice = [r[0] for r in df.groupBy(key).count().where("count > 1").orderBy(key).limit(20).collect()]
    if twice:
        raise ValueError(f"{key} is not unique: {twice}")
    return df


def last_of(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: its last by ``order``, with ``first_place``, the least order of the key."""
    others = [c for c in df.columns if c != key]
    last = df.groupBy(key).agg(F.max(F.struct(order, *[c for c in others if c != order])).alias("_last"), F.min(order).alias("first_place"))
    return last.select(key, *[F.col(f"_last.{c}") for c in others], "first_place")


def generate(valid: DataFrame, spec: LibrarySpec) -> DataFrame:
    """``spec.variants`` variants per valid template, with their metadata; no shuffle.

    Each residue is chosen by the MD5 of seed, template, variant and place, so any part of a library can be made anywhere,
    again and again, with the same result.
    """
    letters = lambda p: F.array(*map(F.lit, p))
    each = valid.where("reason is null").withColumn("variant_index", F.explode(F.sequence(F.lit(0), F.lit(spec.variants - 1))))
    made = instantiate(F.col("token_pattern"), letters(spec.hydrophobic), letters(spec.polar), F.lit(spec.seed), F.col("template_id"), F.col("variant_index"))
    return each.withColumn("sequence", made).select(
        "rec_no", variant_id(F.col("template_id"), F.col("variant_index"), spec.prefix).alias("variant_id"), "template_id", "variant_index", "token_pattern",
        F.lit(",".join(spec.hydrophobic)).alias("hydrophobic_pool"), F.lit(",".join(spec.polar)).alias("polar_pool"),
        recovery(F.col("natural_sequence"), F.col("sequence")).alias("recovery_to_natural"), "sequence",
    )


def generate_in_sequence(valid: DataFrame, spec: LibrarySpec) -> DataFrame:
    """The variants of one random stream that runs through all templates in order of rec_no, as a single program draws them.

    A draw depends on all before it, so this runs in one task; it is for small libraries that must repeat earlier ones.
    Columns: variant_id, template_id, variant_index, sequence.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        draw = random.Random(spec.seed)
        pick = {"H": lambda: draw.choice(spec.hydrophobic), "P": lambda: draw.choice(spec.polar)}
        for batch in batches:
            for t in batch.itertuples():
                made = ["".join(pick[x]() if x in pick else x.upper() for x in t.token_pattern) for _ in range(spec.variants)]
                yield pd.DataFrame({"variant_id": [f"{t.template_id}_{spec.prefix}{i:04d}" for i in range(spec.variants)], "template_id": t.template_id, "variant_index": range(spec.variants), "sequence": made})

    one = valid.where("reason is null").select("rec_no", "template_id", "token_pattern").repartition(1).sortWithinPartitions("rec_no")
    return one.mapInPandas(run, "variant_id string, template_id string, variant_index int, sequence string")
