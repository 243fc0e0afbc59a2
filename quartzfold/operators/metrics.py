"""Structure metrics from residue and atom tables, the success gate, and summaries per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzfold.constants import HELIX, HYDROPHOBIC


def number(c: Column) -> Column:
    """A double with NaN as null, so that averages and comparisons leave it out."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def gate(rasa: Column, cosine: Column, has_ranges: Column, on: bool = True, most_rasa: float = 0.25, least_cosine: float = 0.2) -> Column:
    """The success gate as struct<flag, checked, bad, success, reason>, 0 or 1 or null.

    Without the gate success is the raw flag. With it, a structure above the rASA limit fails unchecked, one within it
    is checked if it has helix ranges, and fails if the absolute cosine is below the limit; one that can't be measured
    has a null success and the reason.
    """
    rasa, cosine = number(rasa), F.abs(number(cosine))
    flag = F.when(rasa.isNotNull(), (rasa <= most_rasa).cast("int"))
    null = F.lit(None).cast("int")
    if not on:
        return F.struct(flag.alias("flag"), null.alias("checked"), null.alias("bad"), flag.alias("success"), F.lit(None).cast("string").alias("reason"))
    passes = flag == 1
    ranged = F.coalesce(has_ranges, F.lit(False))
    checked = F.when(passes & ranged & cosine.isNotNull(), 1).otherwise(0)
    bad = F.when(checked == 1, (cosine < least_cosine).cast("int"))
    success = F.when(flag == 0, 0).when(passes & ~ranged, 1).when(checked == 1, 1 - bad)
    reason = (
        F.when(rasa.isNull(), "missing_mean_hydrophobic_rasa").when(flag == 0, "rasa_above_threshold")
        .when(bad == 1, "bad_topology_among_rasa_passers").when(passes & ranged & cosine.isNull(), "topology_not_measurable")
    )
    return F.struct(flag.alias("flag"), checked.alias("checked"), bad.alias("bad"), success.alias("success"), reason.alias("reason"))


def residue_metrics(residues: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """Per variant: n_res_dssp, n_helix_res, n_hydrophobic_res, helix_fraction, mean_hydrophobic_rasa, note.

    ``residues``: variant_id, dssp_index, aa, ss, rasa (string or number); ``skip``: variant_id, positions (array) to
    leave out. A variant of which nothing is left keeps a row of zeros with a note.
    """
    kept = F.lit(True)
    if skip is not None:
        residues = residues.join(skip.select("variant_id", "positions"), "variant_id", "left")
        kept = ~F.coalesce(F.array_contains("positions", F.col("dssp_index")), F.lit(False))
    rasa = number(F.expr("try_cast(rasa as double)"))
    oily = F.col("aa").isin(*HYDROPHOBIC) & kept
    helix = F.col("ss").isin(*HELIX)
    out = residues.groupBy("variant_id").agg(
        F.count_if(kept).alias("n_res_dssp"), F.count_if(kept & helix).alias("n_helix_res"), F.count_if(oily).alias("n_hydrophobic_res"),
        F.avg(F.when(kept, helix.cast("int"))).alias("helix_fraction"), F.avg(F.when(oily, rasa)).alias("mean_hydrophobic_rasa"),
    )
    none = F.col("n_res_dssp") == 0
    return out.withColumn("helix_fraction", F.coalesce("helix_fraction", F.lit(0.0))).withColumn("note", F.when(none, "dssp_returned_zero_residues_or_all_residues_skipped"))


def mean_bfactor(atoms: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """Per variant the mean B-factor over all atoms of all models, without skipped residue numbers; null if none is left."""
    value = number(F.col("bfactor"))
    if skip is not None:
        atoms = atoms.join(skip.select("variant_id", "positions"), "variant_id", "left")
        value = F.when(~F.coalesce(F.array_contains("positions", F.col("resseq")), F.lit(False)), value)
    return atoms.groupBy("variant_id").agg(F.avg(value).alias("mean_all_atom_bfactor"))


def with_group(metrics: DataFrame, metadata: DataFrame, group: str = "template_id") -> DataFrame:
    """``metrics`` with the group of each variant: from ``metadata`` (variant_id, group, row_id; the last row counts), else the id's own."""
    last = metadata.where("variant_id is not null").groupBy("variant_id").agg(F.max(F.struct("row_id", group))[group].alias("_group"))
    named = metrics.join(last, "variant_id", "left")
    return named.withColumn("group_id", F.coalesce("_group", F.substring_index("variant_id", "_var", 1))).drop("_group")


def summary(metrics: DataFrame, group: str = "group_id") -> DataFrame:
    """Per group the mean length, confidence, helicity and rASA, the success rate over known flags, and the structures."""
    mean = lambda c, digits: F.bround(F.avg(number(F.col(c))), digits)
    return metrics.groupBy(group).agg(
        mean("n_res_dssp", 1).alias("sequence_length"), mean("mean_all_atom_bfactor", 3).alias("avg_confidence"), mean("helix_fraction", 3).alias("avg_helicity"),
        mean("mean_hydrophobic_rasa", 3).alias("avg_hydrophobic_rasa"), F.bround(F.avg(F.col("rasa_success_after_topology_gate").cast("double")), 3).alias("fraction_success"),
        F.count("variant_id").alias("n_structures_total"),
    )
