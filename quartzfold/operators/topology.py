"""Bundle topology: centroids of helices and the angle between helix pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzfold.functions.geometry import angle, cosine, folded, minus


def helix_centroids(atoms: DataFrame, ranges: DataFrame) -> DataFrame:
    """variant_id, helix (1 to 4), n, centre: the mean CA position of each range.

    ``atoms``: variant_id, model_idx, chain_ord, hetflag, atom_name, resseq, x, y, z; ``ranges``: variant_id, ranges.
    Only the first model and chain count, and no hetero residues. The range join is an equi-join on the variant with a
    test of its four ranges.
    """
    first = atoms.where("atom_name = 'CA' and model_idx = 0 and chain_ord = 0 and coalesce(trim(hetflag), '') = ''")
    each = ranges.select("variant_id", F.posexplode("ranges").alias("helix", "range"))
    hit = first.join(each, "variant_id").where("resseq between range.start and range.end")
    return hit.groupBy("variant_id", (F.col("helix") + 1).alias("helix")).agg(F.count(F.lit(1)).alias("n"), F.array(F.avg("x"), F.avg("y"), F.avg("z")).alias("centre"))


def bundle_topology(centroids: DataFrame) -> DataFrame:
    """variant_id with the cosine between the lines of helices 1-2 and 3-4, its absolute value, the angle and the folded angle.

    Null values and a reason where a helix has no CA, or two helices have one centre.
    """
    at = lambda i: F.max(F.when(F.col("helix") == i, F.col("centre")))
    four = centroids.groupBy("variant_id").agg(*[at(i).alias(f"c{i}") for i in range(1, 5)])
    cos = cosine(minus(F.col("c2"), F.col("c1")), minus(F.col("c4"), F.col("c3")))
    whole = F.greatest(*[F.col(f"c{i}").isNull().cast("int") for i in range(1, 5)]) == 0
    return four.withColumn("cosine", cos).select(
        "variant_id", "cosine", F.abs("cosine").alias("abs_cosine"), angle(F.col("cosine")).alias("angle_degrees"), folded(angle(F.col("cosine"))).alias("folded_angle_degrees"),
        F.when(~whole, "no CA atoms in a helix range").when(F.col("cosine").isNull(), "helix centres coincide").alias("reason"),
    )


def connectivity_filter(structures: DataFrame, topology: DataFrame, most_rasa: float = 0.25, least_cosine: float = 0.2) -> DataFrame:
    """``structures`` (variant_id, rasa) with ``kept`` and ``note``: only structures within the rASA limit are checked, all others are kept."""
    passes = F.coalesce(F.col("rasa") <= most_rasa, F.lit(False)) & ~F.coalesce(F.isnan("rasa"), F.lit(False))
    joined = structures.join(topology.select("variant_id", "abs_cosine", F.col("reason").alias("_why")), "variant_id", "left")
    bad = passes & (F.col("abs_cosine") < least_cosine)
    unknown = passes & F.col("abs_cosine").isNull()
    note = F.when(bad, "filtered_bad_topology_among_rasa_passers").when(unknown, F.concat(F.lit("topology_not_measurable: "), F.coalesce("_why", F.lit("no atoms"))))
    return joined.select(*structures.columns, (~F.coalesce(bad, F.lit(False)) & ~unknown).alias("kept"), note.alias("note"))
