"""Queries over structure metrics, selections, clusters and components, with SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzfold.operators.averaging import average_clusters
from quartzfold.operators.clustering import ClusterSpec, assignment_rows, cluster_groups, distance_summary, label_quality
from quartzfold.operators.external import index_problems
from quartzfold.operators.metrics import gate, mean_bfactor, residue_metrics, summary, with_group
from quartzfold.operators.overlay import available_scores, overlay, overlay_report, usable_scores, whole_report
from quartzfold.operators.pca import fit_pca, load_pca, project, report, save_pca
from quartzfold.operators.references import same_path
from quartzfold.operators.rmsd import rmsd_to, single_linkage
from quartzfold.operators.selecting import first_in_order, latest, only, per_cluster, running_total, without
from quartzfold.operators.topology import bundle_topology, connectivity_filter, helix_centroids
from quartzfold.session import scratch, table

HELICES = ((1, 5), (6, 10), (11, 15), (16, 21))


def rasa_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gate(F.col("mean_hydrophobic_rasa"), F.col("topology_abs_cosine_similarity"), F.col("topology_helix_ranges").isNotNull())
    return table(spark, sf_dir, "structural_metrics").select("row_id", g.alias("g")).select("row_id", "g.*")


def variant_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_group(table(spark, sf_dir, "structural_metrics"), table(spark, sf_dir, "variants")).select("row_id", "variant_id", "group_id")


def template_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(with_group(table(spark, sf_dir, "structural_metrics"), table(spark, sf_dir, "variants")))


def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "predictions").groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("variant_id").alias("n_variants"), F.sum("attempts").alias("attempts"), F.count("reason").alias("n_reasons"))


def latest_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "predictions"), "variant_id", "row_id").select("variant_id", "row_id", "status", "reason")


def failed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "predictions"), "variant_id", "row_id").where("status = 'failed'").select("variant_id")


def ids_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return only(table(spark, sf_dir, "embeddings_index"), table(spark, sf_dir, "cluster_assignments").where("cluster_id is not null"), "variant_id").select("row_id", "variant_id")


def skip_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without(table(spark, sf_dir, "variants").select("variant_id").distinct(), table(spark, sf_dir, "predictions").where("status = 'ok'"), "variant_id")


def assignment_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = latest(table(spark, sf_dir, "cluster_assignments").where("template_id is not null"), "variant_id", "row_id").where("cluster_id is not null")
    known = latest(table(spark, sf_dir, "variants"), "variant_id", "row_id").select("template_id", "variant_id")
    measured = latest(table(spark, sf_dir, "structural_metrics"), "variant_id", "row_id")
    missing = without(without(known, measured, "variant_id"), assigned, "variant_id")
    bad = only(without(known, assigned, "variant_id"), measured.where("bad_topology_among_rasa_passers = 1"), "variant_id")
    return assignment_rows(assigned.withColumn("note", F.lit("")), missing, bad)


def connectivity_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = latest(table(spark, sf_dir, "structural_metrics"), "variant_id", "row_id")
    topology = m.select("variant_id", F.col("topology_abs_cosine_similarity").alias("abs_cosine"), F.lit("no value").alias("reason"))
    return connectivity_filter(m.select("variant_id", F.col("mean_hydrophobic_rasa").alias("rasa")), topology).select("variant_id", "kept", "note")


def top_k_per_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_cluster(table(spark, sf_dir, "cluster_assignments"), 5)


def sample_k_per_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_cluster(table(spark, sf_dir, "cluster_assignments"), 5, seed=42)


def limit_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_in_order(table(spark, sf_dir, "predictions").where("status = 'ok'"), "row_id", 100).select("row_id", "variant_id")


def residue_running_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running_total(table(spark, sf_dir, "embeddings_index").select("row_id", "sequence_length"), "row_id", "sequence_length")


def record_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of lines with a comma up to each line, per file."""
    rows = table(spark, sf_dir, "raw_reports").select("line_id", "file_name", "line_no", F.coalesce(F.col("raw_line").contains(","), F.lit(False)).cast("int").alias("first"))
    return running_total(rows, ["line_no", "line_id"], "first", "before", ["file_name"]).select("line_id", "file_name", (F.col("before") + F.col("first")).alias("rec_no"))


def embed_index_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "embedding_files").groupBy(same_path(F.col("embedding_path")).alias("path")).agg(F.max(F.struct("row_id", F.col("emb_mean").alias("vector")))["vector"].alias("vector"))
    index = table(spark, sf_dir, "embeddings_index").where("status in ('ok', 'skipped')").select("row_id", "variant_id", same_path(F.col("embedding_path")).alias("path"))
    return index_problems(index.where("path is not null"), files, 16).groupBy("problem").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("variant_id").alias("n_variants"))


def _atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of ``embeddings`` as chains of 21 points."""
    point = lambda i, k: F.col("embedding")[(3 * F.col(i) + k).cast("int")].cast("double")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("i"))
    return rows.select(F.col("vec_id").alias("variant_id"), "label", F.lit("CA").alias("atom_name"), F.lit(0).alias("model_idx"), F.lit(0).alias("chain_ord"), F.lit(" ").alias("hetflag"), (F.col("i") + 1).alias("resseq"), *[point("i", k).alias(c) for k, c in enumerate("xyz")])


def _structures(spark: SparkSession, sf_dir: str, size: int = 64) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("group_id"), F.col("vec_id").alias("item"), F.slice("embedding", 1, size).cast("array<double>").alias("coords"))


def helix_range_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    atoms = _atoms(spark, sf_dir)
    ranges = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("variant_id"), F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in HELICES]).alias("ranges"))
    return helix_centroids(atoms, ranges)


def helix_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = helix_range_centroid(spark, sf_dir)
    return c.select("variant_id", "helix", "n", *[F.round(F.col("centre")[i], 6).alias(f"c{'xyz'[i]}") for i in range(3)])


def topology_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = bundle_topology(helix_range_centroid(spark, sf_dir))
    return t.select("variant_id", *[F.round(c, 6).alias(c) for c in ("cosine", "abs_cosine", "angle_degrees", "folded_angle_degrees")])


def chain_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residue metrics and mean B-factors of point chains, with secondary structure and exposure read from their values."""
    atoms = _atoms(spark, sf_dir)
    residues = atoms.select("variant_id", F.col("resseq").alias("dssp_index"), F.when(F.col("x") > 0, "L").otherwise("K").alias("aa"), F.when(F.col("y") > 0, "H").otherwise("T").alias("ss"), F.when(F.abs("z") < 0.3, F.abs("z").cast("string")).otherwise("NA").alias("rasa"))
    skip = atoms.select("variant_id").distinct().select("variant_id", F.array(F.lit(1), F.lit(21)).alias("positions"))
    m = residue_metrics(residues, skip).join(mean_bfactor(atoms.withColumn("bfactor", F.col("z") * 100), skip), "variant_id")
    return m.select("variant_id", "n_res_dssp", "n_helix_res", "n_hydrophobic_res", *[F.round(c, 6).alias(c) for c in ("helix_fraction", "mean_hydrophobic_rasa", "mean_all_atom_bfactor")])


def rmsd_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = distance_summary(_structures(spark, sf_dir), ClusterSpec(superposed=False))
    return d.select("group_id", "n_pairs", *[F.round(c, 6).alias(c) for c in ("mean_distance", "low_cutoff", "high_cutoff")])


def cluster_medoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _structures(spark, sf_dir).withColumn("label", F.pmod("item", F.lit(4)))
    q = label_quality(s, ClusterSpec(superposed=False))
    return q.select("group_id", "label", "size", "medoid", F.round("silhouette", 6).alias("silhouette"))


def single_linkage_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single_linkage(_structures(spark, sf_dir), 1.2, superposed=False)


def cluster_cutoff_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster_groups(_structures(spark, sf_dir, 63), ClusterSpec())
    return found.withColumns({"cutoff": F.round("cutoff", 6), "silhouette": F.round("silhouette", 6)})


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _structures(spark, sf_dir, 63)
    return cluster_groups(s, ClusterSpec()).join(s, ["group_id", "item"]).select("group_id", "cluster_id", "item", "is_medoid", "coords")


def cluster_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return average_clusters(_members(spark, sf_dir))[0]


def cluster_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return average_clusters(_members(spark, sf_dir))[1]


def cluster_average_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The centre of each mean structure: that of the member on which the others are superposed."""
    mean = average_clusters(_members(spark, sf_dir))[0]
    return mean.groupBy("group_id", "cluster_id").agg(F.count(F.lit(1)).alias("n_atoms"), *[F.round(F.avg(c), 6).alias(f"c{c}") for c in "xyz"])


def kabsch_rmsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _structures(spark, sf_dir, 63)
    first = s.groupBy("group_id").agg(F.min(F.struct("item", "coords"))["coords"].alias("coords"))
    return rmsd_to(first, s, "group_id").withColumn("rmsd", F.round("rmsd", 6))


def pca_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "embedding_files").where("size(emb_mean) = 16")
    return spark.createDataFrame(report(fit_pca(files, "emb_mean", 10)), "component int, explained double, singular_value double")


def pca_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "embedding_files").where("size(emb_mean) = 16").select("row_id", "emb_mean")
    return project(files, "emb_mean", fit_pca(files, "emb_mean", 5)).select("row_id", "pc")


def pca_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the singular values of all components add up to: the whole variance, and the squares of all covariances."""
    m = fit_pca(table(spark, sf_dir, "embedding_files").where("size(emb_mean) = 16"), "emb_mean", 16)
    return spark.createDataFrame([(m.n, float((m.singular**2).sum() / m.n), float((m.singular**4).sum() / m.n**2), float(m.explained.sum()))], "n bigint, variance double, covariances double, explained double").selectExpr(
        "n", "round(variance, 6) variance", "round(covariances, 3) covariances", "round(explained, 9) explained"
    )


def pca_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The squared length of each vector's scores along all components of a stored model: that of the centred vector."""
    files = table(spark, sf_dir, "embedding_files").where("size(emb_mean) = 16").select("row_id", "emb_mean")
    path = scratch(spark)
    save_pca(spark, fit_pca(files, "emb_mean", 16), path)
    pc = project(files, "emb_mean", load_pca(spark, path), "double").select("row_id", "pc")
    return pc.select("row_id", F.round(F.aggregate("pc", F.lit(0.0), lambda a, x: a + x * x), 6).alias("squared"))


def _overlay(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines of point chains, the scores of their residues (stored ones for even ids, else fresh ones; one too many for some), and the variants without component 2."""
    line = F.format_string("ATOM  %5d  CA  ALA A%4d    %8.3f%8.3f%8.3f  1.00  0.00           C", "resseq", "resseq", "x", "y", "z")
    points = _atoms(spark, sf_dir).withColumns({"key": F.col("variant_id"), "variant_id": F.col("variant_id").cast("string"), "pos": (F.col("resseq") - 1).cast("int")})
    lines = points.select("variant_id", F.col("resseq").alias("line_no"), line.alias("line"))
    scores = points.select("variant_id", "key", "pos", "x", "y").unionByName(points.where("resseq = 21 and key % 5 = 0").select("variant_id", "key", F.lit(21).alias("pos"), "x", "y"))
    stored = scores.where("key % 2 = 0").select("variant_id", "pos", F.when(F.col("key") % 14 == 0, F.array("x")).otherwise(F.array("x", F.col("y") * 5000)).alias("pc"))
    fresh = scores.select("variant_id", "pos", F.array("x", F.col("y") * 50).alias("pc"))
    both = available_scores(stored, fresh, 2)
    return lines, both, usable_scores(both)


def pc_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, scores, _ = _overlay(spark, sf_dir)
    return overlay(lines, scores)


def pc_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of an overlay in which some structures are missing and some have a result from before."""
    lines, scores, unusable = _overlay(spark, sf_dir)
    selected = lines.select("variant_id").distinct()
    there, old = lines.where("variant_id % 7 <> 3"), selected.where("variant_id % 11 = 5")
    usable = without(without(scores, unusable, "variant_id"), old, "variant_id")
    report = overlay_report(overlay(only(there, usable, "variant_id"), usable), only(usable, there, "variant_id"))
    return whole_report(selected, there, old, unusable, report)


_LATEST = lambda t, where="true": f"(SELECT * FROM {t} WHERE variant_id IS NOT NULL AND {where} QUALIFY row_number() OVER (PARTITION BY variant_id ORDER BY row_id DESC) = 1)"
_NUM = lambda c: f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END"
_GROUPED = f"(SELECT m.*, coalesce(v.template_id, split_part(m.variant_id, '_var', 1)) AS group_id FROM structural_metrics m LEFT JOIN {_LATEST('variants')} v USING (variant_id))"
_PTS = "(SELECT vec_id AS variant_id, i + 1 AS resseq, embedding[3 * i + 1]::DOUBLE AS x, embedding[3 * i + 2]::DOUBLE AS y, embedding[3 * i + 3]::DOUBLE AS z FROM embeddings, range(21) r(i))"
_HEL = "(VALUES " + ", ".join(f"({k + 1}, {a}, {b})" for k, (a, b) in enumerate(HELICES)) + ") h(helix, s, e)"
_CENTRES = f"(SELECT variant_id, helix, count(*) AS n, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM {_PTS} p JOIN {_HEL} ON resseq BETWEEN s AND e GROUP BY ALL)"
_PAIRS = "(SELECT a.label AS g, a.vec_id AS i, b.vec_id AS j, sqrt(list_sum(list_transform(range(1, 65), lambda k: (a.embedding[k]::DOUBLE - b.embedding[k]::DOUBLE) ** 2))) AS d FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id)"
_UNION_COLUMNS = "template_id, variant_id, cluster_id, is_medoid, cutoff, silhouette, n_clusters, note"

# superposed distances of pairs (g, i, j) in closed form: the singular values of a 3 x 3 matrix by the roots of a cubic
_XYZ = [(a, b) for a in "xyz" for b in "xyz"]
_KABSCH = lambda pairs: f"""(SELECT g, i, j, sqrt(greatest(e - 2 * (sqrt(greatest(l1, 0)) + sqrt(greatest(l2, 0)) + sign(det) * sqrt(greatest(l3, 0))), 0) / n) AS d FROM (
SELECT *, q + 2 * p * cos(phi) AS l1, q + 2 * p * cos(phi + 2 * pi() / 3) AS l3, 3 * q - (q + 2 * p * cos(phi)) - (q + 2 * p * cos(phi + 2 * pi() / 3)) AS l2 FROM (
SELECT *, CASE WHEN p = 0 THEN 0 ELSE acos(least(greatest(((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * h) + h * (d * f - (b - q) * h)) / (2 * p ** 3), -1.0), 1.0)) / 3 END AS phi FROM (
SELECT *, (a + b + c) / 3 AS q, sqrt(((a - (a + b + c) / 3) ** 2 + (b - (a + b + c) / 3) ** 2 + (c - (a + b + c) / 3) ** 2 + 2 * (d * d + f * f + h * h)) / 6) AS p FROM (
SELECT g, i, j, n, e, hxx * (hyy * hzz - hyz * hzy) - hxy * (hyx * hzz - hyz * hzx) + hxz * (hyx * hzy - hyy * hzx) AS det,
  hxx * hxx + hyx * hyx + hzx * hzx AS a, hxy * hxy + hyy * hyy + hzy * hzy AS b, hxz * hxz + hyz * hyz + hzz * hzz AS c, hxx * hxy + hyx * hyy + hzx * hzy AS d, hxy * hxz + hyy * hyz + hzy * hzz AS f, hxx * hxz + hyx * hyz + hzx * hzz AS h FROM (
SELECT k.g, k.i, k.j, count(*) AS n, sum((s.x - cs.x) ** 2 + (s.y - cs.y) ** 2 + (s.z - cs.z) ** 2 + (t.x - ct.x) ** 2 + (t.y - ct.y) ** 2 + (t.z - ct.z) ** 2) AS e,
  {', '.join(f"sum((t.{a} - ct.{a}) * (s.{b} - cs.{b})) AS h{a}{b}" for a, b in _XYZ)}
FROM {pairs} k JOIN pts s ON s.variant_id = k.i JOIN pts t ON t.variant_id = k.j AND t.resseq = s.resseq JOIN centres cs ON cs.variant_id = k.i JOIN centres ct ON ct.variant_id = k.j GROUP BY ALL))))))"""  # noqa: E731
_POINTS = f"pts AS MATERIALIZED {_PTS}, centres AS MATERIALIZED (SELECT variant_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM pts GROUP BY variant_id)"
_SEARCH = f"""WITH RECURSIVE {_POINTS}, half AS MATERIALIZED {_KABSCH('(SELECT a.label AS g, a.vec_id AS i, b.vec_id AS j FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id)')},
d AS MATERIALIZED (SELECT g, i, j, d FROM half UNION ALL SELECT g, j, i, d FROM half),
items AS MATERIALIZED (SELECT label AS g, vec_id AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
ends AS (SELECT g, quantile_cont(d, 0.05) AS lo, quantile_cont(d, 0.95) AS hi FROM half GROUP BY g), cuts AS MATERIALIZED (SELECT g, k, CASE WHEN k = 49 THEN hi ELSE lo + (hi - lo) / 49 * k END AS cut FROM ends, range(50) r(k)),
reach(g, k, i, c) AS (SELECT items.g, k, i, i FROM items JOIN cuts USING (g) UNION SELECT r.g, r.k, d.j, r.c FROM reach r JOIN cuts USING (g, k) JOIN d ON d.g = r.g AND d.i = r.i AND d.d <= cut AND d.j > r.c),
heads AS MATERIALIZED (SELECT g, k, i, min(c) AS c FROM reach GROUP BY ALL), sizes AS MATERIALIZED (SELECT g, k, c, count(*) AS size FROM heads GROUP BY ALL),
fit AS MATERIALIZED (SELECT g, k, count(*) AS n_clusters FROM sizes GROUP BY ALL HAVING count(*) BETWEEN 2 AND 20 AND count(*) <= sum(size) - 1),
sums AS (SELECT a.g, a.k, a.i, a.c, b.c AS far, sum(d) AS s FROM fit JOIN heads a USING (g, k) JOIN heads b USING (g, k) JOIN d ON d.g = a.g AND d.i = a.i AND d.j = b.i GROUP BY ALL),
ab AS (SELECT sums.g, sums.k, i, max(CASE WHEN sums.c = far THEN s / greatest(size - 1, 1) END) AS a, min(CASE WHEN sums.c <> far THEN s / size END) AS b FROM sums JOIN sizes ON sizes.g = sums.g AND sizes.k = sums.k AND sizes.c = far GROUP BY ALL),
sil AS (SELECT g, k, avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END) AS s FROM ab GROUP BY ALL),
best AS MATERIALIZED (SELECT g, coalesce(arg_max(k, (round(s, 10), -k)), 49) AS k, max(s) AS s FROM (SELECT g FROM ends) LEFT JOIN sil USING (g) GROUP BY g),
chosen AS MATERIALIZED (SELECT g, k, i, c, dense_rank() OVER (PARTITION BY g ORDER BY c)::INT AS cluster_id FROM heads JOIN best USING (g, k)),
own AS (SELECT a.g, a.i, a.cluster_id, sum(CASE WHEN a.i = b.i THEN 0 ELSE d END) AS s FROM chosen a JOIN chosen b ON a.g = b.g AND a.c = b.c LEFT JOIN d ON d.g = a.g AND d.i = a.i AND d.j = b.i GROUP BY ALL),
named AS (SELECT *, row_number() OVER (PARTITION BY g, cluster_id ORDER BY round(s, 9), i) = 1 AS is_medoid FROM own)
"""
_SCORES = f"(SELECT p.*, variant_id % 14 = 0 AS bad, CASE WHEN variant_id % 2 = 0 THEN y * 5000 ELSE y * 50 END AS s FROM {_PTS} p)"
_LINES = f"""(SELECT *, printf('ATOM  %5d  CA  ALA A%4d    %8.3f%8.3f%8.3f  1.00  0.00           C', resseq, resseq, x, y, z) AS line, CASE WHEN NOT bad AND length(printf('%6.2f', s)) = 6 THEN printf('%6.2f', s) END AS text FROM {_SCORES})"""

QUERIES = {
    f.__name__: f
    for f in (
        rasa_gate, variant_group, template_summary, status_rollup, latest_predictions, failed_ids, ids_kept, skip_existing, assignment_union, connectivity_kept, top_k_per_cluster, sample_k_per_cluster,
        limit_in_order, residue_running_total, record_numbering, embed_index_check, helix_centres, topology_cosine, chain_metrics, rmsd_quantiles, cluster_medoids, single_linkage_clusters, cluster_cutoff_search,
        cluster_average, cluster_average_centres, cluster_manifest, kabsch_rmsd, pca_explained, pca_scores, pca_variance, pca_lengths, pc_overlay, pc_report,
    )
}
SQL = {
    "rasa_gate": f"""WITH m AS (SELECT row_id, {_NUM('mean_hydrophobic_rasa')} AS r, abs({_NUM('topology_abs_cosine_similarity')}) AS c, topology_helix_ranges IS NOT NULL AS h FROM structural_metrics),
f AS (SELECT *, CASE WHEN r IS NOT NULL THEN (r <= 0.25)::INT END AS flag FROM m), k AS (SELECT *, CASE WHEN flag = 1 AND h AND c IS NOT NULL THEN 1 ELSE 0 END AS checked FROM f),
b AS (SELECT *, CASE WHEN checked = 1 THEN (c < 0.2)::INT END AS bad FROM k)
SELECT row_id, flag, checked, bad, CASE WHEN flag = 0 THEN 0 WHEN flag = 1 AND NOT h THEN 1 WHEN checked = 1 THEN 1 - bad END AS success,
CASE WHEN r IS NULL THEN 'missing_mean_hydrophobic_rasa' WHEN flag = 0 THEN 'rasa_above_threshold' WHEN bad = 1 THEN 'bad_topology_among_rasa_passers' WHEN flag = 1 AND h AND c IS NULL THEN 'topology_not_measurable' END AS reason FROM b""",
    "variant_group": f"SELECT row_id, variant_id, group_id FROM {_GROUPED}",
    "template_summary": f"""SELECT group_id, round_even(avg(n_res_dssp), 1) AS sequence_length, round_even(avg({_NUM('mean_all_atom_bfactor')}), 3) AS avg_confidence, round_even(avg({_NUM('helix_fraction')}), 3) AS avg_helicity,
round_even(avg({_NUM('mean_hydrophobic_rasa')}), 3) AS avg_hydrophobic_rasa, round_even(avg(rasa_success_after_topology_gate), 3) AS fraction_success, count(variant_id) AS n_structures_total FROM {_GROUPED} GROUP BY group_id""",
    "status_rollup": "SELECT status, count(*) AS n, count(DISTINCT variant_id) AS n_variants, sum(attempts)::BIGINT AS attempts, count(reason) AS n_reasons FROM predictions GROUP BY status",
    "latest_predictions": f"SELECT variant_id, row_id, status, reason FROM {_LATEST('predictions')}",
    "failed_ids": f"SELECT variant_id FROM {_LATEST('predictions')} WHERE status = 'failed'",
    "ids_kept": "SELECT row_id, variant_id FROM embeddings_index WHERE variant_id IN (SELECT variant_id FROM cluster_assignments WHERE cluster_id IS NOT NULL AND variant_id IS NOT NULL)",
    "skip_existing": "SELECT DISTINCT variant_id FROM variants v WHERE NOT EXISTS (SELECT 1 FROM predictions p WHERE p.status = 'ok' AND p.variant_id = v.variant_id)",
    "assignment_union": f"""WITH a AS (SELECT * FROM {_LATEST('cluster_assignments', 'template_id IS NOT NULL')} WHERE cluster_id IS NOT NULL), k AS (SELECT template_id, variant_id FROM {_LATEST('variants')}), m AS {_LATEST('structural_metrics')},
r AS (SELECT template_id, max(cutoff) AS cutoff, max(silhouette) AS silhouette, max(n_clusters) AS n_clusters FROM a GROUP BY template_id),
x AS (SELECT template_id, variant_id, 'missing_pdb' AS note FROM k WHERE variant_id NOT IN (SELECT variant_id FROM m) AND variant_id NOT IN (SELECT variant_id FROM a)
UNION ALL SELECT template_id, variant_id, 'filtered_bad_topology_among_rasa_passers' FROM k WHERE variant_id NOT IN (SELECT variant_id FROM a) AND variant_id IN (SELECT variant_id FROM m WHERE bad_topology_among_rasa_passers = 1))
SELECT template_id, variant_id, cluster_id, is_medoid, cutoff, silhouette, n_clusters, '' AS note FROM a
UNION ALL SELECT x.template_id, variant_id, NULL, NULL, cutoff, silhouette, n_clusters, note FROM x LEFT JOIN r ON r.template_id = x.template_id""",
    "connectivity_kept": f"""WITH m AS (SELECT variant_id, mean_hydrophobic_rasa AS r, topology_abs_cosine_similarity AS c FROM {_LATEST('structural_metrics')}),
p AS (SELECT *, coalesce(r <= 0.25 AND NOT isnan(r), false) AS ok FROM m)
SELECT variant_id, NOT (ok AND (c IS NULL OR c < 0.2)) AS kept, CASE WHEN ok AND c < 0.2 THEN 'filtered_bad_topology_among_rasa_passers' WHEN ok AND c IS NULL THEN 'topology_not_measurable: no value' END AS note FROM p""",
    "top_k_per_cluster": "SELECT *, row_number() OVER (PARTITION BY template_id, cluster_id ORDER BY variant_id)::INT AS place FROM (SELECT DISTINCT template_id, cluster_id, variant_id FROM cluster_assignments WHERE template_id IS NOT NULL AND cluster_id IS NOT NULL AND variant_id IS NOT NULL) QUALIFY place <= 5",
    "sample_k_per_cluster": "SELECT *, row_number() OVER (PARTITION BY template_id, cluster_id ORDER BY md5('42|' || variant_id), variant_id)::INT AS place FROM (SELECT DISTINCT template_id, cluster_id, variant_id FROM cluster_assignments WHERE template_id IS NOT NULL AND cluster_id IS NOT NULL AND variant_id IS NOT NULL) QUALIFY place <= 5",
    "limit_in_order": "SELECT row_id, variant_id FROM predictions WHERE status = 'ok' ORDER BY row_id LIMIT 100",
    "residue_running_total": "SELECT row_id, sequence_length, coalesce(sum(sequence_length) OVER (ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS total_before FROM embeddings_index",
    "record_numbering": "SELECT line_id, file_name, sum(coalesce(contains(raw_line, ','), false)::INT) OVER (PARTITION BY file_name ORDER BY line_no, line_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS rec_no FROM raw_reports",
    "embed_index_check": r"""WITH f AS (SELECT regexp_replace(regexp_replace(embedding_path, '^(?:\./)+', ''), '/(?:\.?/)+', '/', 'g') AS path, emb_mean AS v FROM embedding_files QUALIFY row_number() OVER (PARTITION BY path ORDER BY row_id DESC) = 1),
i AS (SELECT variant_id, regexp_replace(regexp_replace(embedding_path, '^(?:\./)+', ''), '/(?:\.?/)+', '/', 'g') AS path FROM embeddings_index WHERE status IN ('ok', 'skipped') AND embedding_path IS NOT NULL),
j AS (SELECT variant_id, CASE WHEN v IS NULL THEN 'missing' WHEN len(v) <> 16 THEN 'wrong_length' WHEN len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) > 0 THEN 'not_finite' END AS problem FROM i LEFT JOIN f USING (path))
SELECT problem, count(*) AS n, count(DISTINCT variant_id) AS n_variants FROM j WHERE problem IS NOT NULL GROUP BY problem""",
    "helix_centres": f"SELECT variant_id, helix, n, round(cx, 6) AS cx, round(cy, 6) AS cy, round(cz, 6) AS cz FROM {_CENTRES}",
    "topology_cosine": f"""WITH c AS {_CENTRES}, v AS (SELECT a.variant_id, b.cx - a.cx AS ux, b.cy - a.cy AS uy, b.cz - a.cz AS uz, e.cx - d.cx AS vx, e.cy - d.cy AS vy, e.cz - d.cz AS vz FROM c a JOIN c b USING (variant_id) JOIN c d USING (variant_id) JOIN c e USING (variant_id) WHERE a.helix = 1 AND b.helix = 2 AND d.helix = 3 AND e.helix = 4),
k AS (SELECT variant_id, least(greatest((ux * vx + uy * vy + uz * vz) / (sqrt(ux * ux + uy * uy + uz * uz) * sqrt(vx * vx + vy * vy + vz * vz)), -1.0), 1.0) AS cosine FROM v)
SELECT variant_id, round(cosine, 6) AS cosine, round(abs(cosine), 6) AS abs_cosine, round(degrees(acos(cosine)), 6) AS angle_degrees, round(least(degrees(acos(cosine)), 180 - degrees(acos(cosine))), 6) AS folded_angle_degrees FROM k""",
    "chain_metrics": f"""SELECT variant_id, count(*) AS n_res_dssp, count(*) FILTER (WHERE y > 0) AS n_helix_res, count(*) FILTER (WHERE x > 0) AS n_hydrophobic_res, round(avg((y > 0)::INT), 6) AS helix_fraction,
round(avg(abs(z)) FILTER (WHERE x > 0 AND abs(z) < 0.3), 6) AS mean_hydrophobic_rasa, round(avg(z * 100), 6) AS mean_all_atom_bfactor FROM {_PTS} WHERE resseq NOT IN (1, 21) GROUP BY variant_id""",
    "rmsd_quantiles": f"SELECT g AS group_id, count(*) AS n_pairs, round(avg(d), 6) AS mean_distance, round(quantile_cont(d, 0.05), 6) AS low_cutoff, round(quantile_cont(d, 0.95), 6) AS high_cutoff FROM {_PAIRS} WHERE i < j GROUP BY g",
    "cluster_medoids": f"""WITH p AS (SELECT g, i, i % 4 AS li, j % 4 AS lj, d FROM {_PAIRS}), n AS (SELECT label AS g, vec_id % 4 AS l, count(*) AS size FROM embeddings GROUP BY ALL),
m AS (SELECT g, i, li, lj, sum(d) AS s FROM p GROUP BY ALL), own AS (SELECT m.g, m.i, m.li AS l, size, s FROM m JOIN n ON m.g = n.g AND m.li = n.l WHERE m.li = m.lj),
b AS (SELECT m.g, m.i, min(s / size) AS b FROM m JOIN n ON m.g = n.g AND m.lj = n.l WHERE m.li <> m.lj GROUP BY ALL),
sil AS (SELECT own.g, avg(CASE WHEN greatest(s / (size - 1), b) = 0 THEN 0 ELSE (b - s / (size - 1)) / greatest(s / (size - 1), b) END) AS silhouette FROM own JOIN b USING (g, i) GROUP BY own.g),
med AS (SELECT g, l, i FROM own QUALIFY row_number() OVER (PARTITION BY g, l ORDER BY round(s, 9), i) = 1)
SELECT med.g AS group_id, med.l AS label, n.size, med.i AS medoid, round(silhouette, 6) AS silhouette FROM med JOIN n ON med.g = n.g AND med.l = n.l JOIN sil ON sil.g = med.g""",
    "kabsch_rmsd": f"""WITH {_POINTS} SELECT g AS group_id, j AS item, round(d, 6) AS rmsd FROM {_KABSCH('(SELECT label AS g, min(vec_id) OVER (PARTITION BY label) AS i, vec_id AS j FROM embeddings)')}""",
    # all pairs of a group, all cutoffs: fit for small tables only
    "cluster_cutoff_search": f"""{_SEARCH} SELECT n.g AS group_id, n.i AS item, cluster_id, is_medoid, round(cut, 6) AS cutoff, round(best.s, 6) AS silhouette, max(cluster_id) OVER (PARTITION BY n.g) AS n_clusters, '' AS note
FROM named n JOIN best ON best.g = n.g JOIN cuts ON cuts.g = n.g AND cuts.k = best.k""",
    "cluster_manifest": f"""{_SEARCH} SELECT g AS group_id, cluster_id, max(CASE WHEN is_medoid THEN i END) AS reference, count(*) AS n_total, count(*) AS n_used, 0::BIGINT AS n_skipped, []::BIGINT[] AS skipped FROM named GROUP BY g, cluster_id""",
    "cluster_average_centres": f"""{_SEARCH} SELECT g AS group_id, cluster_id, 21::BIGINT AS n_atoms, round(x, 6) AS cx, round(y, 6) AS cy, round(z, 6) AS cz FROM named JOIN centres ON centres.variant_id = i WHERE is_medoid""",
    "pca_variance": """WITH v AS (SELECT emb_mean::DOUBLE[] AS v FROM embedding_files WHERE len(emb_mean) = 16 AND len(list_filter(emb_mean, lambda x: x IS NOT NULL AND isfinite(x))) = 16),
c AS (SELECT i, j, covar_pop(v[i], v[j]) AS c FROM v, range(1, 17) a(i), range(1, 17) b(j) GROUP BY ALL)
SELECT (SELECT count(*) FROM v) AS n, round(sum(CASE WHEN i = j THEN c END), 6) AS variance, round(sum(c * c), 3) AS covariances, 1.0 AS explained FROM c""",
    "pca_lengths": """WITH u AS (SELECT row_id, emb_mean::DOUBLE[] AS v FROM embedding_files WHERE len(emb_mean) = 16), ok AS (SELECT * FROM u WHERE len(list_filter(v, lambda x: x IS NOT NULL AND isfinite(x))) = 16),
m AS (SELECT i, avg(v[i]) AS m FROM ok, range(1, 17) a(i) GROUP BY i) SELECT row_id, round(sum((v[i] - m) ** 2), 6) AS squared FROM u, m GROUP BY row_id""",
    "pc_overlay": f"""SELECT variant_id::VARCHAR AS variant_id, resseq::INT AS line_no, CASE WHEN text IS NULL THEN line ELSE substr(line, 1, 60) || text || substr(line, 67) END AS line, text IS NOT NULL AS written, NOT bad AND text IS NULL AS overflow FROM {_LINES}""",
    "pc_report": f"""WITH r AS (SELECT variant_id AS v, count(text) AS w, 21 + (variant_id % 5 = 0)::INT AS n, 21 - count(text) AS o, bool_or(bad) AS bad FROM {_LINES} GROUP BY variant_id)
SELECT v::VARCHAR AS variant_id, v % 7 <> 3 AND (v % 11 = 5 OR NOT bad) AS ok, CASE WHEN v % 7 = 3 THEN 'missing_pdb' WHEN v % 11 = 5 THEN 'skipped_exists' WHEN bad THEN 'pc_scores_shape_mismatch' WHEN w + o < n THEN 'pc_longer_than_ca: wrote ' || w || ' CA values, had ' || n
WHEN o > 0 THEN 'bfactor_overflow: ' || o || ' values' END AS reason, CASE WHEN v % 7 = 3 OR v % 11 = 5 OR bad THEN 0 ELSE w END AS n_ca_written, CASE WHEN v % 7 = 3 OR v % 11 = 5 OR bad THEN 0 ELSE n END::BIGINT AS n_pc_available FROM r""",
    "single_linkage_clusters": f"""WITH RECURSIVE e AS (SELECT g, i, j FROM {_PAIRS} WHERE d <= 1.2), r(g, item, c) AS (SELECT label, vec_id, vec_id FROM embeddings UNION SELECT e.g, e.j, r.c FROM r JOIN e ON r.g = e.g AND r.item = e.i)
SELECT g AS group_id, item, min(c) AS cluster FROM r GROUP BY g, item""",
}
