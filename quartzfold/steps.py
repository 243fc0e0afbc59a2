"""The pipeline's steps over files, and their command line: ``python -m quartzfold.steps STEP --help``.

library, predict, metrics, cluster, average, embed, pca and overlay read and write the formats of ``sources`` and ``sinks``.
Names of columns and of reasons in what they write are fixed values.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzfold.functions.helices import topology_ranges, written
from quartzfold.functions.sequences import default_group, motif_positions
from quartzfold.operators.averaging import average_clusters
from quartzfold.operators.clustering import ClusterSpec, assignment_rows, cluster_groups
from quartzfold.operators.external import RetrySpec, embed, index_rows, predict
from quartzfold.operators.library import build_library, last_of, require_unique
from quartzfold.operators.metrics import gate, mean_bfactor, residue_metrics, summary, with_group
from quartzfold.operators.overlay import available_scores, overlay, overlay_report, usable_scores, whole_report
from quartzfold.operators.pca import fit_pca, load_pca, project, save_pca
from quartzfold.operators.selecting import capped, first_in_order, only, select_ids, without
from quartzfold.operators.topology import bundle_topology, connectivity_filter, helix_centroids
from quartzfold.session import cut, drop_cuts, exists, ship
from quartzfold.sinks.files import append_index, with_skipped, write_csv, write_fasta, write_ids, write_structures
from quartzfold.sources.fasta import read_fasta
from quartzfold.sources.lists import load_library_spec, load_output_names, read_csv, read_ids, read_positions
from quartzfold.sources.structures import alpha_coordinates, atom_names, atoms, backbone, one_location, read_lines, read_vectors, residues


def library(spark: SparkSession, fasta: str, config: str, out: str, token: bool = False, by_template: bool = False) -> None:
    """Variants and metadata of the templates in ``fasta``, and with ``by_template`` a folder of variants for each; template ids must be unique among the valid ones."""
    spec, (sequences, metadata) = load_library_spec(config), load_output_names(config)
    records = read_fasta(spark, fasta, keep_case=token)
    variants, skipped = build_library(spec, **{"token" if token else "natural": records})
    require_unique(records.join(skipped.select("rec_no"), "rec_no", "left_anti"), "id")
    rows = variants.select(((F.col("rec_no") * spec.variants) + F.col("variant_index")).alias("rec_no"), F.col("variant_id").alias("id"), F.lit("").alias("description"), F.col("sequence").alias("seq"))
    marked = skipped.select("rec_no", F.coalesce("template_id", F.lit("")).alias("id"), "reason", F.col("token_pattern").alias("seq"))
    write_fasta(with_skipped(rows, marked), f"{out}/{sequences}", upper=False)
    if by_template:
        each = variants.select(F.col("variant_index").alias("rec_no"), F.col("variant_id").alias("id"), F.lit("").alias("description"), F.col("sequence").alias("seq"), "template_id")
        write_fasta(each, f"{out}/{sequences}_by_template", upper=False, by="template_id")
    write_csv(variants.drop("rec_no", "sequence"), f"{out}/{metadata}")
    write_csv(skipped.select(F.col("template_id").alias("sequence_id"), "reason", F.coalesce("natural_sequence", "token_pattern").alias("sequence")), f"{out}/skipped")


def _sequences(spark: SparkSession, fasta: str) -> DataFrame:
    """rec_no (the first of the id), variant_id, sequence (the last of the id) of a FASTA file of variants."""
    one = last_of(read_fasta(spark, fasta).where("id is not null"), "id", "rec_no")
    return one.select(F.col("first_place").alias("rec_no"), F.col("id").alias("variant_id"), F.col("seq").alias("sequence"))


def _chosen(spark: SparkSession, rows: DataFrame, mode: str, ids: str | None, assignments: str | None, k: int, seed: int | None, limit: int | None) -> DataFrame:
    """Rows (rec_no, variant_id, others) of the variants that a mode selects, the first ``limit`` of them."""
    listed = read_ids(spark, ids) if ids else None
    assigned = read_csv(spark, assignments, "template_id string, variant_id string, cluster_id int", ["template_id", "variant_id", "cluster_id"]) if assignments else None
    rows = select_ids(rows, mode, "rec_no", listed, assigned, k, seed)
    return rows if limit is None else first_in_order(rows, "rec_no", limit)


def _factory(name: str) -> Callable:
    """``package.module:function``."""
    module, _, function = name.partition(":")
    return getattr(import_module(module), function)


def predict_structures(spark: SparkSession, fasta: str, out: str, client: str, ids: str | None = None, limit: int | None = None, overwrite: bool = False, retries: int = 6, pause: float = 0.2) -> None:
    """Structures of the sequences in ``fasta`` by the service that ``client`` (package.module:function) makes, and a report.

    Those that ``out`` already has are skipped unless ``overwrite``; results are added run by run.
    """
    rows = _chosen(spark, _sequences(spark, fasta), "ids_file" if ids else "all", ids, None, 1, None, limit)
    old = spark.createDataFrame([], "variant_id string") if overwrite or not exists(spark, f"{out}/bodies") else spark.read.parquet(f"{out}/bodies").select("variant_id")
    done = cut(predict(rows, old, _factory(client), RetrySpec(most_retries=retries, per_task_rate=1 / pause)))
    append_index(done.where("status = 'ok'").select("variant_id", "body"), f"{out}/bodies", not overwrite)
    lines = spark.read.parquet(f"{out}/bodies").select("variant_id", F.posexplode(F.split("body", "\r\n|\n")).alias("line_no", "line"))
    write_structures(lines, f"{out}/structures")
    write_csv(done.select("variant_id", F.concat(F.lit(f"{out}/structures/variant_id="), "variant_id").alias("out_pdb_path"), "status", "reason", "status_code", "attempts", "elapsed_seconds"), f"{out}/report")
    write_ids(done.where("status = 'failed'"), f"{out}/failed")


def embed_sequences(
    spark: SparkSession, fasta: str, out: str, model: str, mode: str = "all", ids: str | None = None, assignments: str | None = None, k: int = 5, seed: int | None = None, limit: int | None = None,
    overwrite: bool = False, batch: int = 1, most: int | None = None, device: str = "cpu",
) -> None:
    """Vectors of the residues of chosen sequences by ``model`` (package.module:function), as a table, and an index row per sequence.

    Sequences with vectors from before are skipped unless ``overwrite``; if such vectors belong to another sequence or
    model, that is an error.
    """
    rows = cut(_chosen(spark, _sequences(spark, fasta), mode, ids, assignments, k, seed, limit))
    old = spark.createDataFrame([], "variant_id string")
    if not overwrite and exists(spark, f"{out}/vectors"):
        stored = spark.read.parquet(f"{out}/vectors").where("pos = 0").select("variant_id", "stored_sequence", "stored_model")
        old = cut(rows.join(stored, "variant_id"))
        other = [r[0] for r in old.where((F.col("sequence") != F.col("stored_sequence")) | (F.col("stored_model") != model)).select("variant_id").limit(20).collect()]
        if other:
            raise ValueError(f"vectors of another sequence or model: {other}")
    made = cut(embed(rows, old, _factory(model), batch, most))
    vectors = made.where("pos is not null").join(rows.select("variant_id", F.col("sequence").alias("stored_sequence")), "variant_id").withColumn("stored_model", F.lit(model))
    append_index(vectors.drop("error"), f"{out}/vectors", not overwrite)
    assigned = read_csv(spark, assignments, "template_id string, variant_id string, cluster_id int", ["template_id", "variant_id", "cluster_id"]).withColumn("row_id", F.monotonically_increasing_id()) if assignments else None
    append_index(index_rows(rows, made, old, assigned, model, device, "vectors"), f"{out}/index", True)


def metrics(
    spark: SparkSession, structures: str, secondary: str, out: str, metadata: str | None = None, fasta: str | None = None, motifs: tuple[str, ...] = (), width: int = 8, most_rasa: float = 0.25, least_cosine: float = 0.2,
    ungated: bool = False, skip: str | None = None, group: str = "template_id", model: int = 0,
) -> None:
    """Metrics of every structure with secondary structure, the skipped ones, and the summary per group.

    Left out are the residues that ``skip`` (a file of positions) names and those that a motif covers in the sequence.
    ``width`` 0 takes whole helices. ``model`` picks the model whose residues ``secondary`` describes and must exist.
    """
    if motifs and not fasta:
        raise ValueError("motifs need the sequences")
    lines = read_lines(spark, structures)
    atom_rows = cut(one_location(atoms(lines)))
    ids = lines.select("variant_id", "path").distinct()
    has_model = atom_rows.where(F.col("model_idx") == model).select("variant_id").distinct()
    reasons = ids.join(has_model, "variant_id", "left_anti").select("variant_id", "path", F.lit(f"no atoms of model {model}").alias("reason"))
    left_out = None
    if skip or motifs:
        fixed = read_positions(spark, skip).agg(F.collect_set("position").alias("fixed")) if skip else spark.range(1).select(F.array().cast("array<int>").alias("fixed"))
        named = ids.select("variant_id").crossJoin(F.broadcast(fixed))  # one row
        hits = F.array().cast("array<int>")
        if motifs:
            named = named.join(_sequences(spark, fasta or "").select("variant_id", "sequence"), "variant_id", "left")
            reasons = reasons.unionByName(ids.join(named.where("sequence is null"), "variant_id", "left_semi").join(reasons, "variant_id", "left_anti").select("variant_id", "path", F.lit("no sequence to find motifs in").alias("reason")))
            hits = F.concat(*[motif_positions(F.col("sequence"), m) for m in motifs])
        left_out = named.select("variant_id", F.array_distinct(F.concat("fixed", F.coalesce(hits, F.array().cast("array<int>")))).alias("positions"))
    ranges = ids.withColumn("ranges", topology_ranges(F.col("variant_id"), width or None))
    topology = bundle_topology(helix_centroids(atom_rows, ranges.where("ranges is not null")))
    rows = residue_metrics(residues(read_lines(spark, secondary, "*.dssp")), left_out).join(mean_bfactor(atom_rows, left_out), "variant_id").join(ranges, "variant_id").join(topology.drop("cosine", "angle_degrees", "reason"), "variant_id", "left")
    rows = rows.join(reasons, "variant_id", "left_anti")
    g = gate(F.col("mean_hydrophobic_rasa"), F.col("abs_cosine"), F.col("ranges").isNotNull(), not ungated, most_rasa, least_cosine)
    rows = rows.withColumn("g", g).select(
        "variant_id", F.col("path").alias("pdb_path"), "helix_fraction", "mean_hydrophobic_rasa", "mean_all_atom_bfactor", "n_res_dssp", "n_helix_res", "n_hydrophobic_res", F.col("g.flag").alias("mean_hydrophobic_rasa_leq_threshold"),
        F.col("g.checked").alias("topology_checked_for_rasa_success"), F.col("g.bad").alias("bad_topology_among_rasa_passers"), F.col("g.success").alias("rasa_success_after_topology_gate"),
        F.col("abs_cosine").alias("topology_abs_cosine_similarity"), F.col("folded_angle_degrees").alias("topology_folded_angle_degrees"), F.col("g.reason").alias("topology_failure_reason"), written(F.col("ranges")).alias("topology_helix_ranges"),
        F.when(F.col("ranges").isNotNull(), F.lit("variant_id" if width else "variant_id_full")).alias("topology_helix_range_source"), "note",
    )
    rows = cut(rows)
    write_csv(rows, f"{out}/metrics")
    rest = ids.join(rows, "variant_id", "left_anti").join(reasons, "variant_id", "left_anti").select("variant_id", "path", F.lit("no secondary structure").alias("reason"))
    write_csv(reasons.unionByName(rest).withColumnRenamed("path", "pdb_path"), f"{out}/skipped")
    grouped = rows.withColumn("group_id", default_group(F.col("variant_id")))
    if metadata:
        named = read_csv(spark, metadata, f"variant_id string, `{group}` string", ["variant_id", group]).withColumn("row_id", F.monotonically_increasing_id())
        grouped = with_group(rows, named, group)  # the last row of a variant counts
    write_csv(summary(grouped), f"{out}/summary")


def _by_template(spark: SparkSession, structures: str) -> DataFrame:
    return alpha_coordinates(atoms(read_lines(spark, structures))).select(default_group(F.col("variant_id")).alias("group_id"), F.col("variant_id").alias("item"), "coords")


def _filtered(spark: SparkSession, structures: str, metrics: str, metadata: str, spec: ClusterSpec, most_rasa: float, least_cosine: float, helices: tuple[tuple[int, int], ...]) -> DataFrame:
    """Assignments of every variant in ``metadata``, clustered without bad topology among those within the rASA limit."""
    lines = read_lines(spark, structures)
    atom_rows = cut(one_location(atoms(lines)))
    variants = read_csv(spark, metadata, "variant_id string, template_id string", ["variant_id", "template_id"]).na.drop().distinct()
    variants = cut(variants.join(lines.select("variant_id", F.lit(True).alias("has")).distinct(), "variant_id", "left"))
    files = variants.groupBy("template_id").agg(F.count("has").alias("n_files"))
    there = variants.where("has").drop("has").join(files, "template_id")
    measured = read_csv(spark, metrics, "variant_id string, mean_hydrophobic_rasa double", ["variant_id", "mean_hydrophobic_rasa"]).dropDuplicates(["variant_id"]).withColumnRenamed("mean_hydrophobic_rasa", "rasa")
    ranges = there.select("variant_id").distinct().withColumn("ranges", F.array(*[F.struct(F.lit(x).alias("start"), F.lit(y).alias("end")) for x, y in helices]))
    topology = bundle_topology(helix_centroids(atom_rows, ranges))
    checked = connectivity_filter(there.join(measured, "variant_id", "left").select("template_id", "variant_id", "n_files", "rasa"), topology, most_rasa, least_cosine)
    # a lone structure is not checked, as there is nothing to cluster
    checked = cut(checked.withColumn("kept", F.col("kept") | (F.col("n_files") < 2)))
    coords = F.coalesce("coords", F.array().cast("array<double>")).alias("coords")
    kept = checked.where("kept").join(alpha_coordinates(atom_rows), "variant_id", "left").select(F.col("template_id").alias("group_id"), F.col("variant_id").alias("item"), coords)
    done = cut(cluster_groups(kept, spec).withColumnsRenamed({"group_id": "template_id", "item": "variant_id"}))
    dropped = checked.where("not kept")
    rows = assignment_rows(done, variants.where("has is null"), dropped)
    failed = done.where(F.col("note").startswith("cluster_failed")).groupBy("template_id").agg(F.max("note").alias("failed"))
    rows = rows.join(files, "template_id").join(failed, "template_id", "left").join(dropped.select("template_id", "variant_id", F.col("note").alias("why")), ["template_id", "variant_id"], "left")
    few = F.when((F.col("n_files") < 2) & (F.col("note") == "missing_pdb"), "missing_pdb_or_too_few_structures").when((F.col("n_files") >= 2) & (F.col("note") == "too_few_structures"), "too_few_structures_after_filtering")
    return rows.withColumn("note", F.coalesce("failed", few, "why", "note")).drop("n_files", "failed", "why")


def cluster(
    spark: SparkSession, structures: str, out: str, spec: ClusterSpec = ClusterSpec(), metrics: str | None = None, metadata: str | None = None, most_rasa: float = 0.25, least_cosine: float = 0.2,
    helices: tuple[tuple[int, int], ...] = ((3, 10), (20, 26), (36, 44), (54, 60)),
) -> None:
    """Cluster assignments and medoids of the structures of each template.

    With metrics and metadata of the library, structures with bad topology among those within the rASA limit are left out
    first, templates are those of the metadata, and missing and filtered variants have a row too. Without them every
    structure is clustered, by the template in its id.
    """
    if bool(metrics) != bool(metadata):
        raise ValueError("metrics and metadata are needed together")
    if metrics and metadata:
        rows = cut(_filtered(spark, structures, metrics, metadata, spec, most_rasa, least_cosine, helices))
    else:
        rows = cut(cluster_groups(_by_template(spark, structures), spec)).withColumnsRenamed({"group_id": "template_id", "item": "variant_id"})
    write_csv(rows, f"{out}/assignments")
    write_csv(rows.where("is_medoid").select("template_id", "cluster_id", F.col("variant_id").alias("medoid_variant_id")), f"{out}/medoids")
    # one folder per template, and a line on each
    rows.repartitionByRange("template_id", "variant_id").withColumn("template", F.col("template_id")).write.mode("overwrite").partitionBy("template").option("header", True).csv(f"{out}/templates")
    each = rows.groupBy("template_id").agg(F.count(F.lit(1)).alias("n_variants"), F.count("cluster_id").alias("n_clustered"), F.max("n_clusters").alias("n_clusters"), F.max("cutoff").alias("cutoff"), F.max("silhouette").alias("silhouette"))
    write_csv(each.withColumn("linkage", F.lit(spec.linkage)), f"{out}/summary")


def average(spark: SparkSession, structures: str, assignments: str, out: str, align: str = "CA", atoms_of: str = "N,CA,C") -> None:
    """The mean of some atoms of each cluster, superposed on others, written into its reference member's lines, and the manifest."""
    rows = read_csv(spark, assignments, "template_id string, variant_id string, cluster_id int, is_medoid boolean, cutoff double, silhouette double, n_clusters int, note string", ["template_id", "variant_id", "cluster_id"])
    lines = read_lines(spark, structures)
    parts = cut(backbone(atoms(lines), atom_names(align), atom_names(atoms_of)))
    members = rows.where("cluster_id is not null").join(parts, "variant_id", "left")
    mean, manifest = average_clusters(members.select(F.col("template_id").alias("group_id"), "cluster_id", F.col("variant_id").alias("item"), "is_medoid", "coords", "moved", "layout"))
    mean, manifest = cut(mean), cut(manifest)
    chosen = manifest.select("group_id", "cluster_id", F.col("reference").alias("variant_id"))
    places = chosen.join(parts, "variant_id").select("group_id", "cluster_id", F.posexplode("lines").alias("atom", "line_no"))
    moved = mean.join(places, ["group_id", "cluster_id", "atom"]).select("group_id", "cluster_id", "line_no", F.format_string("%8.3f%8.3f%8.3f", "x", "y", "z").alias("at"))
    made = chosen.join(mean.select("group_id", "cluster_id").distinct(), ["group_id", "cluster_id"]).join(lines, "variant_id").join(moved, ["group_id", "cluster_id", "line_no"], "left")
    named = F.concat("group_id", F.format_string("_cluster%03d_avg", "cluster_id"))
    line = F.when(F.col("at").isNotNull(), F.concat(F.substring("line", 1, 30), "at", F.expr("substring(line, 55)"))).otherwise(F.col("line"))
    write_structures(made.select(named.alias("variant_id"), "line_no", line.alias("line")), f"{out}/structures")
    write_csv(mean, f"{out}/mean")
    note = F.when(F.col("reference").isNull(), f"average_failed: no member has {align} atoms").when(F.col("layout").endswith(" alone"), F.concat(F.lit(f"no residue has {atoms_of}: "), "layout"))
    # folders of variants have special characters escaped, so their names come from what was written
    written_to = spark.read.schema("value string, variant_id string").text(f"{out}/structures").select(F.col("variant_id").alias("named"), F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("out_pdb_path")).groupBy("named").agg(F.min("out_pdb_path").alias("out_pdb_path"))
    manifest = manifest.join(parts.select(F.col("variant_id").alias("reference"), "layout"), "reference", "left").withColumns({"named": named, "note": note}).join(written_to, "named", "left")
    write_csv(manifest.select("group_id", "cluster_id", "reference", "n_total", "n_used", "n_skipped", "out_pdb_path", "skipped", "note"), f"{out}/manifest")


def _vectors(spark: SparkSession, vectors: str) -> DataFrame:
    """variant_id, pos, vec, reason from the table of the step embed, or from ``.npz`` files."""
    if exists(spark, f"{vectors}/_SUCCESS"):
        return spark.read.parquet(vectors).select("variant_id", "pos", "vec", F.lit(None).cast("string").alias("reason"))
    return read_vectors(spark, vectors)


def pca(spark: SparkSession, vectors: str, out: str, k: int = 10, ids: str | None = None, limit: int | None = None, most: int | None = None, no_scores: bool = False) -> None:
    """The model over all residue vectors (of the ids given, of the first ``limit`` variants, of at most ``most`` residues in order), a report of one row, and the scores."""
    rows = _vectors(spark, vectors).where("reason is null").drop("reason")
    if ids:
        rows = only(rows, read_ids(spark, ids).withColumnRenamed("id", "variant_id"), "variant_id")
    if limit is not None:
        rows = only(rows, first_in_order(rows.select("variant_id").distinct(), "variant_id", limit), "variant_id")
    rows = cut(rows)
    used = rows
    if most is not None:
        kept = capped(rows.groupBy("variant_id").agg(F.count(F.lit(1)).alias("n")), "variant_id", "n", most)
        used = rows.join(kept.select("variant_id", "used"), "variant_id").where("pos < used").drop("used")
    model = fit_pca(used, "vec", k)
    save_pca(spark, model, f"{out}/model")
    n = used.select("variant_id").distinct().count()
    written = ";".join
    line = (len(model.components), n, model.n, len(model.mean), written(f"{x:.8f}" for x in model.explained), written(f"{x:.8f}" for x in model.singular))
    write_csv(spark.createDataFrame([line], "n_components int, n_sequences long, n_residues_used long, embedding_dim int, explained_variance_ratio string, singular_values string"), f"{out}/report")
    if not no_scores:
        project(rows, "vec", model).drop("vec").write.mode("overwrite").parquet(f"{out}/scores")


def write_scores(spark: SparkSession, structures: str, vectors: str, model: str, out: str, which: int = 1, ids: str | None = None, limit: int | None = None, overwrite: bool = False) -> None:
    """Structures with component ``which`` in the B-factor column, and a report with a row per variant that has scores or vectors.

    Stored scores come first; only vectors of variants without any are projected. Variants with a result from before are
    skipped unless ``overwrite``.
    """
    found = _vectors(spark, vectors)
    rows = found.where("reason is null").drop("reason")
    stored = spark.read.parquet(f"{model}/scores") if exists(spark, f"{model}/scores") else spark.createDataFrame([], "variant_id string, pos int, pc array<float>")
    fresh = without(rows, stored, "variant_id")
    selected = cut(found.select("variant_id").unionByName(stored.select("variant_id")).distinct())
    if ids:
        selected = only(selected, read_ids(spark, ids).withColumnRenamed("id", "variant_id"), "variant_id")
    if limit is not None:
        selected = first_in_order(selected, "variant_id", limit)
    results = f"{out}/pc{which}"
    old = spark.read.parquet(f"{results}/lines").select("variant_id").distinct() if not overwrite and exists(spark, f"{results}/lines") else selected.where("false")
    old = cut(old)
    scores = cut(only(available_scores(stored, project(fresh, "vec", load_pca(spark, f"{model}/model")).drop("vec"), which), without(selected, old, "variant_id"), "variant_id"))
    unusable = usable_scores(scores)
    lines = cut(only(read_lines(spark, structures), selected, "variant_id"))
    done = cut(overlay(only(without(lines, unusable, "variant_id"), scores, "variant_id"), without(scores, unusable, "variant_id")))
    append_index(done, f"{results}/lines", not overwrite)
    write_structures(spark.read.parquet(f"{results}/lines"), f"{results}/structures")
    write_csv(whole_report(selected, lines, old, unusable, overlay_report(done, only(without(scores, unusable, "variant_id"), lines, "variant_id"))), f"{out}/report")


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quartzfold")
    steps = parser.add_subparsers(dest="step", required=True)
    whole, real, flag = {"type": int}, {"type": float}, {"action": "store_true"}
    some = {"--ids": {}, "--limit": whole, "--overwrite": flag}
    gates = {"--most-rasa": real | {"default": 0.25}, "--least-cosine": real | {"default": 0.2}}
    options = {
        "library": (library, ["--fasta", "--config", "--out"], {"--token": flag, "--by-template": flag}),
        "predict": (predict_structures, ["--fasta", "--out", "--client"], some | {"--retries": whole | {"default": 6}, "--pause": real | {"default": 0.2}}),
        "metrics": (metrics, ["--structures", "--secondary", "--out"], gates | {"--metadata": {}, "--fasta": {}, "--motifs": {"nargs": "*", "default": ()}, "--width": whole | {"default": 8}, "--ungated": flag, "--skip": {}, "--group": {"default": "template_id"}, "--model": whole | {"default": 0}}),
        "cluster": (cluster, ["--structures", "--out"], gates | {"--metrics": {}, "--metadata": {}, "--linkage": {"default": "single"}, "--cutoffs": whole | {"default": 50}, "--low": real | {"default": 0.05}, "--high": real | {"default": 0.95}, "--least": whole | {"default": 2}, "--greatest": whole | {"default": 20}, "--fixed": real}),
        "average": (average, ["--structures", "--assignments", "--out"], {"--align": {"default": "CA"}, "--atoms-of": {"default": "N,CA,C"}}),
        "embed": (embed_sequences, ["--fasta", "--out", "--model"], some | {"--mode": {"default": "all"}, "--assignments": {}, "--k": whole | {"default": 5}, "--seed": whole, "--batch": whole | {"default": 1}, "--most": whole, "--device": {"default": "cpu"}}),
        "pca": (pca, ["--vectors", "--out"], {"--k": whole | {"default": 10}, "--ids": {}, "--limit": whole, "--most": whole, "--no-scores": flag}),
        "overlay": (write_scores, ["--structures", "--vectors", "--model", "--out"], some | {"--which": whole | {"default": 1}}),
    }
    for name, (f, required, others) in options.items():
        p = steps.add_parser(name, help=f.__doc__)
        for o in required:
            p.add_argument(o, required=True)
        for o, how in others.items():
            p.add_argument(o, **how)
    given = vars(parser.parse_args(arguments))
    spark = SparkSession.builder.appName("quartzfold").getOrCreate()
    ship(spark)
    step = given.pop("step")
    if step == "cluster":
        given["spec"] = ClusterSpec(**{k: given.pop(k) for k in ("linkage", "cutoffs", "low", "high", "least", "greatest", "fixed")})
    options[step][0](spark, **{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})
    drop_cuts(spark)  # all results are written


if __name__ == "__main__":
    main()
