"""Queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzfold.llm.clusters import Alike, loose_parts, similar_groups, typical, usable
from quartzfold.llm.encode import encode_corpus
from quartzfold.llm.packing import filling, pack
from quartzfold.llm.selection import varied_subset
from quartzfold.llm.subjects import fit_subjects, subject_shares, subjects_of
from quartzfold.llm.top_n import latest_value, top_n
from quartzfold.operators.references import same_path
from quartzfold.session import cut, table


def vocabulary(spark: SparkSession, name: str = "byte_bpe_50k.tiktoken") -> str:
    """A vocabulary file in the folder named by the setting quartzfold.tokenizers, or QUARTZFOLD_TOKENIZERS."""
    return f"{spark.conf.get('quartzfold.tokenizers', None) or os.environ.get('QUARTZFOLD_TOKENIZERS', '/opt/tokenizers')}/{name}"


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five variants of each template with the lowest mean hydrophobic rASA."""
    measured = latest_value(table(spark, sf_dir, "structural_metrics").where("variant_id is not null"), "variant_id", "row_id", "mean_hydrophobic_rasa")
    usable = measured.where("mean_hydrophobic_rasa between 0 and 1")  # NaN counts as above 1
    assigned = table(spark, sf_dir, "cluster_assignments").select("template_id", "variant_id").na.drop().distinct()
    return top_n(assigned.join(usable, "variant_id"), ["template_id"], "mean_hydrophobic_rasa", "variant_id", 5).select("template_id", "variant_id")


def embedded_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants with a usable vector: node (the row_id of the first row that leads to one), name (variant_id), vector.

    Rows are ranged by variant, so that variants of a template, which are often alike, meet in one chunk.
    """
    files = table(spark, sf_dir, "embedding_files").where(usable(F.col("emb_mean"), Alike.dim)).select(same_path(F.col("embedding_path")).alias("path"), F.col("emb_mean").alias("vector"))
    rows = table(spark, sf_dir, "embeddings_index").where("status in ('ok', 'skipped') and variant_id is not null")
    rows = rows.groupBy("variant_id", same_path(F.col("embedding_path")).alias("path")).agg(F.min("row_id").alias("row_id"))
    found = rows.join(files.groupBy("path").agg(F.min("vector").alias("vector")), "path").repartitionByRange("variant_id")
    return found.groupBy(F.col("variant_id").alias("name")).agg(F.min(F.struct("row_id", "vector")).alias("first")).select(F.col("first.row_id").alias("node"), "name", F.col("first.vector").alias("vector"))


def choosable_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants with a cluster and a usable vector: item, name, template_id, cluster_id, group, preferred (a medoid), vector.

    The cluster is that of the variant's row with the highest row_id that has a template and a cluster; a group is known
    by the least row_id of such rows.
    """
    rows = table(spark, sf_dir, "cluster_assignments").where("variant_id is not null and template_id is not null and cluster_id is not null")
    latest = rows.groupBy(F.col("variant_id").alias("name")).agg(F.max(F.struct("row_id", "template_id", "cluster_id", F.coalesce("is_medoid", F.lit(False)).alias("preferred"))).alias("a"))
    latest = latest.select("name", "a.*")
    group = latest.groupBy("template_id", "cluster_id").agg(F.min("row_id").alias("group"))
    vectors = embedded_variants(spark, sf_dir).withColumnRenamed("node", "item")
    return vectors.join(latest.join(group, ["template_id", "cluster_id"]).drop("row_id"), "name")


def _selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = cut(choosable_variants(spark, sf_dir))
    specs = table(spark, sf_dir, "selection_specs").where("selection_mode = 'cluster_sample_k'")
    chosen = varied_subset(items.select("item", "group", "preferred", "vector"), specs, Alike.dim)
    return chosen.join(items.select("item", F.col("name").alias("variant_id"), "template_id", "cluster_id"), "item").drop("item")


def p4_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subset that each row of selection_specs asks for."""
    return _selected(spark, sf_dir)


def p4_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants, templates and clusters in each subset, and the most from one cluster."""
    each = _selected(spark, sf_dir).groupBy("spec_id", "template_id", "cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("spec_id").agg(F.sum("n").alias("n_variants"), F.count_distinct("template_id").alias("n_templates"), F.count(F.lit(1)).alias("n_clusters"), F.max("n").alias("most_in_cluster"))


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants in each subset."""
    return _selected(spark, sf_dir).groupBy("spec_id").agg(F.count(F.lit(1)).alias("n_variants"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of each cluster of alike vectors but the first, with the first."""
    nodes = cut(embedded_variants(spark, sf_dir))
    named, _ = similar_groups(nodes)
    first = named.groupBy("cluster").agg(F.min("name").alias("first_variant_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("cluster", "first_variant_id")
    return named.join(first, "cluster").where("name <> first_variant_id").select("first_variant_id", F.col("name").alias("variant_id"))


def p5_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label per variant: its cluster, and its part of a loose cluster."""
    nodes = cut(embedded_variants(spark, sf_dir))
    labels, links = similar_groups(nodes)
    parts = loose_parts(labels, links, nodes)
    return parts.select(F.col("name").alias("variant_id"), F.col("cluster").alias("label"), F.col("part").alias("part_label"))


def p5_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size and the three most typical members of every cluster, or of every part of a loose one."""
    nodes = cut(embedded_variants(spark, sf_dir))
    parts = cut(loose_parts(*similar_groups(nodes), nodes))
    whole = parts.groupBy("part").agg(F.min("cluster").alias("label"))
    best = typical(parts.select("node", "name", F.col("part").alias("cluster")), nodes)
    return best.join(whole, F.col("cluster") == F.col("part")).select("label", F.col("part").alias("part_label"), "size", "typical")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text", vocabulary(spark))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text", vocabulary(spark), count_only=True)
    return pack(sizes, table(spark, sf_dir, "containers"), "doc_id")


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, or of each piece of one, for each kind of container."""
    return _packed(spark, sf_dir)


def p7_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each kind are."""
    return filling(_packed(spark, sf_dir), table(spark, sf_dir, "containers"))


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return subjects_of(documents, fit_subjects(documents, table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subject_areas")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subject areas of every post's own prose."""
    return _subjects(spark, sf_dir).select("doc_id", "subject")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each subject area in the corpus."""
    return subject_shares(_subjects(spark, sf_dir), table(spark, sf_dir, "documents"))


QUERIES = {"p3_found": p3_found, "p4_subsets": p4_subsets, "p4_sizes": p4_sizes, "p4_counts": p4_counts, "p5_found": p5_found, "p5_labels": p5_labels, "p5_clusters": p5_clusters, "p6_ids": p6_ids, "p7_packed": p7_packed, "p7_filling": p7_filling, "p8_found": p8_found, "p8_shares": p8_shares}
_PATH = r"regexp_replace(regexp_replace(embedding_path, '^(?:\./)+', ''), '/(?:\.?/)+', '/', 'g')"
_FILES = f"""SELECT DISTINCT {_PATH} AS path, emb_mean::DOUBLE[] AS v FROM embedding_files
  WHERE len(emb_mean) = 16 AND len(list_filter(emb_mean, lambda x: x IS NOT NULL AND isfinite(x))) = 16 AND len(list_filter(emb_mean, lambda x: x <> 0)) > 0"""
_NEAR = f"""
WITH RECURSIVE files AS ({_FILES}), one AS (SELECT path, min(v) AS v FROM files GROUP BY path),
nodes AS MATERIALIZED (SELECT variant_id, min(row_id) AS node, arg_min(v, row_id)::DOUBLE[16] AS v FROM embeddings_index JOIN one ON path = {_PATH}
  WHERE status IN ('ok', 'skipped') AND variant_id IS NOT NULL GROUP BY variant_id),
near AS MATERIALIZED (SELECT x.node AS a, y.node AS b FROM nodes x, nodes y WHERE array_distance(x.v, y.v) <= 1.0),
least AS (SELECT a, min(b) AS b FROM near GROUP BY a),
links AS MATERIALIZED (SELECT DISTINCT l.b AS a, m.b AS b FROM near JOIN least l ON l.a = near.a JOIN least m ON m.a = near.b),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
heads AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
labelled AS MATERIALIZED (SELECT node, variant_id, heads.b AS cluster FROM nodes JOIN least ON least.a = node JOIN heads ON heads.a = least.b)"""
# a cluster is loose if a member is further than the radius from its mean; its members follow the one with the most alike ones
_PARTS = """, centre AS (SELECT cluster, i, avg(v[i]) AS m FROM labelled JOIN nodes USING (node), range(1, 17) d(i) GROUP BY ALL),
loose AS (SELECT DISTINCT cluster FROM (SELECT cluster, node, sqrt(sum((v[i] - m) ** 2)) AS o FROM labelled JOIN nodes USING (node) JOIN centre USING (cluster) GROUP BY ALL) WHERE o > 1.0),
degree AS (SELECT a, count(*) AS n FROM near GROUP BY a),
follows AS (SELECT near.a AS node, near.b AS medoid FROM near JOIN degree ON degree.a = near.b QUALIFY row_number() OVER (PARTITION BY near.a ORDER BY n DESC, near.b) = 1),
parts AS MATERIALIZED (SELECT node, labelled.variant_id, cluster, CASE WHEN cluster IN (SELECT cluster FROM loose) THEN medoid ELSE cluster END AS part FROM labelled JOIN follows USING (node))"""
SQL = {
    "p3_found": """
WITH latest AS (SELECT variant_id, mean_hydrophobic_rasa AS v FROM structural_metrics QUALIFY row_number() OVER (PARTITION BY variant_id ORDER BY row_id DESC) = 1),
pairs AS (SELECT DISTINCT template_id, variant_id FROM cluster_assignments WHERE template_id IS NOT NULL AND variant_id IS NOT NULL)
SELECT template_id, variant_id FROM pairs JOIN latest USING (variant_id) WHERE v IS NOT NULL AND NOT isnan(v) AND v BETWEEN 0 AND 1
QUALIFY row_number() OVER (PARTITION BY template_id ORDER BY v, variant_id) <= 5""",
    # what is asked for, or all that the limit per cluster leaves
    "p4_counts": f"""
WITH files AS ({_FILES}), one AS (SELECT path, min(v) AS v FROM files GROUP BY path),
embedded AS (SELECT DISTINCT variant_id FROM embeddings_index JOIN one ON path = {_PATH} WHERE status IN ('ok', 'skipped') AND variant_id IS NOT NULL),
latest AS (SELECT variant_id, template_id, cluster_id FROM cluster_assignments WHERE variant_id IS NOT NULL AND template_id IS NOT NULL AND cluster_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY variant_id ORDER BY row_id DESC) = 1),
sized AS (SELECT template_id, cluster_id, count(*) AS n FROM latest SEMI JOIN embedded USING (variant_id) GROUP BY ALL),
room AS (SELECT spec_id, sum(least(n, k_per_cluster)) AS room, any_value(coalesce(subset_size, floor(subset_share * (SELECT sum(n) FROM sized) + 0.5), (SELECT sum(n) FROM sized))) AS wanted
  FROM selection_specs, sized WHERE selection_mode = 'cluster_sample_k' AND k_per_cluster > 0 GROUP BY spec_id)
SELECT spec_id, least(room, wanted)::BIGINT AS n_variants FROM room WHERE least(room, wanted) > 0""",
    # all pairs by distance, then the least member that links lead to; fit for small tables only
    "p5_found": f"""{_NEAR}, name AS (SELECT cluster, min(variant_id) AS first FROM labelled GROUP BY cluster)
SELECT first AS first_variant_id, variant_id FROM labelled JOIN name USING (cluster) WHERE variant_id <> first""",
    "p5_labels": f"{_NEAR}{_PARTS} SELECT variant_id, cluster AS label, part AS part_label FROM parts",
    "p5_clusters": f"""{_NEAR}{_PARTS}, mean AS (SELECT part, i, avg(v[i]) AS m FROM parts JOIN nodes USING (node), range(1, 17) d(i) GROUP BY ALL),
off AS (SELECT part, parts.variant_id, round(sqrt(sum((v[i] - m) ** 2)), 9) AS o FROM parts JOIN nodes USING (node) JOIN mean USING (part) GROUP BY ALL),
best AS (SELECT part, list(variant_id ORDER BY o, variant_id)[1:3] AS typical FROM off GROUP BY part)
SELECT min(cluster) AS label, part AS part_label, count(*) AS size, any_value(typical) AS typical FROM parts JOIN best USING (part) GROUP BY part""",
}
