"""Queries over files that are written from the tables and read back, and over calls for each row, with SQL for comparison."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzfold.constants import HYDROPHOBIC, MAX_SURFACE, POLAR
from quartzfold.operators.external import RetrySpec, embed, index_problems, index_rows, predict
from quartzfold.operators.library import LibrarySpec, build_library, last_of
from quartzfold.operators.references import same_path
from quartzfold.operators.selecting import latest, select_ids
from quartzfold.plans.library import _BAD, _LISTED
from quartzfold.plans.quality import _PATH
from quartzfold.plans.structures import _LATEST, _PTS, _atoms
from quartzfold.session import cut, scratch, table
from quartzfold.sinks.files import append_index, with_skipped, write_csv, write_fasta, write_ids
from quartzfold.sources.fasta import read_fasta, read_token_fasta
from quartzfold.sources.lists import read_csv, read_ids, read_positions
from quartzfold.sources.structures import atoms, one_location, residues

SPEC = LibrarySpec(("A", "L", "V"), ("D", "E", "K", "Q"), variants=3, seed=7)


def fasta_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants as FASTA records, written and read again."""
    rows = table(spark, sf_dir, "variants").select(F.col("row_id").alias("rec_no"), F.col("variant_id").alias("id"), F.concat(F.lit("template="), "template_id").alias("description"), F.col("token_pattern").alias("seq"))
    path = scratch(spark)
    write_fasta(rows, path, upper=False)
    return read_fasta(spark, path, keep_case=True).select("id", "description", "seq")


def token_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts read as token records: most are not valid, and say why."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rec_no"), F.col("p_partkey").cast("string").alias("id"), F.lit("").alias("description"), F.col("p_name").alias("seq"))
    path = scratch(spark)
    write_fasta(rows, path, upper=False)
    return read_token_fasta(spark, path).select("id", "seq", "reason")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per template: the pattern of its first row."""
    first = table(spark, sf_dir, "variants").groupBy("template_id").agg(F.min(F.struct("row_id", "token_pattern")).alias("r"))
    return first.select(F.col("r.row_id").alias("rec_no"), F.col("template_id").alias("id"), F.lit("").alias("description"), F.col("r.token_pattern").alias("seq"))


def library_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three variants of every template from its token pattern."""
    return build_library(SPEC, token=_records(spark, sf_dir))[0].select("variant_id", "template_id", "variant_index", "token_pattern", "hydrophobic_pool", "polar_pool", "sequence")


def library_natural(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three variants of every template from its pattern's letters taken as residues, with their recovery."""
    made = build_library(SPEC, natural=_records(spark, sf_dir))[0]
    return made.select("variant_id", "token_pattern", F.round("recovery_to_natural", 9).alias("recovery"), "sequence")


def library_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts that can't be templates, with the reason."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rec_no"), F.col("p_partkey").cast("string").alias("id"), F.lit("").alias("description"), F.col("p_name").alias("seq"))
    return build_library(SPEC, natural=rows)[1].select("template_id", "reason")


def library_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants and, after them, the skipped names of parts with a mark and their reason, written as FASTA and read again."""
    made, _ = build_library(SPEC, token=_records(spark, sf_dir))
    rows = made.select(((F.col("rec_no") * SPEC.variants) + F.col("variant_index")).alias("rec_no"), F.col("variant_id").alias("id"), F.lit("").alias("description"), F.col("sequence").alias("seq"))
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rec_no"), F.col("p_partkey").cast("string").alias("id"), F.lit("").alias("description"), F.col("p_name").alias("seq"))
    skipped = build_library(SPEC, natural=names)[1].select("rec_no", F.col("template_id").alias("id"), "reason", F.lit(None).cast("string").alias("seq"))
    path = scratch(spark)
    write_fasta(with_skipped(rows, skipped), path, upper=False)
    return read_fasta(spark, path, keep_case=True).select("id", "description", "seq")


def positions_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of residues as a file of comma-separated positions with comments, read as different positions."""
    rows = table(spark, sf_dir, "embeddings_index").select(F.concat_ws(", ", F.col("sequence_length").cast("string"), (F.col("sequence_length") + 1).cast("string"), F.lit("x")).alias("value"))
    path = scratch(spark)
    rows.unionByName(rows.select(F.concat(F.lit("# 7,"), "value").alias("value"))).write.text(path)
    return read_positions(spark, path)


def last_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_of(table(spark, sf_dir, "variants").select("row_id", "variant_id", "template_id", "token_pattern"), "variant_id", "row_id")


def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions as CSV, written and read again with their types, and a column that isn't there."""
    path = scratch(spark)
    write_csv(table(spark, sf_dir, "predictions").select("row_id", "variant_id", "status", "reason", "status_code", "attempts", "elapsed_seconds"), path)
    return read_csv(spark, path, "row_id bigint, variant_id string, status string, reason string, status_code int, attempts int, elapsed_seconds double, absent string", ["row_id", "variant_id"])


def ids_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of failed predictions as a list, written and read again."""
    path = scratch(spark)
    write_ids(table(spark, sf_dir, "predictions").where("status = 'failed'"), path)
    return read_ids(spark, path).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def index_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest rows of an index that was written in two runs."""
    path, rows = scratch(spark), table(spark, sf_dir, "embeddings_index").select("row_id", "variant_id", "status")
    append_index(rows.where("status = 'ok'"), path)
    append_index(rows.where("status <> 'ok'"), path)
    return latest(spark.read.parquet(path), "variant_id", "row_id")


def atom_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms of structure lines in which every atom has two locations: the likelier one comes out."""
    line = lambda a, b: F.format_string("HETATM%5d  CA %sALA B%4d    %8.3f%8.3f%8.3f%6.2f%6.2f           C", "resseq", F.lit(a), "resseq", F.col("x") + b, "y", "z", F.lit(0.6 if b == 0 else 0.4), F.lit(25.5))
    points = _atoms(spark, sf_dir)
    both = points.select("variant_id", (2 * F.col("resseq") + 1).alias("line_no"), line("A", 0.0).alias("line")).unionByName(points.select("variant_id", (2 * F.col("resseq")).alias("line_no"), line("B", 1.0).alias("line")))
    return one_location(atoms(both)).select("variant_id", "model_idx", "chain_id", "chain_ord", "hetflag", "resseq", "resname", "atom_name", "x", "y", "z", "bfactor")


def residue_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residues of secondary-structure lines, with a chain break after each tenth."""
    letter = F.when(F.col("x") > 0, "L").when(F.col("x") > -0.1, "K").otherwise("b")
    row = F.format_string("%5d%5d A %s  %s%s%4d", "resseq", F.col("resseq") + 100, letter, F.when(F.col("y") > 0, "H").otherwise(" "), F.lit(" " * 17), F.abs(F.col("z") * 1000).cast("int"))
    points = _atoms(spark, sf_dir)
    lines = points.select("variant_id", (2 * F.col("resseq")).alias("line_no"), row.alias("line"))
    breaks = points.where("resseq % 10 = 0").select("variant_id", (2 * F.col("resseq") + 1).alias("line_no"), F.lit("   99        !              0   0    0").alias("line"))
    heads = points.where("resseq = 1").select("variant_id", F.lit(1).alias("line_no"), F.lit("  #  RESIDUE AA STRUCTURE").alias("line"))
    return residues(lines.unionByName(breaks).unionByName(heads)).withColumn("rasa", F.round("rasa", 9))


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "variants"), "variant_id", "row_id").select("row_id", "variant_id", F.col("token_pattern").alias("sequence"))


def _client():
    """A service whose answer follows from the sequence."""
    answers = [(200, "ATOM", None), (429, "", 3.0), (404, "", None), (503, "", None), (200, "<html>", None), (0, "", None)]
    return lambda seq: answers[(len(seq) + seq.count("H")) % 6]


def predict_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of all variants that have none yet."""
    done = table(spark, sf_dir, "predictions").where("status = 'ok'")
    made = predict(_sequences(spark, sf_dir), done, _client, RetrySpec(most_retries=2), sleep=lambda seconds: None)
    return made.select("variant_id", "status", "reason", "status_code", "attempts")


def _model():
    """A model that fails for some sequences and gives numbers that aren't finite for others."""

    def run(seqs: list[str]) -> list[np.ndarray]:
        if any(s.count("H") % 7 == 0 for s in seqs):
            raise RuntimeError("no memory")
        return [np.full((len(s), 2), np.nan if s.count("P") % 9 == 0 else 1.0, np.float32) for s in seqs]

    return run


def embed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of vectors of all variants, with the cluster of each."""
    rows, old = _sequences(spark, sf_dir).drop("row_id"), table(spark, sf_dir, "embeddings_index").where("status = 'ok'")
    made = cut(embed(rows, old, _model, batch=1, most=90))
    return index_rows(rows, made, old, table(spark, sf_dir, "cluster_assignments"), "m", "cpu", "vectors")


def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the index whose last stored vector is of another model than theirs, of another layer than 36, of another implementation, or unusable."""
    path = same_path(F.col("embedding_path"))
    files = table(spark, sf_dir, "embedding_files").groupBy(path.alias("path")).agg(F.max(F.struct("row_id", "emb_mean", "model_name", "representation_layer", "implementation")).alias("r"))
    files = files.select("path", F.col("r.emb_mean").alias("vector"), F.col("r.model_name").alias("stored_model"), F.col("r.representation_layer").alias("stored_layer"), F.col("r.implementation").alias("stored_implementation"))
    index = table(spark, sf_dir, "embeddings_index").where("status in ('ok', 'skipped') and embedding_path is not null").select("variant_id", path.alias("path"), "model_name", F.lit(36).alias("layer"), F.lit("fair").alias("implementation"))
    return index_problems(index, files, 16).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def chosen_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants, at most two of each cluster, by a seed."""
    rows = _sequences(spark, sf_dir).select("row_id", "variant_id")
    return select_ids(rows, "cluster_sample_k", "row_id", assigned=table(spark, sf_dir, "cluster_assignments"), k=2, seed=1)


_FIRST = "(SELECT template_id, arg_min(token_pattern, row_id) AS p FROM variants GROUP BY template_id)"
_POOLS = {"H": "['A', 'L', 'V']", "P": "['D', 'E', 'K', 'Q']"}
_DRAW = lambda t: f"{_POOLS[t]}[1 + ('0x' || substr(d, 4 * (i - 1)::INT + 1, 4))::BIGINT % {4 if t == 'P' else 3}]"
_TEMPLATES = lambda pattern: f"""(SELECT *, array_to_string(list_transform(string_split(t, ''), lambda c, i: CASE c WHEN 'H' THEN {_DRAW('H')} WHEN 'P' THEN {_DRAW('P')} ELSE upper(c) END), '') AS sequence FROM (
SELECT template_id, k AS variant_index, template_id || '_var' || lpad(k::VARCHAR, 4, '0') AS variant_id, p, {pattern} AS t,
  array_to_string(list_transform(range((length(p) + 7) // 8), lambda b: md5(concat_ws('|', '7', template_id, k::VARCHAR, b::VARCHAR))), '') AS d FROM {_FIRST}, (SELECT unnest(range(3))::INT AS k)))"""  # noqa: E731
_TOKENS_OF = f"translate(upper(p), '{HYDROPHOBIC}{POLAR}PCG', '{'H' * len(HYDROPHOBIC)}{'P' * len(POLAR)}pcg')"
_SURFACE = "CASE aa " + " ".join(f"WHEN '{a}' THEN {v}" for a, v in MAX_SURFACE.items()) + " END"
_LAST = f"(SELECT row_id, variant_id, token_pattern AS s FROM {_LATEST('variants')})"
_HEAD = "variant_id || ' template=' || template_id"
_COUNT = lambda c: f"(length(s) - length(replace(s, '{c}', '')))"

QUERIES = {
    f.__name__: f
    for f in (
        fasta_scan, token_scan, library_build, library_natural, library_skipped, library_marked, last_records, csv_scan, ids_scan, positions_scan, index_appended, atom_table, residue_table, predict_report, embed_index,
        stored_vectors, chosen_ids,
    )
}
SQL = {
    "fasta_scan": rf"SELECT regexp_extract(h, '^(\S*)\s*(.*)$', 1) AS id, regexp_extract(h, '^(\S*)\s*(.*)$', 2) AS description, replace(token_pattern, ' ', '') AS seq FROM (SELECT {_HEAD} AS h, token_pattern FROM variants)",
    "token_scan": "SELECT p_partkey::VARCHAR AS id, s AS seq, CASE WHEN s = '' THEN 'Empty token pattern' WHEN regexp_matches(s, '[^HPpcg]') THEN 'Invalid token ''' || regexp_extract(s, '[^HPpcg]') || '''' END AS reason FROM (SELECT p_partkey, replace(p_name, ' ', '') AS s FROM part)",
    "library_build": f"SELECT variant_id, template_id, variant_index, t AS token_pattern, 'A,L,V' AS hydrophobic_pool, 'D,E,K,Q' AS polar_pool, sequence FROM {_TEMPLATES('p')}",
    "library_natural": f"""SELECT variant_id, t AS token_pattern, round(list_sum(list_transform(range(1, length(p) + 1), lambda i: (substr(upper(p), i, 1) = substr(sequence, i, 1))::INT)) / length(p)::DOUBLE, 9) AS recovery, sequence
FROM {_TEMPLATES(_TOKENS_OF)}""",
    "library_skipped": f"""SELECT * FROM (SELECT p_partkey::VARCHAR AS template_id, CASE WHEN s IS NULL OR s = '' THEN 'Empty sequence' WHEN len({_BAD('A-Z')}) > 0 THEN 'Invalid characters: ' || {_LISTED(_BAD('A-Z'))}
WHEN len({_BAD('ACDEFGHIKLMNPQRSTVWY')}) > 0 THEN 'Non-canonical/ambiguous residues present (AA20-only required): ' || {_LISTED(_BAD('ACDEFGHIKLMNPQRSTVWY'))} END AS reason FROM (SELECT p_partkey, upper(trim(p_name)) AS s FROM part)) WHERE reason IS NOT NULL""",
    "library_marked": f"""SELECT variant_id AS id, '' AS description, sequence AS seq FROM {_TEMPLATES('p')} UNION ALL SELECT '*' || template_id, 'skipped_reason=' || reason, '' FROM (@SKIPPED@)""",
    "positions_scan": "SELECT DISTINCT unnest([sequence_length, sequence_length + 1])::INT AS position FROM embeddings_index",
    "stored_vectors": f"""WITH f AS (SELECT {_PATH('embedding_path')} AS path, emb_mean AS v, model_name AS m, representation_layer AS l, implementation AS k FROM embedding_files QUALIFY row_number() OVER (PARTITION BY path ORDER BY row_id DESC) = 1),
i AS (SELECT {_PATH('embedding_path')} AS path, model_name FROM embeddings_index WHERE status IN ('ok', 'skipped') AND embedding_path IS NOT NULL)
SELECT problem, count(*) AS n FROM (SELECT CASE WHEN v IS NULL THEN 'missing' WHEN len(v) <> 16 THEN 'wrong_length' WHEN len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) > 0 THEN 'not_finite'
  WHEN model_name IS DISTINCT FROM m THEN 'other_model' WHEN l IS DISTINCT FROM 36 THEN 'other_layer' WHEN k IS DISTINCT FROM 'fair' THEN 'other_implementation' END AS problem FROM i LEFT JOIN f USING (path)) WHERE problem IS NOT NULL GROUP BY problem""",
    "last_records": "SELECT variant_id, max(row_id) AS row_id, arg_max(template_id, row_id) AS template_id, arg_max(token_pattern, row_id) AS token_pattern, min(row_id) AS first_place FROM variants GROUP BY variant_id",
    "csv_scan": "SELECT row_id, variant_id, status, reason, status_code, attempts, elapsed_seconds, NULL::VARCHAR AS absent FROM predictions",
    "ids_scan": "SELECT trim(variant_id) AS id, count(*) AS n FROM predictions WHERE status = 'failed' AND trim(variant_id) NOT LIKE '#%' AND trim(variant_id) <> '' GROUP BY 1",
    "index_appended": f"SELECT row_id, variant_id, status FROM {_LATEST('embeddings_index')}",
    "atom_table": f"""SELECT variant_id, 0 AS model_idx, 'B' AS chain_id, 0 AS chain_ord, 'H' AS hetflag, resseq::INT AS resseq, 'ALA' AS resname, 'CA' AS atom_name, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z, 25.5 AS bfactor FROM {_PTS}""",
    "residue_table": f"""SELECT variant_id, resseq::INT AS dssp_index, (resseq + 100)::INT AS resseq, aa, ss, acc, round(least(acc / {_SURFACE}, 1.0), 9) AS rasa FROM (
SELECT variant_id, resseq, CASE WHEN x > 0 THEN 'L' WHEN x > -0.1 THEN 'K' ELSE 'C' END AS aa, CASE WHEN y > 0 THEN 'H' ELSE ' ' END AS ss, trunc(abs(z * 1000)) AS acc FROM {_PTS})""",
    "predict_report": f"""WITH d AS (SELECT DISTINCT variant_id FROM predictions WHERE status = 'ok'), v AS (SELECT variant_id, (length(s) + {_COUNT('H')}) % 6 AS k, variant_id IN (SELECT variant_id FROM d) AS old FROM {_LAST})
SELECT variant_id, CASE WHEN old THEN 'skipped' WHEN k = 0 THEN 'ok' ELSE 'failed' END AS status, CASE WHEN old THEN 'exists' ELSE [NULL, 'rate_limited_429', 'http_error_404', 'server_error_503', 'unexpected_body', 'network_error'][k + 1] END AS reason,
CASE WHEN old THEN 0 ELSE [200, 429, 404, 503, 200, 0][k + 1] END::INT AS status_code, CASE WHEN old THEN 0 WHEN k IN (1, 3, 5) THEN 3 ELSE 1 END::INT AS attempts FROM v""",
    "embed_index": f"""WITH old AS (SELECT DISTINCT variant_id FROM embeddings_index WHERE status = 'ok'), a AS (SELECT variant_id, template_id, cluster_id FROM {_LATEST('cluster_assignments')}),
v AS (SELECT variant_id, length(s) AS n, substr(s, 1, 88) AS s, variant_id IN (SELECT variant_id FROM old) AS old FROM {_LAST}), h AS (SELECT *, {_COUNT('H')} % 7 = 0 AS fails, {_COUNT('P')} % 9 = 0 AS odd FROM v)
SELECT h.variant_id, template_id, cluster_id, n::INT AS sequence_length, 'm' AS model_name, 'cpu' AS device, 'vectors/' || h.variant_id AS embedding_path, CASE WHEN old THEN 'skipped' WHEN fails OR odd THEN 'failed' ELSE 'ok' END AS status,
CASE WHEN old THEN 'exists_valid' WHEN fails THEN 'RuntimeError: no memory' WHEN odd THEN 'ValueError: ' || h.variant_id || ': not finite' ELSE '' END AS error FROM h LEFT JOIN a ON a.variant_id = h.variant_id""",
    "chosen_ids": f"""WITH c AS (SELECT DISTINCT template_id, cluster_id, variant_id FROM cluster_assignments WHERE template_id IS NOT NULL AND cluster_id IS NOT NULL AND variant_id IS NOT NULL),
k AS (SELECT variant_id FROM c QUALIFY row_number() OVER (PARTITION BY template_id, cluster_id ORDER BY md5('1|' || variant_id), variant_id) <= 2)
SELECT row_id, variant_id FROM {_LAST} WHERE variant_id IN (SELECT variant_id FROM k)""",
}
SQL["library_marked"] = SQL["library_marked"].replace("@SKIPPED@", SQL["library_skipped"])
