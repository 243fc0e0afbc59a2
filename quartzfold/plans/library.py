"""Queries over sequences, token patterns, ids and variant libraries, with SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzfold.constants import EXTENDED, HYDROPATHY, HYDROPHOBIC, POLAR
from quartzfold.functions.helices import template_lengths, topology_ranges, written
from quartzfold.functions.sequences import (
    default_group, heptad_position, heptad_role, instantiate, is_valid_protein, letters, masked_length, motif_positions, natural_reason, pool, recovery, token_reason, tokens, variant_id,
)
from quartzfold.session import spread, table
from quartzfold.sinks.files import fasta_text


def _made(spark: SparkSession, sf_dir: str, *seeds: int) -> DataFrame:
    """The variants with a sequence for each seed (``sequence_<seed>``), made from their own pattern and pools."""
    rows = spread(table(spark, sf_dir, "variants")).withColumn("h", pool(F.col("hydrophobic_pool"))).withColumn("p", pool(F.col("polar_pool")))
    made = {f"sequence_{s}": instantiate(F.col("token_pattern"), F.col("h"), F.col("p"), F.lit(s), F.col("template_id"), F.col("variant_index")) for s in seeds}
    return rows.withColumns(made)


def seq_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", natural_reason(F.col("p_name")).alias("reason"))


def protein_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which names of parts are made of letters alone, and which when gaps and stops may be in them."""
    name = F.translate("p_name", " ", "-")
    return table(spark, sf_dir, "part").select("p_partkey", is_valid_protein(F.col("p_name")).alias("plain"), is_valid_protein(name, gaps=True, stop=True).alias("aligned"))


def token_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "variants").groupBy(token_reason(F.col("token_pattern")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def library_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, 42).select("row_id", F.col("sequence_42").alias("sequence"))


def library_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, 42, 43).select("row_id", F.round(recovery(F.col("sequence_42"), F.col("sequence_43")), 9).alias("recovery"))


def seq_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _made(spark, sf_dir, 42).select("row_id", "token_pattern", tokens(F.col("sequence_42")).alias("tokens"))
    return made.select("row_id", "tokens", (F.col("tokens") == F.col("token_pattern")).alias("restored"))


def token_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by letter are summed, so no residue becomes a row."""
    made = _made(spark, sf_dir, 42).select("template_id", "token_pattern", F.col("sequence_42").alias("s"))
    count = lambda of, letter: F.length(of) - F.length(F.replace(F.col(of), F.lit(letter), F.lit("")))
    n = {letter: F.sum(count("s", letter)) for letter in EXTENDED}
    sums = made.groupBy("template_id").agg(
        F.sum(F.length("token_pattern")).alias("n_residues"), F.sum(count("token_pattern", "H")).alias("n_hydrophobic"), F.sum(count("token_pattern", "P")).alias("n_polar"),
        F.sum(sum((count("token_pattern", x) for x in "pcg"), F.lit(0))).alias("n_locked"), *[v.alias(f"n_{x}") for x, v in n.items()],
    )
    known = sum((F.col(f"n_{x}") for x in HYDROPATHY), F.lit(0))
    mean = sum((F.col(f"n_{x}") * round(10 * v) for x, v in HYDROPATHY.items()), F.lit(0)) / (known * 10)  # tenths add up exactly
    different = sum(((F.col(f"n_{x}") > 0).cast("long") for x in EXTENDED), F.lit(0))
    return sums.select("template_id", "n_residues", "n_hydrophobic", "n_polar", "n_locked", different.alias("n_different"), F.round(mean, 6).alias("mean_hydropathy"))


def heptad_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "variants").select(F.posexplode(letters(F.col("token_pattern"))).alias("at", "token")).withColumn("heptad", heptad_position(F.col("at")))
    return each.groupBy("heptad", heptad_role(F.col("heptad")).alias("role"), "token").agg(F.count(F.lit(1)).alias("n"))


def motif_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = motif_positions(F.col("token_pattern"), "HPPH")
    return table(spark, sf_dir, "variants").select("row_id", F.size(hit).alias("n_covered"), masked_length(F.col("token_pattern"), hit).alias("n_left"))


def variant_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "variants").select("row_id", variant_id(F.col("template_id"), F.col("variant_index")).alias("built_id"), default_group(F.col("variant_id")).alias("group_id"))


def helix_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("template_id")
    return table(spark, sf_dir, "variants").select("template_id").distinct().select("template_id", written(topology_ranges(name, 8)).alias("central"), written(topology_ranges(name, None)).alias("whole"), template_lengths(name)["reason"].alias("reason"))


def fasta_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "variants").select("row_id", fasta_text(F.col("variant_id"), F.concat(F.lit("template="), "template_id"), F.col("token_pattern")).alias("record"))


_SEQ = "(SELECT p_partkey, upper(trim(p_name)) AS s, p_name FROM part)"
_BAD = lambda allowed: f"list_sort(list_distinct(list_filter(string_split(regexp_replace(s, '[{allowed}]', '', 'g'), ''), lambda x: x <> '')))"
_LISTED = lambda bad: f"'[''' || array_to_string({bad}, ''', ''') || ''']'"
_POOL = lambda c: f"list_filter(string_split(regexp_replace(upper({c}), '[^A-Z]', '', 'g'), ''), lambda x, i: list_position(string_split(regexp_replace(upper({c}), '[^A-Z]', '', 'g'), ''), x) = i)"
_DIGITS = lambda seed: f"array_to_string(list_transform(range((length(token_pattern) + 7) // 8), lambda b: md5(concat_ws('|', '{seed}', template_id, variant_index::VARCHAR, b::VARCHAR))), '')"
_AT = lambda p, seed: f"{p}[1 + ('0x' || substr(d{seed}, 4 * (i - 1)::INT + 1, 4))::BIGINT % len({p})]"
_SEQUENCE = lambda seed: f"array_to_string(list_transform(string_split(token_pattern, ''), lambda t, i: CASE t WHEN 'H' THEN {_AT('h', seed)} WHEN 'P' THEN {_AT('p', seed)} ELSE upper(t) END), '')"
_MADE = f"(SELECT *, {_SEQUENCE(42)} AS sequence_42, {_SEQUENCE(43)} AS sequence_43 FROM (SELECT *, {_POOL('hydrophobic_pool')} AS h, {_POOL('polar_pool')} AS p, {_DIGITS(42)} AS d42, {_DIGITS(43)} AS d43 FROM variants))"
_TOKENS = f"translate(sequence_42, '{HYDROPHOBIC}{POLAR}PCG', '{'H' * len(HYDROPHOBIC)}{'P' * len(POLAR)}pcg')"
_KD = "CASE a " + " ".join(f"WHEN '{a}' THEN {v}" for a, v in HYDROPATHY.items()) + " END"
_HITS = "list_distinct(flatten(list_transform(list_filter(range(1, greatest(length(token_pattern) - 3, 1) + 1), lambda i: substr(upper(token_pattern), i, 4) = 'HPPH'), lambda i: range(i, i + 4))))"
_RANGES = lambda width: f"array_to_string(list_transform(range(1, 5), lambda i: (st[i] + (hs[i] - least(hs[i], {width})) // 2)::VARCHAR || '-' || (st[i] + (hs[i] - least(hs[i], {width})) // 2 + least(hs[i], {width}) - 1)::VARCHAR), ';')"

QUERIES = {f.__name__: f for f in (seq_validate, protein_valid, token_validate, library_generate, library_recovery, seq_tokenize, token_composition, heptad_annotate, motif_cover, variant_names, helix_windows, fasta_records)}
SQL = {
    "seq_validate": f"""SELECT p_partkey, CASE WHEN s IS NULL OR s = '' THEN 'Empty sequence'
WHEN len({_BAD('A-Z')}) > 0 THEN 'Invalid characters: ' || {_LISTED(_BAD('A-Z'))}
WHEN len({_BAD('ACDEFGHIKLMNPQRSTVWY')}) > 0 THEN 'Non-canonical/ambiguous residues present (AA20-only required): ' || {_LISTED(_BAD('ACDEFGHIKLMNPQRSTVWY'))} END AS reason FROM {_SEQ}""",
    "protein_valid": "SELECT p_partkey, regexp_full_match(upper(trim(p_name)), '[A-Z]*') AS plain, regexp_full_match(upper(trim(translate(p_name, ' ', '-'))), '[-A-Z.*]*') AS aligned FROM part",
    "token_validate": """SELECT CASE WHEN token_pattern IS NULL OR replace(trim(token_pattern), ' ', '') = '' THEN 'Empty token pattern'
WHEN regexp_matches(replace(trim(token_pattern), ' ', ''), '[^HPpcg]') THEN 'Invalid token ''' || regexp_extract(replace(trim(token_pattern), ' ', ''), '[^HPpcg]') || '''' END AS reason, count(*) AS n FROM variants GROUP BY 1""",
    "library_generate": f"SELECT row_id, sequence_42 AS sequence FROM {_MADE}",
    "library_recovery": f"SELECT row_id, round(list_sum(list_transform(range(1, length(sequence_42) + 1), lambda i: (substr(sequence_42, i, 1) = substr(sequence_43, i, 1))::INT)) / length(sequence_42)::DOUBLE, 9) AS recovery FROM {_MADE}",
    "seq_tokenize": f"SELECT row_id, {_TOKENS} AS tokens, {_TOKENS} = token_pattern AS restored FROM {_MADE}",
    "token_composition": f"""SELECT template_id, count(*) AS n_residues, count(*) FILTER (WHERE t = 'H') AS n_hydrophobic, count(*) FILTER (WHERE t = 'P') AS n_polar, count(*) FILTER (WHERE t IN ('p', 'c', 'g')) AS n_locked,
count(DISTINCT a) AS n_different, round(avg({_KD}), 6) AS mean_hydropathy FROM (SELECT template_id, unnest(string_split(token_pattern, '')) AS t, unnest(string_split(sequence_42, '')) AS a FROM {_MADE}) GROUP BY template_id""",
    "heptad_annotate": """SELECT heptad, CASE WHEN heptad IN ('a', 'd') THEN 'core' WHEN heptad IN ('e', 'g') THEN 'electrostatic' ELSE 'solvent' END AS role, token, count(*) AS n FROM (
SELECT substr('abcdefg', (pos % 7)::INT + 1, 1) AS heptad, token FROM (SELECT unnest(string_split(token_pattern, '')) AS token, unnest(range(length(token_pattern))) AS pos FROM variants)) GROUP BY ALL""",
    "motif_cover": f"SELECT row_id, len({_HITS})::INT AS n_covered, (length(token_pattern) - len({_HITS}))::INT AS n_left FROM variants",
    "variant_names": "SELECT row_id, template_id || '_var' || CASE WHEN variant_index < 10000 THEN lpad(variant_index::VARCHAR, 4, '0') ELSE variant_index::VARCHAR END AS built_id, split_part(variant_id, '_var', 1) AS group_id FROM variants",
    "helix_windows": rf"""WITH t AS (SELECT DISTINCT template_id FROM variants),
x AS (SELECT template_id, string_split(template_id, '|') AS f FROM t),
w AS (SELECT template_id, string_split(f[nullif(list_position(f, 'helices'), 0) + 1], ',') AS h, string_split(f[nullif(list_position(f, 'loops'), 0) + 1], ',') AS l,
  list_filter(list_transform(f, lambda v: CASE WHEN contains(v, '_len_') THEN TRY_CAST(string_split(v, '_len_')[-1] AS INT) END), lambda v: v IS NOT NULL)[1] AS n FROM x),
y AS (SELECT template_id, n, CASE WHEN len(h) = 4 THEN list_transform(h, lambda v: TRY_CAST(v AS INT)) END AS hs, CASE WHEN len(l) = 3 THEN list_transform(l, lambda v: TRY_CAST(v AS INT)) END AS ls FROM w),
z AS (SELECT *, CASE WHEN hs IS NULL OR len(list_filter(hs, lambda v: v IS NULL)) > 0 THEN 'no helix lengths' WHEN ls IS NULL OR len(list_filter(ls, lambda v: v IS NULL)) > 0 THEN 'no loop lengths' WHEN list_min(hs) <= 0 THEN 'helix lengths must be positive' WHEN n <> list_sum(hs) + list_sum(ls) THEN 'stated length is not the sum' END AS reason,
  [1, 1 + hs[1] + ls[1], 1 + hs[1] + ls[1] + hs[2] + ls[2], 1 + hs[1] + ls[1] + hs[2] + ls[2] + hs[3] + ls[3]] AS st FROM y)
SELECT template_id, CASE WHEN reason IS NULL THEN {_RANGES('8')} END AS central, CASE WHEN reason IS NULL THEN {_RANGES('hs[i]')} END AS whole, reason FROM z""",
    "fasta_records": r"SELECT row_id, '>' || variant_id || ' template=' || template_id || chr(10) || rtrim(regexp_replace(token_pattern, '(.{80})', '\1' || chr(10), 'g'), chr(10)) AS record FROM variants",
}
