"""Queries of problems 1 and 2, with SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzfold.operators.references import missing_by_period, missing_references, same_path
from quartzfold.operators.rejects import parse_reports, rejected_reports, valid_reports
from quartzfold.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected_reports(table(spark, sf_dir, "raw_reports")).select("line_id")


def p1_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valid_reports(table(spark, sf_dir, "raw_reports"))


def p1_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected_reports(table(spark, sf_dir, "raw_reports"))


def p1_reject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_reports(table(spark, sf_dir, "raw_reports")).groupBy("report_name").agg(F.count(F.lit(1)).alias("n_lines"), F.count("reject_reason").alias("n_rejected"))


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    def child(name: str, parent: str, key, claims: str = "true") -> DataFrame:
        return table(spark, sf_dir, name).where(claims).select(F.lit(name).alias("table_name"), F.lit(parent).alias("parent_table"), key.alias("key"), F.col("recorded_at").alias("at"), "row_id")

    def parent(name: str, key, start: str, end: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.lit(name).alias("parent_table"), key.alias("key"), F.col(start).alias("start_at"), F.col(end).alias("end_at"))

    claims = "status in ('ok', 'skipped')"
    children = (
        child("cluster_assignments", "variants", F.col("variant_id"))
        .unionByName(child("predictions", "structure_files", same_path(F.col("out_pdb_path")), claims))
        .unionByName(child("embeddings_index", "embedding_files", same_path(F.col("embedding_path")), claims))
    )
    parents = (
        parent("variants", F.col("variant_id"), "recorded_at", "withdrawn_at")
        .unionByName(parent("structure_files", same_path(F.col("pdb_path")), "created_at", "deleted_at"))
        .unionByName(parent("embedding_files", same_path(F.col("embedding_path")), "created_at", "deleted_at"))
    )
    return missing_references(children, parents)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _references(spark, sf_dir).select("table_name", F.date_format(F.to_date("at"), "yyyy-MM").alias("ref_month"), "row_id")


def p2_missing_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_by_period(_references(spark, sf_dir))


_V = r'(?: *"(?:[^"]|"")*" *|[^",\n\r]*)'


def _record(n: int) -> str:
    return "^" + ",".join([f"({_V})"] * n) + "$"


def _field(i: int) -> str:
    """The value of field i: outer blanks, quotes and inner doubled quotes taken away."""
    f = f"trim(g.f{i}, ' ')"
    return f"trim(CASE WHEN {f} LIKE '\"%' THEN replace(substr({f}, 2, length({f}) - 2), '\"\"', '\"') ELSE {f} END, ' ')"


_LIST = lambda n: ", ".join(f"'f{i}'" for i in range(1, n + 1))
_DIRTY = r"regexp_matches(reason, '[\x{fffd}\x00-\x08\x0b\x0c\x0e-\x1f\x7f]')"
_P1 = f"""
WITH lines AS (SELECT line_id, report_name, regexp_replace(raw_line, '\\r$', '') AS line FROM raw_reports),
p AS (SELECT line_id, regexp_extract(line, '{_record(7)}', [{_LIST(7)}]) AS g FROM lines
      WHERE report_name = 'prediction_report' AND regexp_matches(line, '{_record(7)}')),
s AS (SELECT line_id, regexp_extract(line, '{_record(3)}', [{_LIST(3)}]) AS g FROM lines
      WHERE report_name = 'skipped_structures' AND regexp_matches(line, '{_record(3)}')),
pv AS (SELECT line_id, {_field(1)} AS variant_id, {_field(2)} AS path, {_field(3)} AS status, {_field(4)} AS reason,
       {_field(5)} AS code, {_field(6)} AS attempts, {_field(7)} AS elapsed FROM p),
sv AS (SELECT line_id, {_field(1)} AS variant_id, {_field(2)} AS path, {_field(3)} AS reason FROM s),
good AS (
  SELECT line_id FROM pv WHERE variant_id <> '' AND path <> '' AND status IN ('ok', 'skipped', 'failed')
    AND (status <> 'failed' OR reason <> '') AND NOT {_DIRTY} AND regexp_matches(code, '^[0-9]*$') AND regexp_matches(attempts, '^[0-9]+$')
    AND regexp_matches(elapsed, '^[0-9]+([.][0-9]+)?(e[+-]?[0-9]+)?$')
  UNION ALL
  SELECT line_id FROM sv WHERE variant_id <> '' AND path <> '' AND reason <> '' AND NOT {_DIRTY})
"""
_P1_VALID = """
SELECT line_id, 'prediction_report' AS report_name, variant_id, NULL AS pdb_path, path AS out_pdb_path, status, reason,
  TRY_CAST(code AS BIGINT) AS status_code, TRY_CAST(attempts AS BIGINT) AS attempts, elapsed::DOUBLE AS elapsed_seconds
FROM pv WHERE line_id IN (SELECT line_id FROM good)
UNION ALL
SELECT line_id, 'skipped_structures', variant_id, path, NULL, NULL, reason, NULL, NULL, NULL FROM sv WHERE line_id IN (SELECT line_id FROM good)"""
_TEST = lambda name, bad, what: f"CASE WHEN {bad} THEN ['{name}', '{what}'] END"
_DAMAGED = _TEST("reason", _DIRTY, "holds a damaged character")
_P1_FAULTS = f"""
, faults AS (
  SELECT line_id, list_filter([{_TEST('variant_id', "variant_id = ''", 'is empty')}, {_TEST('out_pdb_path', "path = ''", 'is empty')}, {_TEST('status', "status = ''", 'is empty')}, {_TEST('status', "status NOT IN ('', 'ok', 'skipped', 'failed')", 'is not valid')},
    {_TEST('reason', "reason = '' AND status = 'failed'", 'is empty')}, {_DAMAGED}, {_TEST('status_code', "code <> '' AND NOT regexp_matches(code, '^[0-9]+$')", 'is not valid')}, {_TEST('attempts', "attempts = ''", 'is empty')},
    {_TEST('attempts', "attempts <> '' AND NOT regexp_matches(attempts, '^[0-9]+$')", 'is not valid')}, {_TEST('elapsed_seconds', "elapsed = ''", 'is empty')},
    {_TEST('elapsed_seconds', "elapsed <> '' AND NOT regexp_matches(elapsed, '^[0-9]+([.][0-9]+)?(e[+-]?[0-9]+)?$')", 'is not valid')}], lambda x: x IS NOT NULL) AS f FROM pv
  UNION ALL
  SELECT line_id, list_filter([{_TEST('variant_id', "variant_id = ''", 'is empty')}, {_TEST('pdb_path', "path = ''", 'is empty')}, {_TEST('reason', "reason = ''", 'is empty')}, {_DAMAGED}], lambda x: x IS NOT NULL) AS f FROM sv)
SELECT line_id, report_name, CASE WHEN f IS NOT NULL THEN f[1][1] || ' ' || f[1][2] WHEN report_name IS NULL OR report_name NOT IN ('prediction_report', 'skipped_structures') THEN 'unknown report' WHEN line IS NULL THEN 'null line'
  WHEN NOT regexp_matches(line, '^{_V}(?:,{_V})*$') THEN 'broken quoting' ELSE len(regexp_extract_all(line, '(?:^|,){_V}')) || ' fields instead of ' || CASE report_name WHEN 'prediction_report' THEN 7 ELSE 3 END END AS reject_reason,
  list_transform(f, lambda x: x[1]) AS failing_cells FROM lines LEFT JOIN faults USING (line_id) WHERE line_id NOT IN (SELECT line_id FROM good)"""
_PATH = lambda c: rf"regexp_replace(regexp_replace({c}, '^(?:\./)+', ''), '/(?:\.?/)+', '/', 'g')"


def _missing(name: str, key: str, parent: str, parent_key: str, start: str, end: str, claims: str = "true") -> str:
    return f"""SELECT '{name}' AS table_name, '{parent}' AS parent_table, strftime(c.recorded_at, '%Y-%m') AS ref_month, c.row_id
FROM (SELECT row_id, recorded_at, {key} AS k FROM {name} WHERE {claims}) c
WHERE c.k IS NOT NULL AND NOT EXISTS (SELECT 1 FROM (SELECT {parent_key} AS k, {start} AS s, {end} AS e FROM {parent}) p
  WHERE p.k = c.k AND p.s <= c.recorded_at AND (p.e IS NULL OR c.recorded_at < p.e))"""


_CLAIM = "status IN ('ok', 'skipped')"
_P2 = " UNION ALL ".join([
    _missing("cluster_assignments", "variant_id", "variants", "variant_id", "recorded_at", "withdrawn_at"),
    _missing("predictions", _PATH("out_pdb_path"), "structure_files", _PATH("pdb_path"), "created_at", "deleted_at", _CLAIM),
    _missing("embeddings_index", _PATH("embedding_path"), "embedding_files", _PATH("embedding_path"), "created_at", "deleted_at", _CLAIM),
])

QUERIES = {"p1_found": p1_found, "p1_valid": p1_valid, "p1_rejected": p1_rejected, "p1_reject_counts": p1_reject_counts, "p2_found": p2_found, "p2_missing_by_month": p2_missing_by_month}
SQL = {
    "p1_found": _P1 + "SELECT line_id FROM raw_reports WHERE line_id NOT IN (SELECT line_id FROM good)",
    "p1_valid": _P1 + _P1_VALID,
    "p1_rejected": _P1 + _P1_FAULTS,
    "p1_reject_counts": _P1 + "SELECT report_name, count(*) AS n_lines, count(*) FILTER (WHERE line_id NOT IN (SELECT line_id FROM good)) AS n_rejected FROM raw_reports GROUP BY report_name",
    "p2_found": f"SELECT table_name, ref_month, row_id FROM ({_P2}) x",
    "p2_missing_by_month": f"SELECT table_name, parent_table, ref_month, count(*) AS n_missing FROM ({_P2}) x GROUP BY ALL",
}
