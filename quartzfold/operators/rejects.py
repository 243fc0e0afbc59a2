"""Problem 1: rows that fail to parse come out apart, with the reason, while valid rows come out typed.

Structure is checked by Arrow's CSV reader, whose callback reports each record with a wrong number of fields; records
whose quoting is broken would swallow their neighbours, so a pattern for one whole record holds them back first. All
fields are read as strings; whole column vectors are then tested and cast, and every failing cell is named.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark.sql import DataFrame

BLANKED = r' *"(?:[^"]|"")*" *'
FIELD = rf'(?:{BLANKED}|[^",\n\r]*)'
RECORD = rf"^{FIELD}(?:,{FIELD})*$"

CONTROL = "[\\x{fffd}\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]"


@dataclass(frozen=True)
class Cell:
    """One field of a report: its name, a pattern for the trimmed value, whether it may be empty, and its type."""

    name: str
    pattern: str | None = None
    empty: bool = True
    type: str = "string"
    clean: bool = False
    needed_if: tuple[str, str] | None = None


REPORTS: dict[str, tuple[Cell, ...]] = {
    "prediction_report": (
        Cell("variant_id", empty=False),
        Cell("out_pdb_path", empty=False),
        Cell("status", pattern="^(?:ok|skipped|failed)$", empty=False),
        Cell("reason", clean=True, needed_if=("status", "failed")),
        Cell("status_code", pattern="^[0-9]+$", type="long"),
        Cell("attempts", pattern="^[0-9]+$", empty=False, type="long"),
        Cell("elapsed_seconds", pattern=r"^[0-9]+(?:\.[0-9]+)?(?:e[+-]?[0-9]+)?$", empty=False, type="double"),
    ),
    "skipped_structures": (
        Cell("variant_id", empty=False),
        Cell("pdb_path", empty=False),
        Cell("reason", empty=False, clean=True),
    ),
}

OUT = {
    "variant_id": "string", "pdb_path": "string", "out_pdb_path": "string", "status": "string", "reason": "string",
    "status_code": "long", "attempts": "long", "elapsed_seconds": "double",
}
LARGEST = str(2**63 - 1)


def _bare(line: str) -> str:
    """The line without the blanks around its quoted fields, which Arrow's reader would take for unquoted text."""
    return ",".join(f.strip(" ") if '"' in f else f for f in re.findall(rf"(?:^|,)({FIELD})", line))


def _text(places: np.ndarray, lines: pa.Array) -> pa.Buffer:
    """The records as one CSV text, each with its place before it."""
    each = pc.binary_join_element_wise(pa.array(places).cast(pa.string()), lines, ",")
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(each)], pa.int32()), each), "\n")[0].as_buffer()


def _cells(lines: pa.Array, at: np.ndarray, cells: tuple[Cell, ...], reason: np.ndarray, failing: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """Parse the records ``lines`` found at places ``at``; note reasons and failing cells there, return places and columns."""
    lines = pc.replace_substring_regex(lines, r"\r$", "")
    whole = pc.fill_null(pc.match_substring_regex(lines, RECORD), False)
    is_whole, null = whole.to_numpy(zero_copy_only=False), lines.is_null().to_numpy(zero_copy_only=False)
    reason[at[null]] = "null line"
    reason[at[~null & ~is_whole]] = "broken quoting"
    texts, places = lines.filter(whole), at[is_whole]
    if not len(texts):
        return places, [pa.array([], pa.string()) for _ in cells]
    blanks = pc.or_(pc.match_substring(texts, ' "'), pc.match_substring(texts, '" '))
    if pc.any(blanks).as_py():
        texts = pc.replace_with_mask(texts, blanks, pa.array([_bare(t) for t in texts.filter(blanks).to_pylist()], pa.string()))

    def wrong(row) -> str:
        k = int(row.text.partition(",")[0])
        reason[k] = f"{row.actual_columns - 1} fields instead of {len(cells)}"
        return "skip"

    names = ["_at", *(c.name for c in cells)]
    # each record starts with its place, so that a reported or parsed record is known whatever was skipped before it
    raw = ",".join(names).encode() + b"\n" + _text(places, texts).to_pybytes()  # a header is never rejected, so the reader never meets an empty file
    got = csv.read_csv(
        pa.BufferReader(raw),
        csv.ReadOptions(use_threads=False, block_size=len(raw) + 1),
        csv.ParseOptions(newlines_in_values=True, invalid_row_handler=wrong, ignore_empty_lines=False),
        csv.ConvertOptions(column_types={**dict.fromkeys(names, pa.string()), "_at": pa.int64()}, strings_can_be_null=False),
    )
    places = got["_at"].combine_chunks().to_numpy()
    columns = {c.name: pc.utf8_trim(got[c.name].combine_chunks(), " ") for c in cells}
    for c in cells:
        v = columns[c.name]
        blank = pc.equal(v, "").to_numpy(zero_copy_only=False)
        tests = [("is empty", blank if not c.empty else np.zeros(len(v), bool))]
        if c.needed_if:
            tests.append(("is empty", blank & pc.equal(columns[c.needed_if[0]], c.needed_if[1]).to_numpy(zero_copy_only=False)))
        if c.pattern:
            tests.append(("is not valid", ~blank & ~pc.match_substring_regex(v, c.pattern).to_numpy(zero_copy_only=False)))
        if c.clean:
            tests.append(("holds a damaged character", pc.match_substring_regex(v, CONTROL).to_numpy(zero_copy_only=False)))
        for what, bad in tests:
            for k in places[bad]:  # failing cells only
                reason[k] = reason[k] or f"{c.name} {what}"
                failing[k] = [*(failing[k] or []), c.name]
    return places, list(columns.values())


def _cast(v: pa.Array, kind: str) -> pa.Array:
    """The vector as its type; an empty or unusable cell, or a number beyond the type, as null."""
    none = pa.scalar(None, pa.string())
    if kind == "string":
        return v
    if kind == "double":
        return pc.cast(pc.if_else(pc.match_substring_regex(v, r"^[0-9]+(?:\.[0-9]+)?(?:e[+-]?[0-9]+)?$"), v, none), pa.float64())
    digits = pc.if_else(pc.match_substring_regex(v, "^[0-9]+$"), pc.utf8_ltrim(v, "0"), none)
    size = pc.utf8_length(digits)
    fits = pc.or_(pc.less(size, len(LARGEST)), pc.and_(pc.equal(size, len(LARGEST)), pc.less_equal(digits, LARGEST)))
    digits = pc.if_else(fits, digits, none)
    return pc.cast(pc.if_else(pc.equal(digits, ""), "0", digits), pa.int64())


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        reason, failing = np.full(n, None, object), np.full(n, None, object)
        names, lines = batch.column(1), batch.column(2)
        out: dict[str, list[pa.Array]] = {c: [] for c in OUT}
        known, found = np.zeros(n, bool), []
        for report, cells in REPORTS.items():
            mine = pc.fill_null(pc.equal(names, report), False).to_numpy(zero_copy_only=False)
            known |= mine
            found.append((cells, *_cells(lines.filter(pa.array(mine)), np.flatnonzero(mine), cells, reason, failing)))
        reason[~known] = "unknown report"
        reasons = pa.array(reason, pa.string())
        bad = reasons.is_valid().to_numpy(zero_copy_only=False)
        for cells, places, columns in found:
            at = np.full(n, -1)
            at[places[: len(columns[0])]] = np.arange(len(columns[0]))
            at = pa.array(at, mask=(at < 0) | bad)
            for c, v in zip(cells, columns, strict=True):
                out[c.name].append(_cast(v, c.type).take(at))
        typed = [pc.coalesce(*out[c]) for c in OUT]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), names, reasons, pa.array(failing, pa.list_(pa.string())), *typed],
            ["line_id", "report_name", "reject_reason", "failing_cells", *OUT],
        )


def parse_reports(lines: DataFrame) -> DataFrame:
    """Parse raw report lines (``line_id``, ``report_name``, ``raw_line``; other columns are ignored).

    Every line comes out once: valid ones typed with ``reject_reason`` null, all others with null fields, the reason of
    the first failure and, if cells failed, their names in ``failing_cells``. Null lines, null or unknown reports, wrong
    field counts and broken quoting are reasons; empty text is a record of one empty field. A number beyond its type
    (a bigint) is valid and null; leading zeros don't count. Repeated lines are kept. No shuffle: each batch is parsed where it is read.
    """
    fields = ", ".join(f"{c} {t}" for c, t in OUT.items())
    schema = f"line_id bigint, report_name string, reject_reason string, failing_cells array<string>, {fields}"
    return lines.selectExpr("cast(line_id as bigint) line_id", "report_name", "raw_line").mapInArrow(_batches, schema)


def valid_reports(lines: DataFrame) -> DataFrame:
    """The typed records of the valid lines."""
    return parse_reports(lines).where("reject_reason is null").drop("reject_reason", "failing_cells")


def rejected_reports(lines: DataFrame) -> DataFrame:
    """The lines that are not valid, with the reason and the failing cells."""
    return parse_reports(lines).where("reject_reason is not null").select("line_id", "report_name", "reject_reason", "failing_cells")
