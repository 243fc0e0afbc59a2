"""Report parsing against a plain reader of one line at a time."""

import random
import re

from quartzfold.operators.rejects import parse_reports, rejected_reports, valid_reports

SCHEMA = "line_id long, report_name string, raw_line string, reason string"


def fields(line):
    """The fields of one record, None if it isn't one."""
    out, at = [], 0
    line = line[:-1] if line.endswith("\r") else line
    while True:
        m = re.compile(r' *"((?:[^"]|"")*)" *(?=,|\Z)').match(line, at) or re.compile(r'([^",\n\r]*)(?=,|\Z)').match(line, at)
        if not m:
            return None
        out.append((m[1].replace('""', '"') if '"' in m[0] else m[1]).strip(" "))
        at = m.end()
        if at == len(line):
            return out
        at += 1


def is_valid(report, line):
    f = fields(line) if line is not None else None
    if f is None or report not in ("prediction_report", "skipped_structures") or len(f) != (7 if report == "prediction_report" else 3):
        return False
    reason = f[3] if len(f) == 7 else f[2]
    if not f[0] or not f[1] or re.search("[�\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", reason):
        return False
    if len(f) == 3:
        return bool(reason)
    return f[2] in ("ok", "skipped", "failed") and (f[2] != "failed" or reason != "") and re.fullmatch("[0-9]*", f[4]) and re.fullmatch("[0-9]+", f[5]) and re.fullmatch(r"[0-9]+(\.[0-9]+)?(e[+-]?[0-9]+)?", f[6])


def test_against_plain_reader(spark):
    draw = random.Random(4)
    lines = []
    for _ in range(3000):
        n = draw.choice([7, 7, 7, 3, 3, 1, 6, 8])
        good = ["v", "p,x", draw.choice(["ok", "failed", "skipped", "Ok", ""]), draw.choice(["", 'a "b"', "x\ny", "bad\x07", "gut�", " "]), draw.choice(["", "200", "x", " 5 "]), draw.choice(["1", "", "1.5"]), draw.choice(["1.5", "2e3", "1e", ".5", " 7.25e-1 "])]
        f = [draw.choice(["a", "b c", "", " ", "q"]) if draw.random() < 0.05 else v for v in (good if n >= 6 else ["v", "p", good[3]])][:n]
        f += ["z"] * (n - len(f))
        line = ",".join('"' + v.replace('"', '""') + '"' if re.search('[",\n]', v) or draw.random() < 0.3 else v for v in f)
        if draw.random() < 0.15 and line:
            i = draw.randrange(len(line))
            line = line[:i] + draw.choice(['"', ",", "\n", "\r", " "]) + line[i + draw.randint(0, 1) :]
        if draw.random() < 0.2:
            line += "\r"
        if draw.random() < 0.1:
            line = line.replace(',"', ', "')
        lines.append((len(lines), draw.choice(["prediction_report"] * 4 + ["skipped_structures"] * 2), line))
    lines += [(9001, "prediction_report", None), (9002, None, "a,b,c"), (9003, "other", "a,b,c"), (9004, "skipped_structures", ""), (9005, "skipped_structures", '"'), (9006, "skipped_structures", "a,b," + "x" * 300_000), (9006, "skipped_structures", "a,b,c")]
    df = spark.createDataFrame([(*x, "clash") for x in lines], SCHEMA)
    got = sorted(r[0] for r in rejected_reports(df).collect())
    assert got == sorted(i for i, report, line in lines if not is_valid(report, line))
    assert parse_reports(df).count() == len(lines)


def test_typed_values_and_reasons(spark):
    df = spark.createDataFrame(
        [
            (1, "prediction_report", 'v,"p ""q""",failed,"two\nlines, here",429,7, 1.5e1 \r', None),
            (2, "prediction_report", "v,p,ok,,,99999999999999999999,1", None),
            (6, "prediction_report", "v,p,ok,,9223372036854775807,000000000000000000000000012,1", None),
            (7, "prediction_report", "v,p,ok,,9223372036854775808,0,1", None),
            (3, "prediction_report", "v,p,failed, ,,x,1", None),
            (4, "skipped_structures", "v,p", None),
            (5, "skipped_structures", 'v,p,"open', None),
        ],
        SCHEMA,
    )
    rows = {r["line_id"]: r for r in parse_reports(df).collect()}
    assert (rows[1]["out_pdb_path"], rows[1]["reason"], rows[1]["status_code"], rows[1]["elapsed_seconds"]) == ('p "q"', "two\nlines, here", 429, 15.0)
    assert rows[2]["reject_reason"] is None and rows[2]["attempts"] is None
    assert (rows[6]["status_code"], rows[6]["attempts"]) == (2**63 - 1, 12) and (rows[7]["status_code"], rows[7]["attempts"]) == (None, 0)
    assert rows[3]["failing_cells"] == ["reason", "attempts"] and rows[3]["reject_reason"] == "reason is empty" and rows[3]["variant_id"] is None
    assert rows[4]["reject_reason"] == "2 fields instead of 3" and rows[5]["reject_reason"] == "broken quoting"


def test_empty_table(spark):
    assert valid_reports(spark.createDataFrame([], SCHEMA)).count() == 0
