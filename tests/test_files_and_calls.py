"""Sources, sinks, outside calls and streaming on small files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartzfold.operators.external import RetrySpec, embed, index_problems, predict
from quartzfold.sinks.files import append_index, fasta_text, with_skipped, write_csv, write_fasta, write_ids, write_structures, write_token_fasta
from quartzfold.sources.fasta import read_fasta, read_token_fasta, require_valid
from quartzfold.sources.lists import load_library_spec, load_output_names, read_csv, read_ids, read_positions
from quartzfold.sources.structures import alpha_coordinates, atoms, read_lines, read_vectors, residues
from quartzfold.streaming.resume import process_new


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text("junk\n>t1 first  one\r\nac d\n\nEF\n  >t2\n>t1\nHPpc\n>\nHPG\n")
    rows = read_fasta(spark, str(tmp_path / "a.fa")).orderBy("rec_no").collect()
    assert [(r["id"], r["description"], r["seq"]) for r in rows] == [("t1", "first  one", "ACDEF"), ("t2", "", ""), ("t1", "", "HPPC"), (None, "", "HPG")]
    tokens = read_token_fasta(spark, str(tmp_path / "a.fa")).orderBy("rec_no").collect()
    assert tokens[2]["seq"] == "HPpc" and tokens[2]["reason"] is None and tokens[3]["reason"] == "Invalid token 'G'"
    with pytest.raises(ValueError, match="Empty token pattern"):
        require_valid(read_token_fasta(spark, str(tmp_path / "a.fa")))
    records = spark.createDataFrame([(i, f"id{i}", "d" if i % 2 else "", "A" * (i * 40)) for i in range(30)], "rec_no int, id string, description string, seq string")
    write_fasta(records, str(tmp_path / "out"))
    back = read_fasta(spark, str(tmp_path / "out")).collect()
    assert {(r["id"], r["description"], r["seq"]) for r in back} == {(r["id"], r["description"], r["seq"]) for r in records.collect()}
    assert records.where("rec_no = 5").select(fasta_text(F.col("id"), F.col("description"), F.col("seq"))).first()[0] == ">id5 d\n" + "A" * 80 + "\n" + "A" * 80 + "\n" + "A" * 40
    write_fasta(records.where("rec_no < 3"), str(tmp_path / "by"), by="id")
    assert (tmp_path / "by" / "id=id1").exists()
    write_token_fasta(records.where("rec_no between 1 and 2").withColumn("tokens", F.lit("HPg")), str(tmp_path / "tok"), original=True)
    assert {(r["id"], r["description"], r["seq"]) for r in read_fasta(spark, str(tmp_path / "tok"), keep_case=True).collect()} == {("id1", "d orig=" + "A" * 40, "HPg"), ("id2", "orig=" + "A" * 80, "HPg")}
    both = with_skipped(records.where("rec_no = 1"), spark.createDataFrame([(1, "bad", "why", None)], "rec_no int, id string, reason string, seq string")).orderBy("rec_no").collect()
    assert [r["id"] for r in both] == ["id1", "*bad"] and both[1]["description"] == "skipped_reason=why"


def test_fasta_in_many_splits(spark, tmp_path):
    text = "; text before\r\n" + "".join(f" >id{i}\td {i}\r\nac d\r\n\r\nEF{'g' * (i % 50)}\n" for i in range(600)) + ">\n>last"
    (tmp_path / "b.fa").write_bytes(text.encode())
    (tmp_path / "c.fa").write_text(">only\nA\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        df = read_fasta(spark, str(tmp_path / "*.fa"))
        rows = [tuple(r)[1:] for r in df.where("file like '%b.fa'").orderBy("rec_no").collect()]
        assert rows == [(i + 1, f"id{i}", f"d {i}", "ACDEF" + "G" * (i % 50)) for i in range(600)] + [(601, None, "", ""), (602, "last", "", "")]
        assert [tuple(r)[1:] for r in df.where("file like '%c.fa'").collect()] == [(1, "only", "", "A")]
        (tmp_path / "ids").write_text("# n\n" + "".join(f" v{i} \r\n\n" for i in range(900)))
        assert [(r["line_no"], r["id"]) for r in read_ids(spark, str(tmp_path / "ids")).orderBy("line_no").collect()] == [(1 + 2 * i, f"v{i}") for i in range(900)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_lists_and_tables(spark, tmp_path):
    (tmp_path / "ids").write_text("b\n# no\n\n a \nb\n")
    assert [r["id"] for r in read_ids(spark, str(tmp_path / "ids")).orderBy("line_no").collect()] == ["b", "a", "b"]
    (tmp_path / "pos").write_text("# c\n1, 2,x\n2,7\n")
    assert sorted(r[0] for r in read_positions(spark, str(tmp_path / "pos")).collect()) == [1, 2, 7]
    (tmp_path / "c.yaml").write_text("randomization: {num_variants_per_template: 7, rng_seed: 3, seed: 9}\nreplacement_pools: {hydrophobic: [F], polar: [E, D]}\n")
    spec = load_library_spec(str(tmp_path / "c.yaml"))
    assert (spec.variants, spec.seed, spec.polar) == (7, 3, ("E", "D")) and load_output_names(str(tmp_path / "c.yaml")) == ("variants_fasta", "metadata")
    (tmp_path / "d.yaml").write_text("randomization: {num_variants_per_input: 0}\noutputs: {metadata_table_name: meta.csv}\n")
    assert load_output_names(str(tmp_path / "d.yaml"))[1] == "meta"
    with pytest.raises(ValueError, match="num_variants_per_input"):
        load_library_spec(str(tmp_path / "d.yaml"))
    df = spark.createDataFrame([("007", None, ['a "q"', "b"]), ("NA", 'x,"y"\nz', [])], "variant_id string, note string, names array<string>")
    write_csv(df, str(tmp_path / "csv"))
    back = {r["variant_id"]: r for r in read_csv(spark, str(tmp_path / "csv"), "variant_id string, note string, names string", ["variant_id"]).collect()}
    assert back["007"]["names"] == 'a "q";b' and back["NA"]["note"] == 'x,"y"\nz' and back["007"]["note"] is None
    with pytest.raises(ValueError, match="nope"):
        read_csv(spark, str(tmp_path / "csv"), "variant_id string", ["nope"])
    write_ids(df, str(tmp_path / "w"))
    append_index(df.select("variant_id"), str(tmp_path / "ix"))
    append_index(df.select("variant_id"), str(tmp_path / "ix"))
    assert spark.read.parquet(str(tmp_path / "ix")).count() == 4 and {r["id"] for r in read_ids(spark, str(tmp_path / "w")).collect()} == {"007", "NA"}


def test_structures(spark, tmp_path):
    atom = "{:<6}{:>5} {:^4} {:>3} {}{:>4}    {:>8.3f}{:>8.3f}{:>8.3f}  1.00{:>6.2f}"
    text = [atom.format("ATOM", 1, "N", "ALA", "B", 1, 0, 0, 0, 5), atom.format("ATOM", 2, "CA", "ALA", "B", 1, 1, 2, 3, 6), atom.format("HETATM", 3, "CA", "CA", "A", 90, 9, 9, 9, 7), "TER"]
    (tmp_path / "v1.x.pdb").write_text("\n".join(["MODEL 1", *text, "ENDMDL", "MODEL 2", *text, "ENDMDL"]) + "\n")
    (tmp_path / "v2.pdb").write_text("")
    lines = read_lines(spark, str(tmp_path))
    a = atoms(lines).orderBy("line_no").collect()
    assert len(a) == 6 and [(r["variant_id"], r["model_idx"], r["chain_ord"], r["hetflag"]) for r in a[:3]] == [("v1.x", 0, 0, " "), ("v1.x", 0, 0, " "), ("v1.x", 0, 1, "H")] and a[3]["model_idx"] == 1 and a[1]["bfactor"] == 6.0
    assert alpha_coordinates(atoms(lines)).first()["coords"] == [1.0, 2.0, 3.0, 9.0, 9.0, 9.0]
    out = tmp_path.with_name(f"{tmp_path.name}_out")
    write_structures(lines.where("variant_id = 'v1.x'"), str(out))
    assert (out / "variant_id=v1.x").exists()
    dssp = ["==== header", "  #  RESIDUE AA STRUCTURE BP1 BP2  ACC", "    1    5 A L  H  >        0   0   42", "    2        !              0   0    0", "    3    7 A a  T           0   0  130"]
    (tmp_path / "v1.dssp").write_text("\n".join(dssp))
    r = residues(read_lines(spark, str(tmp_path), "*.dssp")).orderBy("dssp_index").collect()
    assert [(x["dssp_index"], x["resseq"], x["aa"], x["ss"], x["acc"]) for x in r] == [(1, 5, "L", "H", 42.0), (3, 7, "C", "T", 130.0)]
    np.savez(tmp_path / "e1.npz", emb=np.arange(6, dtype=np.float16).reshape(2, 3))
    np.savez(tmp_path / "e2.npz", other=np.zeros(3))
    v = read_vectors(spark, str(tmp_path)).orderBy("variant_id", "pos").collect()
    assert v[1]["vec"] == [3.0, 4.0, 5.0] and v[2]["variant_id"] == "e2" and v[2]["reason"].startswith("KeyError")


def test_prediction_retries(spark):
    def make():
        calls = {}

        def client(seq):
            n = calls[seq] = calls.get(seq, 0) + 1
            return {"A": (200, "ATOM", None), "B": (429 if n < 3 else 200, "ATOM", 9.0), "C": (404, "", None), "D": (500, "", None), "E": (200, "<html>", None), "": (0, "", None)}[seq]

        return client

    seqs = spark.createDataFrame([(x or "none", x) for x in ("A", "B", "C", "D", "E", None)] + [("done", "A")], "variant_id string, sequence string")
    out = {r["variant_id"]: r for r in predict(seqs, spark.createDataFrame([("done",)], "variant_id string"), make, RetrySpec(most_retries=3), sleep=lambda s: None).collect()}
    assert {k: (r["status"], r["reason"], r["attempts"]) for k, r in out.items()} == {
        "A": ("ok", None, 1), "B": ("ok", None, 3), "C": ("failed", "http_error_404", 1), "D": ("failed", "server_error_500", 4), "E": ("failed", "unexpected_body", 1), "none": ("failed", "network_error", 4), "done": ("skipped", "exists", 0),
    }


def test_embedding(spark):
    def make():
        def model(seqs):
            if any("X" in s for s in seqs):
                raise RuntimeError("no X")
            return [np.full((len(s), 2), np.nan if s == "N" else 1.0) for s in seqs]

        return model

    seqs = spark.createDataFrame([("a", "AAAAAA"), ("x", "X"), ("n", "N"), ("d", "A")], "variant_id string, sequence string")
    out = embed(seqs, spark.createDataFrame([("d",)], "variant_id string"), make, batch=1, most=5).collect()
    assert len([r for r in out if r["variant_id"] == "a"]) == 3 and {r["variant_id"]: r["error"] for r in out if r["error"]} == {"x": "RuntimeError: no X", "n": "ValueError: n: not finite"}
    index = spark.createDataFrame([("a", "p"), ("b", "q"), ("c", "r"), ("d", "s")], "variant_id string, path string")
    stored = spark.createDataFrame([("p", [1.0, 2.0]), ("q", [1.0]), ("r", [1.0, None])], "path string, vector array<double>")
    assert {r["variant_id"]: r["problem"] for r in index_problems(index, stored, 2).collect()} == {"b": "wrong_length", "c": "not_finite", "d": "missing"}


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    run = lambda: process_new(spark, source, "id int, v int", target, str(tmp_path / "cp"), lambda df: df.withColumn("w", F.col("v") * 2), "id").awaitTermination(60)
    spark.createDataFrame([(1, 1), (2, 2), (2, 2)], "id int, v int").write.parquet(source)
    run()
    spark.createDataFrame([(2, 9), (3, 3)], "id int, v int").write.mode("append").parquet(source)
    run()
    run()
    assert sorted((r["id"], r["w"]) for r in spark.read.parquet(target).collect()) == [(1, 2), (2, 4), (3, 6)]
