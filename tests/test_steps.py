"""The steps over files, one after the other."""

import numpy as np
import pytest

from quartzfold.steps import main

NAME = "lib_len_16|helices|4,4,4,4|loops|0,0,0|q"
ATOM = "ATOM  {:>5}  CA  ALA A{:>4}    {:>8.3f}{:>8.3f}{:>8.3f}  1.00{:>6.2f}"


def test_all_steps(spark, tmp_path):
    draw = np.random.default_rng(3)
    p = lambda x: str(tmp_path / x)
    (tmp_path / "t.fa").write_text(f">{NAME}\nHPHPHPHPHPHPHPgg\n>bad\nHX\n")
    (tmp_path / "c.yaml").write_text("randomization: {num_variants_per_input: 6, seed: 3}\nreplacement_pools: {hydrophobic: [L, V], polar: [K, E]}\n")
    main(["library", "--fasta", p("t.fa"), "--config", p("c.yaml"), "--out", p("lib"), "--token"])
    csv = lambda x: spark.read.option("header", True).csv(p(x)).collect()
    names = sorted(r["variant_id"] for r in csv("lib/metadata"))
    assert len(names) == 6 and [r["reason"] for r in csv("lib/skipped")] == ["Invalid token 'X'"]
    for d in ("pdb", "emb"):
        (tmp_path / d).mkdir()
    shapes = draw.normal(size=(2, 16, 3)) * 9
    for i, n in enumerate(names):
        x = shapes[i % 2] + draw.normal(size=(16, 3)) * 0.1
        (tmp_path / "pdb" / f"{n}.pdb").write_text("\n".join(ATOM.format(k + 1, k + 1, *x[k], 50) for k in range(16)) + "\nTER\n")
        if i:
            (tmp_path / "pdb" / f"{n}.dssp").write_text("  #  RESIDUE\n" + "\n".join(f"{k + 1:>5}{k + 1:>5} A {'LK'[k % 2]}  H{' ' * 17}{20 if k % 2 == 0 else 150:>4}" for k in range(16)))
        np.savez(tmp_path / "emb" / f"{n}.npz", emb=draw.normal(size=(16, 5)).astype(np.float16))
    main(["metrics", "--structures", p("pdb"), "--secondary", p("pdb"), "--out", p("m"), "--metadata", p("lib/metadata")])
    rows = csv("m/metrics")
    assert len(rows) == 5 and {r["helix_fraction"] for r in rows} == {"1.0"} and {r["topology_checked_for_rasa_success"] for r in rows} == {"1"} and [r["variant_id"] for r in csv("m/skipped")] == [names[0]]
    assert [(r["group_id"], r["n_structures_total"]) for r in csv("m/summary")] == [(NAME, "5")]
    main(["cluster", "--structures", p("pdb"), "--out", p("c")])
    assert {r["n_clusters"] for r in csv("c/assignments")} == {"2"} and len(csv("c/medoids")) == 2
    main(["average", "--structures", p("pdb"), "--assignments", p("c/assignments"), "--out", p("a")])
    assert len(csv("a/mean")) == 32 and {r["n_used"] for r in csv("a/manifest")} == {"3"}
    main(["pca", "--vectors", p("emb"), "--out", p("pca"), "--k", "3"])
    main(["overlay", "--structures", p("pdb"), "--vectors", p("emb"), "--model", p("pca"), "--out", p("o"), "--which", "2"])
    report = csv("o/report")
    assert len(report) == 6 and {r["n_ca_written"] for r in report} == {"16"} and {r["reason"] for r in report} == {None}
    main(["overlay", "--structures", p("pdb"), "--vectors", p("emb"), "--model", p("pca"), "--out", p("o"), "--which", "2", "--limit", "2"])
    assert {(r["ok"], r["reason"]) for r in csv("o/report")} == {("true", "skipped_exists")}
    (tmp_path / "few").write_text(f"{names[0]}\nnobody\n")
    main(["pca", "--vectors", p("emb"), "--out", p("pca2"), "--k", "2", "--most", "20", "--no-scores"])
    assert [(r["n_sequences"], r["n_residues_used"], r["embedding_dim"]) for r in csv("pca2/report")] == [("2", "20", "5")]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "z.pdb").write_text("END\n")
    main(["overlay", "--structures", p("none"), "--vectors", p("emb"), "--model", p("pca2"), "--out", p("o2"), "--ids", p("few")])
    assert [(r["variant_id"], r["ok"], r["reason"]) for r in csv("o2/report")] == [(names[0], "false", "missing_pdb")]
    main(["overlay", "--structures", p("pdb"), "--vectors", p("emb"), "--model", p("pca2"), "--out", p("o3"), "--which", "3", "--ids", p("few")])
    assert [(r["ok"], r["reason"]) for r in csv("o3/report")] == [("false", "pc_scores_shape_mismatch")]


def test_predict_and_embed_steps(spark, tmp_path, monkeypatch):
    p = lambda x: str(tmp_path / x)
    csv = lambda x: spark.read.option("header", True).csv(p(x)).collect()
    atom = ATOM.format(1, 1, 1, 2, 3, 50)
    given = {"c": lambda: lambda seq: (404, "", None) if "W" in seq else (200, atom, None), "m": lambda: lambda seqs: [np.full((len(s), 3), len(s), np.float32) for s in seqs]}
    monkeypatch.setattr("quartzfold.steps._factory", given.get)
    (tmp_path / "v.fa").write_text(">a\nACD\n>b\nAWD\n>c\nACDEF\n>a\nACDE\n")
    (tmp_path / "ids").write_text("a\nb\n")
    for wanted in ({"a": "ok", "b": "failed"}, {"a": "skipped", "b": "failed"}):
        main(["predict", "--fasta", p("v.fa"), "--out", p("p"), "--client", "c", "--ids", p("ids"), "--pause", "0.001"])
        assert {r["variant_id"]: r["status"] for r in csv("p/report")} == wanted
    assert len(list((tmp_path / "p" / "structures").glob("variant_id=a/part*"))) == 1 and [r[0] for r in spark.read.text(p("p/failed")).collect()] == ["b"]
    (tmp_path / "s.csv").write_text("template_id,variant_id,cluster_id\nt,a,1\nt,b,1\nt,c,2\nt,x,2\n")
    main(["embed", "--fasta", p("v.fa"), "--out", p("e"), "--model", "m", "--mode", "cluster_sample_k", "--assignments", p("s.csv"), "--k", "1"])
    main(["embed", "--fasta", p("v.fa"), "--out", p("e"), "--model", "m", "--assignments", p("s.csv")])
    rows = sorted((r["variant_id"], r["cluster_id"], r["sequence_length"], r["status"], r["error"]) for r in spark.read.parquet(p("e/index")).collect())
    assert rows == [("a", 1, 4, "ok", ""), ("a", 1, 4, "skipped", "exists_valid"), ("b", 1, 3, "ok", ""), ("c", 2, 5, "ok", ""), ("c", 2, 5, "skipped", "exists_valid")]
    main(["pca", "--vectors", p("e/vectors"), "--out", p("pca"), "--k", "1"])
    assert csv("pca/report")[0]["n_residues_used"] == "12"
    (tmp_path / "v.fa").write_text(">a\nACC\n")
    with pytest.raises(ValueError, match="another sequence"):
        main(["embed", "--fasta", p("v.fa"), "--out", p("e"), "--model", "m"])


def test_cluster_step_filters_and_names_the_rest(spark, tmp_path):
    draw = np.random.default_rng(4)
    p = lambda x: str(tmp_path / x)
    (tmp_path / "pdb").mkdir()
    starts, good = (3, 20, 36, 54), draw.normal(size=(60, 3)) * 2
    for k, s in enumerate(starts):
        good[s - 1 : s + 6] += [40.0 * (k % 2), 15.0 * (k // 2), 0]  # both helix pairs lie along x
    bad = good.copy()
    bad[53:60] += [-40, 60, 0]
    other = good[::-1] + draw.normal(size=good.shape) * 3
    shapes = {"a": good, "b": good + draw.normal(size=good.shape) * 0.1, "c": other, "d": bad, "e": bad, "lone": bad, "f": good, "g": bad, "stray": good}
    for n, x in shapes.items():
        (tmp_path / "pdb" / f"{n}.pdb").write_text("\n".join(ATOM.format(k + 1, k + 1, *x[k], 50) for k in range(60)) + "\n")
    rasa = {"a": 0.2, "b": 0.2, "c": "", "d": 0.2, "e": 0.9, "lone": 0.1, "f": 0.2, "g": 0.2, "stray": 0.9}
    (tmp_path / "m.csv").write_text("variant_id,helix_fraction,mean_hydrophobic_rasa\n" + "".join(f"{n},1,{v}\n" for n, v in rasa.items()))
    names = {"t": "abcdex", "u": ["lone", "y"], "v": "fgz"}
    (tmp_path / "meta.csv").write_text("template_id,variant_id\n" + "".join(f"{t},{v}\n" for t, vs in names.items() for v in vs))
    main(["cluster", "--structures", p("pdb"), "--out", p("c"), "--metrics", p("m.csv"), "--metadata", p("meta.csv")])
    rows = {r["variant_id"]: r for r in spark.read.option("header", True).csv(p("c/assignments")).collect()}
    assert {n: r["note"] for n, r in rows.items() if r["note"]} == {
        "d": "filtered_bad_topology_among_rasa_passers", "x": "missing_pdb", "lone": "too_few_structures", "y": "missing_pdb_or_too_few_structures", "f": "too_few_structures_after_filtering",
        "g": "filtered_bad_topology_among_rasa_passers", "z": "missing_pdb",
    }
    assert {n for n, r in rows.items() if r["cluster_id"]} == {"a", "b", "c", "e"} and {rows[n]["template_id"] for n in "abcdex"} == {"t"}
    assert rows["x"]["cutoff"] == rows["d"]["cutoff"] == rows["a"]["cutoff"] and rows["z"]["cutoff"] is None and len(rows) == 11


def test_average_step_writes_backbones(spark, tmp_path):
    draw = np.random.default_rng(5)
    p = lambda x: str(tmp_path / x)
    (tmp_path / "pdb").mkdir()
    base = draw.normal(size=(5, 4, 3)) * 5
    turn = np.array([[0, 1, 0], [-1, 0, 0], [0, 0, 1.0]])
    row = "{:<6}{:>5}  {:<3} {:<3} {}{:>4}    {:>8.3f}{:>8.3f}{:>8.3f}  1.00 50.00"

    def write(name, x):
        lines = [row.format("ATOM", 4 * k + j + 1, a, "ALA", "A", k + 1, *x[k, j]) for k in range(5) for j, a in enumerate(("N", "CA", "C", "O")) if (k, a) != (4, "N")]
        lines += [row.format("HETATM", 90, "CA", "CA", "A", 90, 1, 2, 3), row.format("ATOM", 91, "CA", "ALA", "B", 1, *draw.normal(size=3))]
        (tmp_path / "pdb" / f"{name}.pdb").write_text("\n".join(lines) + "\nEND\n")

    for name, shift in (("a", 0), ("b", 0.3), ("c", -0.3)):
        x = base.copy()
        x[:, 0, 2] += shift  # N off by as much up as down
        write(name, x if name == "a" else x @ turn + 7)
    (tmp_path / "s.csv").write_text("template_id,variant_id,cluster_id,is_medoid\nt|1,a,1,true\nt|1,b,1,false\nt|1,c,1,false\nt|1,gone,1,false\nt|1,none,2,true\n")
    main(["average", "--structures", p("pdb"), "--assignments", p("s.csv"), "--out", p("o")])
    m = {r["cluster_id"]: r for r in spark.read.option("header", True).csv(p("o/manifest")).collect()}
    assert (m["1"]["reference"], m["1"]["n_used"], m["1"]["skipped"], m["1"]["note"]) == ("a", "3", "gone", None)
    assert m["2"]["note"].startswith("average_failed") and m["2"]["out_pdb_path"] is None and m["2"]["n_used"] == "0"
    got = open(m["1"]["out_pdb_path"].removeprefix("file:").replace("///", "/")).read().splitlines()
    wanted = (tmp_path / "pdb" / "a.pdb").read_text().splitlines()
    assert len(got) == len(wanted)
    xyz = lambda s: np.array([float(s[i : i + 8]) for i in (30, 38, 46)])
    for g, w in zip(got, wanted, strict=True):
        assert g[:30] == w[:30] and g[54:] == w[54:] and (g == w or np.allclose(xyz(g), xyz(w), atol=0.003))
    assert len(spark.read.option("header", True).csv(p("o/mean")).collect()) == 12
