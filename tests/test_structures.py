"""Structure operators against golden values and plain numpy."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartzfold.operators.averaging import average_clusters
from quartzfold.operators.clustering import ClusterSpec, assignment_rows, cluster_groups, cutoff_search, distance_summary, label_quality, labels_at, medoids, merges, silhouette
from quartzfold.operators.metrics import gate, mean_bfactor, residue_metrics, summary, with_group
from quartzfold.operators.overlay import overlay, overlay_report
from quartzfold.operators.pca import fit_pca, project
from quartzfold.operators.rmsd import close_pairs, distances, rmsd, rmsd_to, single_linkage
from quartzfold.operators.topology import bundle_topology, connectivity_filter, helix_centroids

X = np.array([[0, 0, 0], [1, 0, 0], [1, 1, 0], [1, 1, 1]], float)
TURN = np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1]], float)


def test_superposed_distance():
    moved = X.copy()
    moved[3, 2] += 1
    pairs = [X @ TURN.T + 5, X * [1, 1, -1], moved]
    assert np.allclose(rmsd(np.stack([X] * 3), np.stack(pairs)), [0, 0.5411961001, 0.4001250958], atol=1e-9)


def test_all_distances_against_single_ones():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(30, 21)) * 3
    x[5], x[6] = x[4], x[4] + 1e-7 * draw.normal(size=21)
    x[7] = (x[4].reshape(-1, 3) * [1, 1, -1]).ravel()
    x[8] = np.outer(np.arange(7), [1, 2, 3]).ravel()  # a line
    x[9] = (x[8].reshape(-1, 3) @ TURN).ravel()
    one = np.array([[rmsd(a.reshape(1, -1, 3), b.reshape(1, -1, 3))[0] for b in x] for a in x])
    assert np.allclose(distances(x, x, True), one, atol=1e-9)
    assert np.allclose(distances(x, x[:3], False), np.sqrt(((x[:, None] - x[:3]) ** 2).sum(axis=2)))


def test_cutoff_search_golden():
    p = np.array([0, 1, 5, 6.5])
    d = np.abs(p[:, None] - p)
    cutoff, s, labels = cutoff_search(d, ClusterSpec())
    assert (round(cutoff, 9), round(s, 9), labels.tolist()) == (1.543367347, 0.758056827, [1, 1, 2, 2])
    assert medoids(d, labels).tolist() == [True, False, True, False]


@pytest.mark.parametrize("linkage", ["single", "complete", "average"])
def test_linkage_against_brute_force(linkage):
    x = np.random.default_rng(0).normal(size=(24, 3))
    d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    groups = [[i] for i in range(24)]
    between = {"single": np.min, "complete": np.max, "average": np.mean}[linkage]
    heights = []
    while len(groups) > 1:
        h, a, b = min((between(d[np.ix_(p, q)]), i, j) for (i, p), (j, q) in itertools.combinations(enumerate(groups), 2))
        heights.append(h)
        groups[a] += groups.pop(b)
    steps = merges(d, linkage)
    assert np.allclose([s[0] for s in steps], heights)
    labels = labels_at(steps, 24, steps[15][0])
    assert labels.max() == 24 - 16
    own = [[j for j in range(24) if labels[j] == labels[i] and j != i] for i in range(24)]
    s = [0 if not o else (lambda a, b: (b - a) / max(a, b))(d[i, o].mean(), min(d[i, labels == c].mean() for c in set(labels) - {labels[i]})) for i, o in enumerate(own)]
    assert np.isclose(silhouette(d, labels), np.mean(s))


def frames(spark, n=60, seed=1):
    draw = np.random.default_rng(seed)
    base = draw.normal(size=(3, 12))
    return spark.createDataFrame([("g" if i < n - 5 else "small", i, (base[i % 3] + draw.normal(size=12) * 0.05).tolist()) for i in range(n)] + [("one", 900, [0.0] * 12), ("odd", 901, [1.0] * 12), ("odd", 902, [1.0] * 9)], "group_id string, item long, coords array<double>")


def test_clusters_of_groups(spark):
    rows = cluster_groups(frames(spark)).collect()
    by = {g: [r for r in rows if r["group_id"] == g] for g in ("g", "one", "odd")}
    assert {r["n_clusters"] for r in by["g"]} == {3} and sum(r["is_medoid"] for r in by["g"]) == 3
    assert all(len({r["cluster_id"] for r in by["g"] if r["item"] % 3 == k}) == 1 for k in range(3))
    assert [r["note"] for r in by["one"]] == ["too_few_structures"] and {r["note"] for r in by["odd"]} == {"cluster_failed: structures differ in length"}
    assert cluster_groups(frames(spark).where("false")).count() == 0
    d = {r["group_id"]: r for r in distance_summary(frames(spark).where("group_id <> 'odd'")).collect()}
    assert d["g"]["n_pairs"] == 55 * 54 // 2 and "one" not in d


@pytest.mark.parametrize("how", [{}, {"superposed": False}, {"fixed": 0.01}, {"greatest": 2}, {"linkage": "complete"}, {"linkage": "average", "superposed": False}])
def test_large_groups_in_blocks(spark, monkeypatch, how):
    df = frames(spark).where("group_id <> 'odd'")
    monkeypatch.setattr("quartzfold.operators.blocks.BLOCK", 20)
    small, large = ClusterSpec(**how), ClusterSpec(most=10, **how)
    near = lambda v: round(v, 9) if isinstance(v, float) else v
    rows = lambda f: sorted((tuple(near(v) for v in r) for r in f.collect()), key=str)
    assert rows(cluster_groups(df, large)) == rows(cluster_groups(df, small))
    assert rows(distance_summary(df, large)) == rows(distance_summary(df, small))


def test_a_group_beyond_one_task(spark):
    draw = np.random.default_rng(4)
    x = np.array([[0.0, 0], [9, 0], [0, 30]])[np.arange(6_000) % 3] + draw.uniform(-1, 1, (6_000, 2))
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate(x.tolist())], "group_id string, item long, coords array<double>").repartition(8)
    rows = cluster_groups(df, ClusterSpec(superposed=False, cutoffs=5, high=0.3)).collect()
    label = {r["item"]: r["cluster_id"] for r in rows}
    assert len(rows) == 6_000 and all(label[i] == i % 3 + 1 for i in label) and {r["note"] for r in rows} == {""} and sum(r["is_medoid"] for r in rows) == 3


def test_quality_of_given_labels(spark, monkeypatch):
    monkeypatch.setattr("quartzfold.operators.blocks.BLOCK", 20)
    df = frames(spark).where("group_id <> 'odd'").withColumn("label", F.when(F.col("item") == 7, 9).otherwise((F.col("item") % 3).cast("int")))
    got = {(r["group_id"], r["label"]): r for r in label_quality(df, ClusterSpec(superposed=False)).collect()}
    rows = sorted((r["item"], r["label"], np.array(r["coords"])) for r in df.where("group_id = 'g'").collect())
    x, labels = np.stack([r[2] for r in rows]), np.unique([r[1] for r in rows], return_inverse=True)[1]
    d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    assert np.isclose(got["g", 9]["silhouette"], silhouette(d, labels + 1)) and got["g", 9]["medoid"] == 7 and got["g", 9]["size"] == 1
    assert {got["g", k]["medoid"] for k in range(3)} | {7} == {rows[i][0] for i in np.flatnonzero(medoids(d, labels))}
    assert got["one", 0]["silhouette"] is None and got["one", 0]["medoid"] == 900


def test_blocks_find_all_close_pairs(spark):
    df = frames(spark)
    rows = [(r["group_id"], r["item"], np.array(r["coords"]).reshape(-1, 3)) for r in df.collect()]
    wanted = {(g, a, b) for (g, a, x), (h, b, y) in itertools.permutations(rows, 2) if g == h and a < b and len(x) == len(y) and rmsd(x[None], y[None])[0] <= 0.3}
    got = [tuple(r) for r in close_pairs(df, 0.3, block=7).collect()]
    assert len(got) == len(set(got)) and set(got) == wanted
    labels = {r["item"]: r["cluster"] for r in single_linkage(df, 0.3).collect()}
    assert labels[900] == 900 and all(labels[a] == labels[b] for _, a, b in wanted)


def test_means_of_clusters(spark):
    draw = np.random.default_rng(5)
    base = draw.normal(size=(6, 3))
    rows = []
    for i in range(9):
        q, _ = np.linalg.qr(draw.normal(size=(3, 3)))
        q *= np.sign(np.linalg.det(q))
        rows.append(("t", 1, f"m{i}", i == 4, (base @ q + draw.normal(size=3)).ravel().tolist()))
    rows += [("t", 1, "short", False, [0.0] * 3), ("t", 1, "none", False, None), ("t", 2, "only", False, base.ravel().tolist()), ("t", None, "x", False, base.ravel().tolist())]
    df = spark.createDataFrame(rows, "group_id string, cluster_id int, item string, is_medoid boolean, coords array<double>")
    mean, manifest = average_clusters(df)
    got = np.array([[r["x"], r["y"], r["z"]] for r in mean.where("cluster_id = 1").orderBy("atom").collect()])
    assert np.allclose(got, np.array(rows[4][4]).reshape(-1, 3), atol=1e-9)
    m = {r["cluster_id"]: r for r in manifest.collect()}
    assert (m[1]["reference"], m[1]["n_total"], m[1]["n_used"], m[1]["skipped"]) == ("m4", 11, 9, ["none", "short"]) and m[2]["reference"] == "only"
    far = {r["item"]: r["rmsd"] for r in rmsd_to(df.where("item = 'm4'").select("group_id", "coords"), df.where("coords is not null"), "group_id").collect()}
    assert far["m1"] < 1e-9 and far["short"] is None


def test_gate_truth_table(spark):
    cases = [
        (None, 0.9, True, (None, 0, None, None, "missing_mean_hydrophobic_rasa")), (float("nan"), 0.9, True, (None, 0, None, None, "missing_mean_hydrophobic_rasa")), (0.3, 0.9, True, (0, 0, None, 0, "rasa_above_threshold")),
        (0.2, 0.9, False, (1, 0, None, 1, None)), (0.2, -0.9, True, (1, 1, 0, 1, None)), (0.25, 0.1, True, (1, 1, 1, 0, "bad_topology_among_rasa_passers")), (0.2, None, True, (1, 0, None, None, "topology_not_measurable")),
    ]
    df = spark.createDataFrame([c[:3] for c in cases], "r double, c double, h boolean")
    assert [tuple(x["g"]) for x in df.select(gate(F.col("r"), F.col("c"), F.col("h")).alias("g")).collect()] == [c[3] for c in cases]
    off = df.select(gate(F.col("r"), F.col("c"), F.col("h"), on=False).alias("g")).collect()
    assert [x["g"]["success"] for x in off] == [None, None, 0, 1, 1, 1, 1]


def test_residue_metrics_and_summary(spark):
    residues = spark.createDataFrame([("a", 1, "L", "H", "0.1"), ("a", 2, "K", "T", "0.9"), ("a", 3, "V", "G", "NA"), ("b", 1, "L", "H", "0.5")], "variant_id string, dssp_index int, aa string, ss string, rasa string")
    skip = spark.createDataFrame([("b", [1])], "variant_id string, positions array<int>")
    m = {r["variant_id"]: r for r in residue_metrics(residues, skip).collect()}
    assert (m["a"]["n_res_dssp"], m["a"]["n_helix_res"], m["a"]["mean_hydrophobic_rasa"]) == (3, 2, 0.1)
    assert m["b"]["n_res_dssp"] == 0 and m["b"]["note"] and m["b"]["mean_hydrophobic_rasa"] is None
    atoms = spark.createDataFrame([("a", 1, 10.0), ("a", 2, float("nan")), ("b", 1, 5.0)], "variant_id string, resseq int, bfactor double")
    assert {r[0]: r[1] for r in mean_bfactor(atoms, skip).collect()} == {"a": 10.0, "b": None}
    rows = spark.createDataFrame([("t_var1", 100, 1.0, 0.5, 0.0625, 1), ("t_var2", 101, None, float("nan"), 0.0625, None), ("u_var1", 9, None, 0.1, None, None)], "variant_id string, n_res_dssp int, mean_all_atom_bfactor double, helix_fraction double, mean_hydrophobic_rasa double, rasa_success_after_topology_gate int")
    meta = spark.createDataFrame([(1, "t_var2", "old"), (2, "t_var2", "t")], "row_id long, variant_id string, template_id string")
    s = {r["group_id"]: r for r in summary(with_group(rows, meta)).collect()}
    assert (s["t"]["sequence_length"], s["t"]["avg_helicity"], s["t"]["avg_hydrophobic_rasa"], s["t"]["fraction_success"], s["t"]["n_structures_total"]) == (100.5, 0.5, 0.062, 1.0, 2)
    assert s["u"]["fraction_success"] is None


def test_topology(spark):
    line = lambda v, start, d: [("v" + v, 0, 0, " ", "CA", start + i, float(start + i * d[0]), float(i * d[1]), 0.0) for i in range(2)]
    rows = [r for v in ("1",) for k, d in enumerate([(1, 0), (1, 0), (0, 1), (0, 1)]) for r in line(v, 10 * k, d)] + [("v1", 1, 0, " ", "CA", 1, 99.0, 99.0, 99.0), ("v2", 0, 0, " ", "CA", 1, 1.0, 1.0, 1.0)]
    atoms = spark.createDataFrame(rows, "variant_id string, model_idx int, chain_ord int, hetflag string, atom_name string, resseq int, x double, y double, z double")
    ranges = atoms.select("variant_id").distinct().select("variant_id", F.array(*[F.struct(F.lit(10 * k).alias("start"), F.lit(10 * k + 5).alias("end")) for k in range(4)]).alias("ranges"))
    t = {r["variant_id"]: r for r in bundle_topology(helix_centroids(atoms, ranges)).collect()}
    assert abs(t["v1"]["abs_cosine"] - 1) < 1e-9 and abs(t["v1"]["folded_angle_degrees"]) < 1e-5 and t["v2"]["reason"] == "no CA atoms in a helix range"
    s = spark.createDataFrame([("v1", 0.2), ("v2", 0.2), ("v3", 0.9), ("v4", None), ("v5", float("nan"))], "variant_id string, rasa double")
    kept = {r["variant_id"]: (r["kept"], r["note"]) for r in connectivity_filter(s, bundle_topology(helix_centroids(atoms, ranges))).collect()}
    assert kept["v1"] == (True, None) and not kept["v2"][0] and kept["v3"][0] and kept["v4"][0] and kept["v5"][0]


def test_components_and_scores(spark):
    x = np.random.default_rng(2).normal(size=(200, 5)) @ np.diag([5, 3, 2, 1, 0.5]) + 7
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [float("nan")] * 5)], "id int, v array<double>").repartition(5)
    m = fit_pca(df, "v", 3)
    _, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert m.n == 200 and np.allclose(m.singular, s[:3]) and np.allclose(np.abs(m.components @ vt[:3].T), np.eye(3), atol=1e-8) and np.allclose(m.explained, s[:3] ** 2 / (s**2).sum())
    got = {r["id"]: r["pc"] for r in project(df, "v", m).collect()}
    assert np.allclose(got[3], (x[3] - x.mean(axis=0)) @ m.components.T, atol=1e-4) and got[900] is None
    with pytest.raises(ValueError):
        fit_pca(df.where("false"), "v", 1)


def test_scores_in_lines(spark):
    text = "ATOM  %5d  %-3s ALA A%4d      11.104   6.134  -6.504  1.00  0.00           C"
    lines = spark.createDataFrame([("v", i, text % (i, "CA" if i % 2 else "CB", i)) for i in range(1, 6)] + [("v", 6, "TER")], "variant_id string, line_no int, line string")
    scores = spark.createDataFrame([("v", k, s) for k, s in enumerate([1.005, 0.125, -123.456, 4.0])], "variant_id string, pos int, score double")
    out = {r["line_no"]: r for r in overlay(lines, scores).collect()}
    assert [out[i]["line"][60:66] for i in (1, 3, 5)] == ["  1.00", "  0.12", "  0.00"] and not out[5]["written"]
    assert out[2]["line"] == text % (2, "CB", 2) and out[6]["line"] == "TER" and len(out) == 6
    r = overlay_report(overlay(lines, scores), scores).first()
    assert (r["n_ca_written"], r["n_pc_available"], r["reason"]) == (2, 4, "pc_longer_than_ca: wrote 2 CA values, had 4")


def test_rows_of_a_run(spark):
    done = spark.createDataFrame([("t", "a", 1, True, 0.5, 0.4, 2, "")], "template_id string, variant_id string, cluster_id int, is_medoid boolean, cutoff double, silhouette double, n_clusters int, note string")
    ids = spark.createDataFrame([("t", "b"), ("u", "c")], "template_id string, variant_id string")
    rows = {r["variant_id"]: r for r in assignment_rows(done, ids, ids.where("false")).collect()}
    assert rows["b"]["cutoff"] == 0.5 and rows["b"]["note"] == "missing_pdb" and rows["c"]["cutoff"] is None and rows["a"]["cluster_id"] == 1
