"""Settings, the evidence model, artifacts, the graph out of tables, and evidence of documents."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from credence.functions import masses as M
from credence.functions import settings
from credence.operators import catalogue, etl, gnn, network
from credence.sources import artifacts, documents


def test_settings(tmp_path):
    assert settings.features({"feature_properties": ["a", "text_score", "a"], "recommended_candidate_features": True})[:3] == ["a", "text_score", "degree_score"]
    assert len(settings.features({"recommended_candidate_features": True})) == 19
    targets, weights = "classification_label_properties", "classification_task_loss_weights"
    assert settings.setting({"classification": True}, targets)["radar_type"] == "radar_id" and settings.setting({}, targets) == {}
    assert settings.setting({targets: {"a": 1}}, targets) == {"a": "1"}
    assert settings.setting({}, weights) == settings.TASK_WEIGHTS and settings.setting({weights: {"x": 2}}, weights) == {"x": 2.0}
    assert settings.setting({"mass_label_smoothing": 1}, "mass_label_smoothing") == 1.0 and settings.setting({}, "mass_label_smoothing") == 0.01
    assert settings.split_fractions({}) == (0.5, 0.3, 0.2)
    for bad in (
        lambda: settings.features({}), lambda: settings.setting({weights: {"x": -1}}, weights), lambda: settings.setting({"mass_label_smoothing": 1.1}, "mass_label_smoothing"),
        lambda: settings.split_fractions({"train_fraction": 0.6}), lambda: settings.check_names(["speed", "best_Mode_ID"]),
    ):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        settings.setting({targets: ["a"]}, targets)
    settings.check_names(["speed", "text_score"])
    (tmp_path / "s.json").write_text('{"training": {"epochs": 3}}')
    assert settings.read(str(tmp_path / "s.json"))["training"]["epochs"] == 3
    pytest.importorskip("yaml")
    (tmp_path / "s.yaml").write_text("training:\n  epochs: 4\n")
    assert settings.read(str(tmp_path / "s.yaml"))["training"]["epochs"] == 4


def test_targets_and_leaks(spark):
    rows = spark.sql("select named_struct('mode', '', 'radar_mode', 'm2', 'radar', 'r1', 'operator', null, 'operator_country', 'o1') as gt, 1 as speed")
    got = rows.select(*settings.target_columns("gt", rows.schema["gt"].dataType.names)).first()
    assert (got.aircraft_variant, got.radar_mode, got.radar_type, got.operator_country) == (None, "m2", "r1", "o1")
    settings.check_no_truth(rows)
    with pytest.raises(ValueError):
        settings.check_no_truth(rows.select(F.struct(F.col("gt").alias("ground_truth_label")).alias("deep")))


def small_model(kind="softmax", names=("b-1", "s-2"), **more):
    rng = np.random.default_rng(3)
    width, masks = 4, len(M.frame(names))
    layer = network.Layer(rng.normal(size=(2, width, width)).tolist(), rng.normal(size=(2, 2)).tolist(), rng.normal(size=(width, width)).tolist(), [0.5, 0.8], rng.normal(size=width).tolist())
    heads = {"kind": (rng.normal(size=(width, 3)).tolist(), [0.1, 0.2, 0.3])}
    given = dict(tasks={"kind": 3, "name": len(names)}, heads=heads, kind=kind) | more
    return network.Model(names, (rng.normal(size=(3, width)).tolist(), rng.normal(size=width).tolist()), [layer], (rng.normal(size=(width, masks)).tolist(), rng.normal(size=masks).tolist()), **given)


@pytest.mark.parametrize("kind", ["softmax", "dirichlet"])
def test_evidence_model_equals_numpy(spark, kind):
    model = small_model(kind)
    rng = np.random.default_rng(0)
    x, edges = rng.normal(size=(5, 3)), [(0, 1, 0), (2, 1, 1), (3, 4, 0), (4, 0, 1)]
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node_id long, x array<double>")
    links = spark.createDataFrame(edges, "src long, dst long, rel int")
    h = gnn.gelu(gnn.layer_norm(x @ np.array(model.entry[0]) + model.entry[1]))
    layer = model.layers[0]
    w = np.einsum("rb,bio->rio", np.array(layer.mix), np.array(layer.bases))
    out = h @ np.array(layer.own) + layer.bias
    for d in range(5):
        inbound = [layer.gates[r] * h[s] @ w[r] for s, t, r in edges if t == d]
        out[d] += sum(inbound) / max(1, len(inbound)) if inbound else 0
    h = h + gnn.layer_norm(gnn.gelu(out))
    logits = h @ np.array(model.mass_head[0]) + model.mass_head[1]
    e = np.exp(logits - logits.max(1, keepdims=True))
    alpha = np.log1p(np.exp(logits)) + 1
    masses = e / e.sum(1, keepdims=True) if kind == "softmax" else alpha / alpha.sum(1, keepdims=True)
    middle = np.stack([masses[:, 0] + masses[:, 2] / 2, masses[:, 1] + masses[:, 2] / 2], axis=1)
    scored = network.forward(nodes, links, model).orderBy("node_id").cache()
    rows = scored.collect()
    assert np.allclose([r.masses for r in rows], masses) and np.allclose([r.name for r in rows], middle)
    assert np.allclose([r.kind for r in rows], h @ np.array(model.heads["kind"][0]) + model.heads["kind"][1])
    assert [r.uncertainty for r in rows] == [None] * 5 if kind == "softmax" else np.allclose([r.uncertainty for r in rows], 3 / alpha.sum(1))
    found = network.predictions(scored, model, {"kind": ["x", "y", "z"], "name": list(model.hypotheses)}).orderBy("node_id").collect()
    for r, m, k in zip(found, masses, rows, strict=True):
        assert np.isclose(r.intervals[0].belief, m[0]) and np.isclose(r.intervals[1].plausibility, m[1] + m[2])
        assert r.classifications.kind.label == "xyz"[int(np.argmax(k.kind))] and np.isclose(sum(r.classifications.kind.probabilities), 1)
    assert np.isclose(network.l1_norm(model), np.abs(model.parameters()).sum()) and len(model.parameters()) == 3 * 4 + 4 + 4 * 3 + 3 + 4 * 3 + 3 + 2 * 16 + 4 + 16 + 2 + 4


def test_models_that_can_not_be():
    for more in (dict(kind="sum"), dict(tasks={"a": 1}), dict(tasks={"a.b": 2}), dict(tasks={"a": 5}), dict(names=())):
        with pytest.raises(ValueError):
            small_model(**more)


def test_losses_and_classes(spark):
    rows = spark.createDataFrame([([0.5, 0.5], [0.4, 0.6], [1.0, 2.0, 0.0], "b"), ([0.9, 0.1], [1.0, 0.0], [0.0, 0.0, 3.0], "c"), ([0.2, 0.8], [0.2, 0.8], [5.0, 0.0, 0.0], None)], "masses array<double>, target array<double>, t array<double>, label string")
    named, classes = network.class_indexes(rows, "label", ["a", "b", "c"])
    assert classes == ["a", "b", "c"] and [r.label_label for r in named.orderBy(F.col("t")[0]).collect()] == [2, 1, -1]
    assert network.class_indexes(rows, "label")[1] == ["b", "c"]
    with pytest.raises(ValueError, match="no class"):
        network.class_indexes(rows, "label", ["a", "b"])
    with pytest.raises(ValueError, match="two classes"):
        network.class_indexes(rows.where("label = 'b'"), "label")
    got = network.losses(named.withColumnRenamed("label_label", "t_label"), {"t": 3}, {"t": 2.0}, smoothing=0.1, penalty=0.0).first()
    p = np.array([[1.0, 2.0, 0.0], [0.0, 0.0, 3.0]])
    logs = p - np.log(np.exp(p).sum(1, keepdims=True))
    want = np.mean([-(0.9 * logs[0, 1] + 0.1 * logs[0].mean()), -(0.9 * logs[1, 2] + 0.1 * logs[1].mean())])
    kl = np.mean([0.4 * np.log(0.4 / 0.5) + 0.6 * np.log(0.6 / 0.5), np.log(1 / 0.9), 0.0])
    assert np.isclose(got.classification_loss, 2 * want) and np.isclose(got.mass_loss, kl) and np.isclose(got.loss, kl + 2 * want)


def test_attention_of_several_heads_equals_numpy(spark):
    rng = np.random.default_rng(5)
    n, width, heads, rels = 6, 4, 2, 2
    x, edges = rng.normal(size=(n, width)), [(0, 1, 0), (2, 1, 1), (3, 1, 0), (4, 5, 1)]
    q, k, v = rng.normal(size=(heads, width, 2)), rng.normal(size=(rels, heads, width, 2)), rng.normal(size=(rels, heads, width, 2))
    prior, out = rng.normal(size=(rels, heads)), rng.normal(size=(heads * 2, width))
    mean = np.zeros((n, heads * 2))
    for d in range(n):
        got = []
        for s, t, r in edges:
            if t == d:
                got.append(np.concatenate([1 / (1 + np.exp(-(x[d] @ q[h]) @ (x[s] @ k[r, h]) * prior[r, h] / np.sqrt(2))) * (x[s] @ v[r, h]) for h in range(heads)]))
        mean[d] = np.mean(got, axis=0) if got else 0
    nodes = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "node_id long, x array<double>")
    links = spark.createDataFrame(edges, "src long, dst long, rel int")
    rows = network.attention(nodes, links, q.tolist(), k.tolist(), v.tolist(), prior.tolist(), out.tolist()).orderBy("node_id").collect()
    assert np.allclose([r.x for r in rows], gnn.layer_norm(x + gnn.gelu(mean @ out)))


def test_heads_are_fitted(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=3) + 3 * np.eye(3)[i % 3]).tolist(), i % 3 if i % 5 else -1) for i in range(150)]
    df = spark.createDataFrame(rows, "node_id long, x array<double>, t_label int")
    w, b = network.fit_heads(df, {"t": 3}, {"t": 100.0})["t"]
    guess = np.argmax(np.array([r[1] for r in rows]) @ np.array(w) + b, axis=1)
    assert np.mean(guess == [r[0] % 3 for r in rows]) > 0.9


def test_artifacts(spark, tmp_path):
    path = f"{tmp_path}/run"
    found = spark.createDataFrame([(1, [("a", 0.2, 0.5), ("b", 0.5, 0.6), ("c", 0.2, 0.9)])], "node_id long, intervals array<struct<hypothesis:string,belief:double,plausibility:double>>")
    artifacts.write_run(spark, path, found, [{"epoch": 1, "val_loss": 0.5}], {"test": {"loss": 0.4}}, {"kind": "softmax"}, best={"epoch": 1})
    assert artifacts.read_document(spark, f"{path}/history.json") == [{"epoch": 1, "val_loss": 0.5}]
    assert (tmp_path / "run" / "metrics.json").read_text() == '{\n  "test": {\n    "loss": 0.4\n  }\n}\n' and spark.read.json(f"{path}/node_evidence").count() == 1
    assert [x.hypothesis for x in artifacts.top_intervals(found, 2).first().identifications] == ["b", "a"]
    nodes, edges = spark.createDataFrame([("a", "X")], "id string, label string"), spark.createDataFrame([("a", "R", "a")], "source string, relation string, target string")
    artifacts.write_graph(spark, nodes, edges, f"{path}/graph")
    back = artifacts.read_graph(spark, f"{path}/graph")
    assert back[0].count() == 1 and back[1].first().relation == "R"
    artifacts.write_document(spark, f"{path}/graph/metadata.json", {"version": 2})
    with pytest.raises(ValueError, match="version 2"):
        artifacts.read_graph(spark, f"{path}/graph")
    (tmp_path / "kg.json").write_text(json.dumps({"nodes": [{"id": "r", "label": "Radar", "properties": {"name": "R"}}], "edges": [{"source": "r", "relation": "HAS_MODE", "target": "m"}]}, indent=2))
    n, e = artifacts.read_graph_json(spark, str(tmp_path / "kg.json"))
    assert json.loads(n.first().properties) == {"name": "R"} and e.first().target == "m"


def seed_tables(spark):
    radars = spark.createDataFrame([("R One", "X", "array"), ("R Two", "S", "dish")], "name string, band string, antenna string")
    modes = spark.createDataFrame(
        [("R One", "search", 9.5, 100.0, 25, 0.95, 3000, 8000, "pulse", "sector"), ("R One", "track", 9.6, 60.0, 20, 0.5, 6000, 9000, "pulse", "focused"), ("R Two", "map", 3.0, 10.0, 45, 0.9, 1000, 5000, "chirp", "ground")],
        "radar string, name string, centre_frequency_ghz double, bandwidth_mhz double, detection_range_km int, probability_of_detection double, prf_min_hz int, prf_max_hz int, waveform string, scan_type string",
    )
    aircraft = spark.createDataFrame(
        [("Su", "Su-1/A", "R One", 2.0, 15000, ["X", "Y"], ["t"]), ("Su", "Su-1/B", "R One", 1.5, 14000, ["X"], None), ("Ty", "Ty-9", "R Nine", 0.9, 9000, ["Z"], None)],
        "family string, variant string, radar string, max_speed_mach double, service_ceiling_m int, operators array<string>, tags array<string>",
    )
    return radars, modes, aircraft


def test_graph_out_of_tables(spark):
    nodes, edges = catalogue.generate_graph(*seed_tables(spark))
    by_label = {r.label: r["count"] for r in nodes.groupBy("label").count().collect()}
    assert by_label == {"Radar": 2, "RadarMode": 3, "AircraftFamily": 2, "AircraftVariant": 3, "Operator": 3}
    assert {r.relation: r["count"] for r in edges.groupBy("relation").count().collect()} == {"HAS_MODE": 3, "VARIANT_OF": 3, "USES_RADAR": 3, "OPERATES": 4}
    p = json.loads(nodes.where("id = 'radar_mode:r_one:search'").first().properties)
    assert (p["centre_frequency_min_ghz"], p["centre_frequency_max_ghz"]) == (9.31, 9.69) and (p["bandwidth_min_mhz"], p["bandwidth_max_mhz"]) == (90.0, 110.0)
    assert (p["detection_range_min_km"], p["detection_range_max_km"]) == (19, 31) and p["probability_of_detection_max"] == 1.0 and p["prf_min_hz"] == 3000
    rows = catalogue.candidate_rows(*seed_tables(spark)).collect()
    assert sorted((r.mode_id, r.aircraft_id, r.operator) for r in rows if r.aircraft_id) == sorted((f"radar_mode:r_one:{m}", f"aircraft:su_1_{a}", o) for m in ("search", "track") for a, o in (("a", "X"), ("a", "Y"), ("b", "X")))
    assert [(r.mode_id, r.operator, r.aircraft_uses_radar) for r in rows if not r.aircraft_id] == [("radar_mode:r_two:map", None, False)]


def test_evidence_of_documents(spark, tmp_path):
    radars, modes, aircraft = seed_tables(spark)
    truth = {"mode_id": "radar_mode:r_one:search", "aircraft_id": "aircraft:su_1_a", "radar_id": "radar:r_one", "operator": "Y"}
    near = {
        "timestamp_iso8601": "2024-01-01T00:00:00Z", "approximate_kinematics": {"ground_speed_max_kph": 1000.0, "altitude_max_m": 9000.0}, "ground_truth_label": truth,
        "esm_radar_parameters": {"observed_waveform": "pulse", "observed_scan_type": "sector", "measured_centre_frequency_ghz": {"min": 9.45, "max": 9.55}, "measured_bandwidth_mhz": {"value": 100.0, "error": 5.0}},
    }
    docs = [near | {"observation_id": "o1"}, near | {"observation_id": "o2", "timestamp_iso8601": "2024-01-31T00:00:00Z", "external_context": {"operator_priors": {"Y": 0.9}, "operator": "X"}}, {"observation_id": "o3", "external_context": {"operator": ["Y"]}}]
    (tmp_path / "o.json").write_text(json.dumps({"observations": docs}))
    obs = etl.flat_observations(documents.load_observations(spark, str(tmp_path / "o.json")))
    rows = etl.flat_rows(catalogue.candidate_rows(radars, modes, aircraft)).cache()
    out = etl.ingest(obs, rows, F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), truth=True, keep=lambda df: df.cache())
    best = {(r.observation_id, r.rank): r for r in out["candidates"].collect()}
    first = best["o1", 1]
    assert (first.mode_id, first.aircraft_id, first.operator) == ("radar_mode:r_one:search", "aircraft:su_1_a", "X") and first.mode_score == 1.0 and first.aircraft_score == 1.0
    assert first.text_score == pytest.approx(0.75 + 0.15 + 0.05) and first.missing_feature_count == 5.0 and first.degree_score == 1.0 and first.observation_uncertainty_width == pytest.approx(0.1)
    # A name that the map lacks is held against the single one that is given.
    assert [(best["o2", k].operator, best["o2", k].text_score) for k in (1, 2, 3)] == [("X", 1.0), ("X", 1.0), ("Y", pytest.approx(0.99))] and best["o3", 1].mode_score == 0.0
    assert first.center_frequency_residual == 0.0 and first.prf_residual is None and first.ds_masses == [pytest.approx(0.04), pytest.approx(0.76), 0.2]
    rest = {name: t.collect() for name, t in out.items()}
    assert {n: len(r) for n, r in rest.items()} == {"observations": 3, "candidates": 15, "candidate_edges": 15, "contradiction_edges": len(rest["contradiction_edges"]), "truth_edges": 4, "similarity_edges": 4}
    seen = {r.observation_id: r for r in rest["observations"]}
    assert seen["o1"].recency_score == 0.5 and seen["o2"].recency_score == 1.0 and seen["o3"].recency_score == 0.0 and seen["o1"].mode_id == truth["mode_id"]
    assert all(r.score_delta >= 0.05 and r.reason for r in rest["contradiction_edges"])
    plain = etl.ingest(obs, rows, F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))
    assert plain["truth_edges"].count() == 0 and plain["observations"].where("mode_id is not null or operator is not null").count() == 0


def test_pruned_ranking_equals_all_pairs(spark):
    import random

    rng = random.Random(8)
    bounds = lambda: sorted((round(rng.uniform(0, 50), 3), round(rng.uniform(0, 50), 3)))
    cols = [f"{e}{i}" for i in range(etl.N) for e in ("lo", "hi")]
    obs = [(i, *[x for _ in range(etl.N) for x in (bounds() if rng.random() < 0.8 else (None, None))], rng.choice("ab"), rng.choice(["p", "q", None]), rng.uniform(0, 3000), rng.uniform(0, 20000), {"X": 0.9} if i % 2 else None, None, ["Y"] if i % 3 == 0 else None) for i in range(40)]
    schema = "observation_id int, " + ", ".join(f"{c} double" for c in cols) + ", waveform string, scan string, speed double, height double, priors map<string,double>, more_priors map<string,double>, named array<string>"
    modes = [[x for _ in range(etl.N) for x in (bounds() if rng.random() < 0.9 else (None, None))] + [rng.choice("ab"), rng.choice("pq")] for _ in range(12)]
    rows = []
    for m, props in enumerate(modes):
        for a, o in ((None, None), ("a1", "X"), ("a1", "Y"), ("a2", "Z"))[rng.randrange(2) :]:
            rows.append((f"m{m:02d}", "r", a, o, *props, a is not None, 1000.0 if a == "a1" else 2500.0, 9000.0, 1.0 if a else 0.5, len(rows) + 1))
    kcols = [f"{e}{i}" for i in range(etl.N) for e in ("klo", "khi")]
    kg = spark.createDataFrame(rows, "mode_id string, radar_id string, aircraft_id string, operator string, " + ", ".join(f"{c} double" for c in kcols) + ", mode_waveform string, mode_scan string, has_props boolean, speed_limit double, ceiling double, link double, row int")
    df = spark.createDataFrame(obs, schema)
    got = {(r.observation_id, r.rank): (r.row, r.total_score) for r in etl.topk(df, kg).collect()}
    pairs = df.crossJoin(kg).select("observation_id", "row", etl.S.r6(0.75 * etl.S.mean_known(etl.field_scores()) + 0.15 * etl.carrier_part() + 0.10 * etl.prior_part()).alias("t")).collect()
    want = {}
    for i in range(40):
        top = sorted(((-r.t, r.row) for r in pairs if r.observation_id == i))[:5]
        want |= {(i, k + 1): (row, -t) for k, (t, row) in enumerate(top)}
    assert got == want
