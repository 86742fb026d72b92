"""Plans, graphs, generators, readers and streams."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from credence.operators import candidates, etl, generate, gnn, splits, tables, temporal
from credence.operators import graph as G
from credence.operators import ranges as R
from credence.plans import learning, series
from credence.plans.catalogue import QUERIES
from credence.sources import artifacts
from credence.sources import documents as D
from credence.sources import views as V
from credence.streaming import segments as stream

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_stay_in_the_engine(spark):
    for name, f in QUERIES.items():
        if name == "gnn_predict" or name.startswith(("training_", "evidence_pred", "series_pred")):  # exact GELU and fits in Python
            continue
        text = plan(f(spark, DIR))
        assert "Python" not in text and "InArrow" not in text and "InPandas" not in text and "CartesianProduct" not in text, name


def test_ranking_is_pushed_and_the_small_side_broadcast(spark):
    text = plan(QUERIES["candidate_topk_factored"](spark, DIR))
    assert "WindowGroupLimit" in text and "BroadcastNestedLoopJoin BuildRight" in text
    assert "ReadSchema: struct<event_id" in text


def test_both_rankings_agree_and_truth_plays_no_part(spark):
    obs, rows = V.observations(spark, DIR).limit(40), V.candidate_rows(spark, DIR)
    pick = lambda df: sorted(map(str, df.select("observation_id", "rank", "total", "mode_id", "carrier_id", "operator").collect()))
    a = pick(candidates.topk(obs, rows))
    assert a == pick(candidates.topk_factored(obs, V.modes(spark, DIR), rows))
    assert a == pick(candidates.topk(obs.withColumn("ground_truth_label", F.lit("x")), rows))


def test_point_in_interval_takes_both_ends(spark):
    points = spark.createDataFrame([(1, 0.0), (2, 10.0), (3, 10.1), (4, None), (5, -7.0)], "id int, v double")
    spans = spark.createDataFrame([("a", 0.0, 10.0), ("b", -20.0, 35.0), ("c", 5.0, 1.0)], "n string, lo double, hi double")
    got = {(r.id, r.n) for r in R.point_in_interval(points, spans, "v", "lo", "hi", 4.0).collect()}
    assert got == {(1, "a"), (2, "a"), (1, "b"), (2, "b"), (3, "b"), (5, "b")}


def test_contradictions(spark):
    best = spark.createDataFrame(
        [(1, 1, 0.9, "m", "r", "c", "o"), (1, 2, 0.86, "m", "r", "c", "p"), (1, 3, 0.8, "n", "q", None, None), (2, 1, 0.5, "m", "r", None, None), (2, 2, 0.4, "m", "r", None, None)],
        "observation_id long, rank int, total double, mode_id string, radar_id string, carrier_id string, operator string",
    )
    got = {(r.source_rank, r.target_rank, r.score_delta, r.reason) for r in candidates.contradictions(best).collect()}
    assert got == {(1, 3, 0.1, "mode_id,radar_id,carrier_id,operator"), (2, 3, 0.06, "mode_id,radar_id,carrier_id,operator")}


def test_tables(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", None)], "id int, n string, v int")
    new = spark.createDataFrame([(2, 5, True), (3, 6, False)], "id int, v int, w boolean")
    got = sorted(map(tuple, tables.upsert(base, new, "id").collect()), key=str)
    assert got == [(1, "a", 1, None), (2, "b", 5, True), (3, None, 6, False)]
    gone = spark.createDataFrame([(1, None)], "id int, v int")
    assert sorted(map(tuple, tables.upsert(base, gone, "id").collect()), key=str) == [(1, "a", None), (2, "b", None)]
    rows = spark.createDataFrame([(1, 2, "x"), (1, 1, "y")], "id int, o int, n string")
    assert [tuple(r) for r in tables.first_wins(rows, "id", "o").collect()] == [(1, 1, "y")]


def test_layers_equal_numpy(spark):
    rng = np.random.default_rng(0)
    n, width = 7, 3
    x = rng.normal(size=(n, 4))
    edges = [(0, 1, 0), (2, 1, 1), (3, 1, 0), (4, 5, 2), (6, 5, 0), (1, 0, 2)]
    w, own, gates, bias = rng.normal(size=(3, 4, width)), rng.normal(size=(4, width)), [1.0, 0.5, 0.2], [0.1, 0.2, 0.3]
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node_id long, x array<double>")
    links = spark.createDataFrame(edges, "src long, dst long, rel int")
    want = x @ own + bias
    for d in range(n):
        inbound = [gates[r] * x[s] @ w[r] for s, t, r in edges if t == d]
        want[d] += sum(inbound) / max(1, len(inbound)) if inbound else 0
    out = G.relational_layer(nodes, links, w.tolist(), own.tolist(), gates, bias)
    assert np.allclose(np.array([r.x for r in out.orderBy("node_id").collect()]), want)
    block = gnn.block(nodes, links, w.tolist(), own.tolist(), gates, bias).orderBy("node_id").collect()
    assert np.allclose(np.array([r.x for r in block]), gnn.layer_norm(gnn.gelu(want)))
    mean = gnn.mean_block(nodes, links, np.eye(4).tolist(), np.eye(4).tolist(), 2).orderBy("node_id").collect()
    agg = np.zeros((n, 4))
    for d in range(n):
        near = [x[s] for s, _, _ in sorted([e for e in edges if e[1] == d], key=lambda e: (e[2], e[0]))[:2]]
        agg[d] = np.mean(near, axis=0) if near else 0
    assert np.allclose(np.array([r.x for r in mean]), gnn.layer_norm(x + gnn.gelu(x + agg)))
    q = rng.normal(size=(3, 4, width))
    gated = {r.dst: r.m for r in G.gated_mean(nodes, links, *q.tolist(), [1.0, 0.7, 1.3]).collect()}
    for d in {e[1] for e in edges}:
        m = [1 / (1 + np.exp(-(x[d] @ q[0]) @ (x[s] @ q[1]) * [1.0, 0.7, 1.3][r] / width**0.5)) * (x[s] @ q[2]) for s, t, r in edges if t == d]
        assert np.allclose(gated[d], np.mean(m, axis=0))


def test_splits_do_not_leak(spark):
    split = learning.splits(spark, DIR)
    assert {r.split for r in split.select("split").distinct().collect()} == {"train", "test", "val"}
    groups = QUERIES["group_split"](spark, DIR).groupBy("user_id").agg(F.countDistinct("split").alias("n"))
    assert groups.where("n > 1").count() == 0
    kept = G.filter_edges(V.edges(spark, DIR), split, [0, 1])
    assert [r.new_rel for r in kept.select("new_rel").distinct().collect()] == [0]


def test_strip_and_flatten(spark):
    rows = spark.sql("select named_struct('a', 1, 'secret', 2, 'l', array(named_struct('secret', 'x', 'b', 2.5))) as r, true as f")
    clean = temporal.strip_fields(rows, {"secret"})
    assert "secret" not in clean.schema.simpleString() and clean.first().r.l[0].b == rows.first().r.l[0].b
    assert temporal.flatten_numeric(clean).columns == ["r.a"]


def test_generated_rows(spark):
    own = learning.carriers(spark, DIR)
    a = generate.observations(spark, own, 300, seed=7).cache()
    assert a.count() == 300
    for name, *_ in etl.MEASURES:
        assert a.where(f"esm_radar_parameters.{name}.min > esm_radar_parameters.{name}.value").count() == 0
    again = generate.observations(spark, own, 300, seed=7).repartition(5)
    assert a.exceptAll(again).count() == 0 and generate.observations(spark, own, 300, seed=8).exceptAll(a).count() > 0
    near = a.select("ground_truth_label.aircraft_id", F.col("candidate_labels_from_shared_kg_features").alias("c"))
    assert near.where("size(c) < 1 or size(c) > 10 or exists(c, x -> x.operator is null)").count() == 0
    s = generate.series(spark, own, 30, seed=1, most=2).cache()
    w = s.groupBy("series_id").agg(F.min("sequence_index").alias("a"), F.count("*").alias("n"), F.max("sequence_index").alias("b"))
    assert w.where("a <> 0 or b <> n - 1 or n < 2").count() == 0 and w.count() == 30
    shifted = temporal.shifts(s.withColumn("mode_id", F.col("ground_truth_label.mode_id")), "mode_id")
    assert shifted.groupBy("series_id").count().where("count > 2").count() == 0
    assert s.exceptAll(generate.series(spark, own, 30, seed=1, most=2, workers=3)).count() == 0
    r = generate.reports(a, own, seed=3).cache()
    assert r.groupBy("observation_id").count().where("count not between 10 and 12").count() == 0
    claims = r.select("observation_id", F.explode("claims").alias("c")).select("observation_id", "c.*").join(a.select("observation_id", "ground_truth_label"), "observation_id").cache()
    share = claims.agg(F.avg((F.col("synthetic_truth_value") == "correct").cast("double"))).first()[0]
    assert 0.5 < share < 0.7 and claims.select("claim_type").distinct().count() == 7
    wrong = claims.where("synthetic_truth_value <> 'correct'")
    known = {c.aircraft_id for c in own.collect()}
    for kind, field in (("operator", "operator"), ("aircraft_variant", "aircraft_id"), ("radar_type", "radar_id"), ("radar_mode", "mode_id")):
        rows = wrong.where(F.col("claim_type") == kind).select("object_id", f"ground_truth_label.{field}").collect()
        assert rows and all(x.object_id and x.object_id != x[field] for x in rows)
        assert kind != "aircraft_variant" or {x.object_id for x in rows} <= known
    for bad in (
        lambda: generate.observations(spark, own, 0, 1), lambda: generate.series(spark, own, 0, 1), lambda: generate.series(spark, own, 1, 1, min_s=0.1), lambda: generate.series(spark, own, 1, 1, end=generate.START + 3),
        lambda: generate.series(spark, own, 1, 1, workers=0), lambda: generate.series(spark, own, 1, 1, most=-1), lambda: generate.reports(a, own, 1, 5, 4), lambda: generate.budgets(a, 1, 3, 2),
        lambda: generate.with_reports(a, own, 1, series_bounds=(1, None)),
    ):
        with pytest.raises(ValueError):
            bad()


def test_report_budgets_of_series(spark):
    own = learning.carriers(spark, DIR)
    found = generate.observations(spark, own, 40, seed=5).withColumn("n", F.substring("observation_id", -2, 2).cast("int"))
    found = found.withColumn("series_id", F.concat(F.lit("s"), (F.col("n") % 4).cast("string"))).withColumn("sequence_index", F.col("n"))
    rows = generate.with_reports(found, own, 9, series_bounds=(6, 8)).select("series_id", "observation_id", F.size("intelligence_reports").alias("k"), "intelligence_reports").collect()
    assert len(rows) == 40
    totals = {}
    for r in rows:
        totals[r.series_id] = totals.get(r.series_id, 0) + r.k
        assert [x.report_id for x in r.intelligence_reports] == [f"intel_report:{r.observation_id}:{i + 1:02d}" for i in range(r.k)]
    assert len(totals) == 4 and all(6 <= n <= 8 for n in totals.values())
    none = generate.with_reports(found, own, 9, series_bounds=(0, 0))
    assert none.where("size(intelligence_reports) <> 0").count() == 0


def test_documents(spark, tmp_path):
    obs = {"observation_id": "o1", "external_context": {"operator_priors": {"x": 0.5}, "operator": ["a", "b"]}, "intelligence_reports": [{"report_id": "r1", "claims": [{"claim_id": "c"}]}]}
    (tmp_path / "flat.json").write_text(json.dumps({"observations": [obs, {"observation_id": "o2", "series_id": "s9"}]}))
    (tmp_path / "series.json").write_text(json.dumps({"observation_series": [{"series_id": "s1", "observations": [obs, {"observation_id": "o3", "series_id": "own"}]}]}, indent=1))
    both = {r.observation_id + str(r.series_id) for r in D.load_observations(spark, str(tmp_path)).collect()}
    assert both == {"o1None", "o2s9", "o1s1", "o3own"}
    assert [r.report_id for r in D.load_reports(spark, str(tmp_path / "series.json")).collect()] == ["r1"]
    assert D.load_series(spark, str(tmp_path / "series.json")).first().series_id == "s1"
    (tmp_path / "bad.json").write_text('{\n "observation_series": [\n  {"series_id" "x"}\n ]\n}')
    with pytest.raises(D.DocumentError, match=r"line 3, column 16[\s\S]*\^[\s\S]*hint"):
        D.load_series(spark, str(tmp_path / "bad.json"))
    with pytest.raises(D.DocumentError, match="list under"):
        D.load_series(spark, str(tmp_path / "flat.json"))
    many = tmp_path / "many"
    many.mkdir()
    for i in range(30):
        (many / f"{i:02d}.json").write_text(json.dumps({"observation_series": [{"series_id": f"s{i}", "observations": []}]}))
    assert D.load_series(spark, str(many)).count() == 30
    (many / "27.json").write_text('{"observation_series": [}')
    with pytest.raises(D.DocumentError, match=r"27\.json: invalid JSON at line 1"):
        D.load_series(spark, str(many))
    triples = spark.createDataFrame([("a", "R", "b"), ("c", "S", "d,e")], "source string, relation string, target string")
    D.write_triples(triples, str(tmp_path / "t"))
    assert sorted(map(tuple, D.read_triples(spark, str(tmp_path / "t")).collect())) == sorted(map(tuple, triples.collect()))
    D.write_json(triples, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).columns == ["relation", "source", "target"]


def test_stream_equals_batch(spark, tmp_path):
    obs = V.observations(spark, DIR).select("observation_id", "series_id", "ts", "value", "waveform")
    obs.repartition(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(obs.schema).parquet(str(tmp_path / "in"))
    q = stream.running_segments(live, 75.0).writeStream.format("memory").queryName("running").outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r.observation_id, r.segment) for r in spark.table("running").collect()}
    want = {(r.observation_id, r.segment) for r in series.segments(spark, DIR).collect()}
    assert got == want
    assert stream.windowed_counts(live).isStreaming


def test_prediction_beats_chance(spark):
    rows = QUERIES["gnn_predict"](spark, DIR)
    assert rows.where("confidence < 0 or confidence > 1.0000001").count() == 0 and rows.count() == 500


def test_places_equal_one_window_with_nulls_and_ties(spark):
    from pyspark.sql import Window

    rows = spark.createDataFrame(
        [(k, ["a", "b", None][(k // 7) % 3] if k % 5 else "a", (k * 37) % 50 - 10 if k % 11 else None) for k in range(300)] + [(7, "a", 3)] * 2, "id long, g string, x long"
    )
    order = Window.partitionBy("g").orderBy(F.asc_nulls_first("x"), "id")
    plain = rows.select("id", "g", "x", F.row_number().over(order).alias("p"), F.count("*").over(Window.partitionBy("g")).alias("n"))
    for width in (1, 7, 1000):
        got = G.places(rows, "g", F.col("x"), [F.col("id")], width).select("id", "g", "x", "__p", "__n")
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, plain.collect())))
    assert G.places(rows.limit(0), "g", F.col("x"), [F.col("id")], 7).count() == 0


def test_series_documents_load_again(spark, tmp_path):
    """Tracks with reports, written as documents, read back by every loader and scored by the ETL."""
    own = learning.carriers(spark, DIR)
    found = generate.series(spark, own, 5, seed=3, max_s=4.0, switch=0.2).cache()
    told = generate.with_reports(found, own, 11, series_bounds=(4, 6)).cache()
    documents = generate.series_documents(told).cache()
    artifacts.write_series(documents, str(tmp_path / "series"), {"seed": 3})
    series = D.load_series(spark, str(tmp_path / "series"))
    assert sorted(r.series_id for r in series.collect()) == sorted(r.series_id for r in documents.collect()) and series.count() == 5
    back = D.load_observations(spark, str(tmp_path / "series")).cache()
    assert back.count() == found.count()
    cols = ["observation_id", "series_id", "sequence_index", "elapsed_time_s", "timestamp_unix", "estimated_emitter_location", "approximate_kinematics", "esm_radar_parameters", "ground_truth_label"]
    assert back.select(cols).exceptAll(found.select(cols)).count() == 0
    reports = D.load_reports(spark, str(tmp_path / "series"))
    assert reports.count() == told.select(F.sum(F.size("intelligence_reports"))).first()[0] >= 20
    assert etl.flat_observations(back).where("lo0 is null or hi6 is null or truth.mode_id is null").count() == 0
    artifacts.write_observations(generate.observations(spark, own, 25, seed=2), str(tmp_path / "flat"), {"count": 25})
    assert D.load_observations(spark, str(tmp_path / "flat")).count() == 25
    text = json.loads(next((tmp_path / "flat").glob("part-*")).read_text())
    assert text["metadata"] == {"count": 25} and "ground_truth_label" in text["observations"][0]
    row = documents.where("size(mode_shift_sequence_indices) > 0").first()
    modes = [m.mode_id for m in row.ground_truth_mode_sequence]
    assert row.mode_shift_sequence_indices == [i for i in range(1, len(modes)) if modes[i] != modes[i - 1]] and row.ground_truth_track_label.mode == "multiple"
    with pytest.raises(ValueError):
        D.write_documents(found, str(tmp_path / "x"), "observations", chunk=0)


def test_allotment_equals_dealing_one_by_one():
    rng = random.Random(2)
    for _ in range(60):
        shares = rng.choice([{"train": 0.5, "test": 0.3, "val": 0.2}, {"train": 0.7, "test": 0.15, "val": 0.15}, {"a": 0.25, "b": 0.75}])
        strata = sorted((rng.randint(1, 30) for _ in range(rng.randint(1, 12))), reverse=True)
        wanted, given = {s: f * sum(strata) for s, f in shares.items()}, dict.fromkeys(shares, 0)
        want = []
        for n in strata:
            own = dict.fromkeys(shares, 0)
            for _ in range(n):
                best = max(shares, key=lambda s: (shares[s] * n - own[s], wanted[s] - given[s]))
                own[best] += 1
                given[best] += 1
            want.append(own)
        assert splits.allot(strata, shares) == want
    with pytest.raises(ValueError):
        splits.allot([3], {"a": 0.5})


def test_groups_stay_whole_and_strata_single(spark):
    rows = spark.createDataFrame([(i, i % 40, (i % 40) % 3, "x") for i in range(400)], "row long, g long, s int, t string")
    got = splits.quota_split(rows, "g", ["s", "t"], {"train": 0.5, "test": 0.3, "val": 0.2}, lambda c: c * 7 % 11, 3).cache()
    assert got.count() == 400 and got.groupBy("g").agg(F.countDistinct("split").alias("n")).where("n <> 1").count() == 0
    counts = {r.split: r["count"] for r in got.select("g", "split").distinct().groupBy("split").count().collect()}
    dealt = splits.allot([14, 13, 13], {"train": 0.5, "test": 0.3, "val": 0.2})
    assert counts == {name: sum(own[name] for own in dealt) for name in dealt[0]}
    with pytest.raises(Exception, match="two strata"):
        splits.quota_split(rows.withColumn("s", F.col("row") % 3), "g", ["s"], {"a": 1.0}, lambda c: c, 3).collect()


@pytest.mark.parametrize("slices", [256, 5])
def test_dense_numbers_equal_one_window(spark, monkeypatch, slices):
    monkeypatch.setattr(splits, "SLICES", slices)
    rng = random.Random(slices)
    for ids in ([f"node:{'ab' * (i % 3)}:{rng.randrange(10**6)}" for i in range(500)], [rng.randrange(-(10**9), 10**9) for _ in range(300)], ["same"], []):
        ids = sorted(set(ids), key=lambda x: x.encode() if isinstance(x, str) else x)
        kind = "string" if not ids or isinstance(ids[0], str) else "long"
        df = spark.createDataFrame([(x, 1) for x in [*ids, None]], f"id {kind}, other int").repartition(4)
        got = sorted((r["index"], r.id) for r in splits.dense_index(df, "id").collect())
        assert got == list(enumerate(ids))


def test_dangling_edges_go(spark):
    nodes = splits.dense_index(spark.createDataFrame([("b",), ("a",), ("c",)], "id string"), "id")
    edges = spark.createDataFrame([("a", "X", "b"), ("a", "Y", "gone"), ("gone", "W", "a"), ("c", "Y", "a"), (None, "X", "a")], "source string, relation string, target string")
    assert sorted(map(tuple, splits.resolve(edges, nodes).collect())) == [(0, 1, 1), (2, 0, 2)]


def test_features_of_mixed_nodes(spark):
    one = spark.createDataFrame([("a", '{"x": 1, "y": "2.5", "z": "no"}'), ("b", None)], "id string, p string").select("id", splits.numeric_properties(F.col("p")).alias("properties"))
    two = spark.createDataFrame([("c", '{"w": 3}'), ("d", "{}")], "id string, p string").select("id", splits.numeric_properties(F.col("p")).alias("properties"))
    names = splits.feature_names([one, two])
    assert names == ["w", "x", "y"]
    assert {r.id: r.x for r in splits.feature_matrix([one, two], names).collect()} == {"a": [0.0, 1.0, 2.5], "b": [0.0] * 3, "c": [3.0, 0.0, 0.0], "d": [0.0] * 3}
