"""Rankings by measurement: bounded rows, compiled pairs, observations that share a measurement."""

import re

from pyspark.sql import functions as F

from credence.operators import candidates as C
from credence.plans.catalogue import QUERIES
from credence.sources import views as V

DIR = "/root/testdata/sf0.001"


def test_pairs_are_compiled_and_few_of_them_are_sorted(spark):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name in ("candidate_topk", "candidate_topk_factored"):
            text = QUERIES[name](spark, DIR)._jdf.queryExecution().explainString(mode)
            # The JVM compiles no method of more bytes.
            assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", text))) <= 8000, name
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    obs = C.seen(V.observations(spark, DIR).limit(40))
    places = spark.range(1, 301).select(F.col("id").alias("place"), *[F.lit(1.0 * i).alias(c) for i, c in enumerate(("m0_lo", "m0_hi"))])
    score = F.col("place") / 300
    left = C._within_reach(obs, places, score, score, 5)
    assert left.count() == 40 * 5
    few = C._within_reach(obs, places.where("place <= 3"), score, score, 5)
    assert few.count() == 40 * 3


def test_observations_that_share_a_measurement_are_ranked_once(spark):
    rows = V.candidate_rows(spark, DIR)
    one = V.observations(spark, DIR).limit(6)
    odd = one.limit(1).withColumns({"observation_id": F.lit(9001).cast("long"), "k": F.lit(None).cast("double")})
    # No width, and bounds of the second interval that are no order at all.
    flat = one.limit(1).withColumns({"observation_id": F.lit(9002).cast("long"), "k": F.lit(0.0)})
    obs = one.unionByName(odd).unionByName(flat)
    many = obs.unionByName(obs.withColumn("observation_id", F.col("observation_id") + 10_000)).persist()
    found = C.measurements(many)
    assert found.count() == obs.select(*C.MEASURED).distinct().count()
    pick = lambda df: sorted(map(str, df.select("observation_id", "rank", "total", "mode_id", "carrier_id", "operator").collect()))
    assert pick(C.dealt(C.topk(found, rows), many)) == pick(C.topk(many, rows)) == pick(C.topk_factored(many, V.modes(spark, DIR), rows))
    many.unpersist()


def test_nine_fields_of_pairs_are_compiled(spark):
    from credence.operators import etl
    from credence.plans import ingest

    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    obs, rows = ingest.observations(spark, DIR).limit(60), ingest.rows(spark, DIR).localCheckpoint()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ranked = etl.topk(ingest.observations(spark, DIR), rows)
        assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", ranked._jdf.queryExecution().explainString(mode)))) <= 8000
        # Pairs are bounded by an aggregation: the only window over an observation numbers its rows.
        plan = ranked._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Window \[.*\], \[observation_id", plan)) == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    # Bounds without a width, within and between those of modes, and bounds that are missing.
    flat = obs.withColumns({"observation_id": F.col("observation_id") + 1000, **{f"hi{i}": F.col(f"lo{i}") for i in (0, 3)}, "lo1": F.lit(None).cast("double"), "scan": F.lit(None).cast("long")})
    both = obs.unionByName(flat).localCheckpoint()
    total = etl.S.r6(0.75 * etl.S.mean_known(etl.field_scores()) + 0.15 * etl.carrier_part() + 0.10 * etl.prior_part())
    want = {}
    for r in both.crossJoin(F.broadcast(rows)).select("observation_id", "row", total.alias("t")).collect():
        want.setdefault(r.observation_id, []).append((-r.t, r.row))
    got = {(r.observation_id, r["rank"]): (-r.total_score, r.row) for r in etl.topk(both, rows).collect()}
    assert got == {(i, k + 1): pair for i, pairs in want.items() for k, pair in enumerate(sorted(pairs)[:5])}


def test_counts_take_the_best_row_by_hash_and_neighbours_once(spark):
    from credence.plans import ingest

    tables = ingest.tables(spark, DIR)
    plan = lambda name: tables[name]._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan("similarity_edges") and len(re.findall(r"^.*Union", plan("similarity_edges"), re.M)) == 1
    aggregate = [line for line in tables["observations"]._jdf.queryExecution().sparkPlan().toString().splitlines() if "Aggregate" in line]
    assert aggregate and not any("SortAggregate(key=[observation_id" in line for line in aggregate)
    ahead = {(r.source, r.target) for r in tables["similarity_edges"].collect()}
    assert ahead and ahead == {(b, a) for a, b in ahead}
    spark.catalog.clearCache()
