"""What a task sees of the larger tables."""

from pyspark.sql import functions as F

from credence.operators import splits
from credence.plans.catalogue import QUERIES

DIR = "/root/testdata/sf0.001"


def plan(name, spark):
    return QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString().splitlines()


def test_dense_numbers_are_cut_into_even_ranges_whatever_ids_begin_with(spark):
    ids = spark.range(3000).select(F.concat(F.lit("observation:"), "id").alias("id")).unionByName(spark.createDataFrame([("carrier:a:1",), ("mode:1:1",)], "id string"))
    cut = ids.withColumn("s", splits._slice_of("id", splits._cuts(ids, "id"), ids.schema["id"].dataType))
    sizes = [r["count"] for r in cut.groupBy("s").count().collect()]
    assert max(sizes) <= 64 + 1 and sum(sizes) == 3002
    got = [r.id for r in splits.dense_index(ids, "id").orderBy("index").collect()]
    assert got == sorted(got) and len(got) == 3002
    few = splits.dense_index(ids.limit(3), "id")
    assert sorted(r["index"] for r in few.collect()) == [0, 1, 2]


def test_nine_fields_are_scored_in_as_many_tasks_as_a_shuffle_has(spark):
    assert any("Exchange hashpartitioning(observation_id" in line and "REPARTITION" in line for line in plan("nine_field_scores", spark))


def test_values_are_met_with_intervals_once_and_frames_written_once(spark):
    counted = [line for line in plan("point_in_interval", spark) if "Expand" in line]
    assert counted and not any("observation_id" in line for line in counted)
    written = [line for line in plan("frequency_frames", spark) if "array_join" in line]
    assert written and not any("series_id" in line for line in written)


def test_claims_meet_their_reports_once_for_both_links(spark):
    assert len([line for line in plan("contains_support_edges", spark) if "FileScan" in line]) == 2
