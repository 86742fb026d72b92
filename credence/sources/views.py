"""The reference concepts as views over the driver's tables.

| concept | view |
| observation, series | `events`: a measured value with 8 % error, a second one from `props` |
| radar, its modes | `nation`: five template modes for each radar, 25 x 5 rows at any scale |
| carrier (aircraft) | `customer` by nation and market segment, where the largest balance reaches 9,000: 125 rows at most |
| operator | `region` of the nation; a second one for even nations: two for each carrier at most |
| report, claim | `orders`, `lineitem` |
| masses, features, classes | `embeddings` |

Radars, modes, carriers and operators are bounded by nations x templates x segments whatever the scale, so
they may be broadcast. All tables are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credence.functions import scores as S
from credence.functions.scores import numeric_range, r6, slug

#: Mode templates: index, name, factor on the base frequency, relative half width.
TEMPLATES = ((1, "search", 0.6, 0.10), (2, "track", 0.9, 0.05), (3, "scan", 1.2, 0.15), (4, "map", 1.6, 0.08), (5, "guide", 2.0, 0.04))
#: Fixed value: days in which a report loses half its weight.
REPORT_HALF_LIFE_DAYS = 14.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")



def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured events; no window, so nothing is shuffled."""
    error = F.greatest(F.abs(F.col("value")) * 0.08, F.lit(1e-9))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("observation_id"),
        F.col("user_id").alias("series_id"),
        "ts",
        F.col("event_type").alias("waveform"),
        (F.length("event_type") % 3).alias("code"),
        "value",
        error.alias("error"),
        (F.col("value") - error).alias("lo"),
        (F.col("value") + error).alias("hi"),
        F.regexp_extract("props", r'"k": *(-?[0-9]+)', 1).try_cast("double").alias("k"),
    )


def in_series() -> Window:
    return Window.partitionBy("series_id").orderBy("ts", "observation_id")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with their place in the series."""
    return observations(spark, sf_dir).withColumn("sequence_index", (F.row_number().over(in_series()) - 1).cast("long"))


def modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five modes for each radar, made from templates, with intervals that no two modes share."""
    radar = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    template = F.explode(
        F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("name"), F.lit(f).alias("f"), F.lit(w).alias("w")) for i, n, f, w in TEMPLATES])
    )
    out = radar.withColumn("t", template)
    key, i = F.col("n_nationkey"), F.col("t.i")
    center = (20 + 9 * key) * F.col("t.f") + 0.37 * (key + 1) + 0.11 * i
    lo, hi = numeric_range(center, 1.0)
    k = 4 * key + 3 * i
    return out.select(
        F.concat(F.lit("mode:"), key, F.lit(":"), i).alias("mode_id"),
        F.concat(F.lit("radar:"), key).alias("radar_id"),
        key.alias("nation"),
        F.col("t.name").alias("mode_name"),
        i.alias("mode_index"),
        r6(center).alias("center"),
        r6(center * (1 - F.col("t.w"))).alias("klo"),
        r6(center * (1 + F.col("t.w"))).alias("khi"),
        r6(k * 0.8).alias("k_klo"),
        r6(k * 1.2).alias("k_khi"),
        ((key + i) % 3).alias("mode_code"),
    )


def carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(
        F.max("c_acctbal").alias("speed_limit"), F.min("c_acctbal").alias("ceiling")
    )
    return grouped.where("speed_limit >= 9000").select(
        F.concat(F.lit("carrier:"), slug(F.col("c_mktsegment")), F.lit(":"), "c_nationkey").alias("carrier_id"),
        F.concat(F.lit("radar:"), "c_nationkey").alias("radar_id"),
        F.col("c_nationkey").alias("nation"),
        F.col("c_mktsegment").alias("variant"),
        "speed_limit",
        "ceiling",
    )


def operates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(operator, carrier_id, nation): the region of the carrier's nation, for even nations the next one too."""
    region = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("operator"))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    links = nation.withColumn(
        "r_regionkey",
        F.explode(F.when(F.col("n_nationkey") % 2 == 0, F.array("n_regionkey", (F.col("n_regionkey") + 1) % 5)).otherwise(F.array("n_regionkey"))),
    ).join(F.broadcast(region), "r_regionkey")
    own = carriers(spark, sf_dir).select("carrier_id", F.col("nation").alias("n_nationkey"))
    return own.join(F.broadcast(links), "n_nationkey").select("operator", "carrier_id", F.col("n_nationkey").alias("nation"))


def candidate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modes with their radars' carriers and those carriers' operators, where there are any."""
    own = carriers(spark, sf_dir).drop("nation")
    ops = operates(spark, sf_dir).select("operator", "carrier_id")
    return (
        modes(spark, sf_dir)
        .join(own, "radar_id", "left")
        .join(ops, "carrier_id", "left")
        .withColumn("uses_radar", F.col("carrier_id").isNotNull())
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as claims of the report that is their order: it was collected on its date, every ninth has a date of publication alone, every 45th none."""
    item = table(spark, sf_dir, "lineitem")
    report = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    return item.join(report, item.l_orderkey == report.o_orderkey).select(
        F.col("l_orderkey").alias("report_id"),
        F.col("l_linenumber").alias("claim_no"),
        F.col("l_returnflag").alias("claim_type"),
        F.col("l_suppkey").alias("object_id"),
        F.when(F.col("l_linestatus") == "F", "refutes").otherwise("supports").alias("stance"),
        (1 - F.col("l_discount") * 5).alias("confidence"),
        (1 - F.col("l_tax") * 5).alias("extraction"),
        (F.col("o_totalprice") / 500000).alias("credibility"),
        (F.col("l_quantity") / 50).alias("specificity"),
        S.first_time(F.when(F.col("l_orderkey") % 9 != 0, F.col("o_orderdate")), F.when(F.col("l_orderkey") % 45 != 0, F.col("o_orderdate") + F.expr("INTERVAL 3 DAYS"))).alias("observed_at"),
        F.col("l_shipdate").alias("reference_time"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("node_id"), F.col("embedding").cast("array<double>").alias("x"), "label"
    )


def raw_masses(n: int) -> Column:
    """The first n entries of a vector as evidence: their absolute values, to six decimals."""
    return F.transform(F.slice("x", 1, n), lambda v: r6(F.abs(v)))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three relations over the vectors: to the next, to the one after it, and back; ends that are no node are dropped."""
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("src"))
    steps = F.array(*[F.struct(F.lit(r).alias("rel"), F.lit(s).alias("step")) for r, s in ((0, 1), (1, 2), (2, -1))])
    out = ids.withColumn("e", F.explode(steps)).select("src", (F.col("src") + F.col("e.step")).alias("dst"), F.col("e.rel").alias("rel"))
    return out.join(ids.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst", "rel")
