"""Queries over ordered observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credence.functions import scores as S
from credence.operators import candidates as C
from credence.operators import temporal as O
from credence.plans import twins as T
from credence.plans.registry import query
from credence.plans.scoring import best
from credence.sources import views as V

_LEADS = T.SER + """, ld AS (SELECT series_id, observation_id AS a, code, lead(observation_id) OVER w AS b, lead(observation_id, 2) OVER w AS c, lead(code) OVER w AS bcode
  FROM ser WINDOW w AS (PARTITION BY series_id ORDER BY ts, observation_id))"""


@query(f"""WITH {_LEADS} SELECT a AS source, b AS target, 'NEXT_OBSERVATION' AS type FROM ld WHERE b IS NOT NULL UNION ALL SELECT b, a, 'PREV_OBSERVATION' FROM ld WHERE b IS NOT NULL
  UNION ALL SELECT a, c, 'SAME_EMITTER' FROM ld WHERE c IS NOT NULL UNION ALL SELECT c, a, 'SAME_EMITTER' FROM ld WHERE c IS NOT NULL
  UNION ALL SELECT a, b, CASE WHEN code = bcode THEN 'SAME_MODE_SEGMENT' ELSE 'POSSIBLE_MODE_SHIFT' END FROM ld WHERE b IS NOT NULL""")
def temporal_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.temporal_edges(V.observations(spark, sf_dir), "code")


@query(f"""WITH {T.SER}, j AS (SELECT *, CASE WHEN abs(value - lag(value) OVER w) > 75 THEN 1 ELSE 0 END AS jump FROM ser WINDOW w AS (PARTITION BY series_id ORDER BY sequence_index))
  SELECT observation_id, series_id, sequence_index, sum(jump) OVER (PARTITION BY series_id ORDER BY sequence_index) AS segment FROM j""")
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running number of jumps of the value."""
    return O.segments(V.series(spark, sf_dir), "value", 75.0).select("observation_id", "series_id", "sequence_index", "segment")


@query(f"WITH {T.OBS} SELECT series_id, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen FROM obs GROUP BY series_id ORDER BY first_seen, series_id")
def series_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.observations(spark, sf_dir).groupBy("series_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return rows.orderBy("first_seen", "series_id")


@query(f"""WITH {T.SER}, l AS (SELECT *, lag(waveform) OVER (PARTITION BY series_id ORDER BY sequence_index) AS before FROM ser)
  SELECT series_id, count(*) AS shifts, min(sequence_index) AS first_shift, max(sequence_index) AS last_shift, sum(sequence_index) AS index_sum FROM l WHERE before IS NOT NULL AND before <> waveform GROUP BY series_id""")
def mode_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a series changes its mode: how often, first and last, and the sum of the places."""
    return O.shifts(V.series(spark, sf_dir), "waveform").groupBy("series_id").agg(
        F.count("*").alias("shifts"), F.min("sequence_index").alias("first_shift"), F.max("sequence_index").alias("last_shift"), F.sum("sequence_index").alias("index_sum")
    )


@query(f"""WITH {T.SER}, g AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY series_id ORDER BY sequence_index))) AS gap FROM ser)
  SELECT series_id, count(gap) AS gaps, sum((gap NOT BETWEEN 420000 AND 3600000000)::INT) AS outside, max(gap) AS widest FROM g WHERE gap IS NOT NULL GROUP BY series_id""")
def gap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between observations of a series, in microseconds, and those outside of the bounds."""
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(V.in_series()).cast("timestamp"))
    rows = V.observations(spark, sf_dir).withColumn("gap", gap).where("gap is not null")
    return rows.groupBy("series_id").agg(F.count("gap").alias("gaps"), F.sum((~F.col("gap").between(420000, 3600000000)).cast("int")).alias("outside"), F.max("gap").alias("widest"))


@query(f"""WITH {T.SER}, n AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM ser)
  SELECT observation_id, sequence_index, n AS observation_count, round(sequence_index / greatest(n - 1, 1) + 1e-9, 6) AS sequence_fraction FROM n""")
def sequence_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.series(spark, sf_dir).withColumn("n", F.count("*").over(Window.partitionBy("series_id")))
    part = S.r6(F.col("sequence_index") / F.greatest(F.col("n") - 1, F.lit(1)))
    return rows.select("observation_id", "sequence_index", F.col("n").alias("observation_count"), part.alias("sequence_fraction"))


@query(f"""WITH {T.SCORED}, o2 AS (SELECT observation_id, row_number() OVER (PARTITION BY series_id ORDER BY ts, observation_id) - 1 AS sequence_index, series_id FROM obs)
  SELECT series_id, sequence_index, mode_id, total FROM topk JOIN o2 USING (observation_id) WHERE rank = 1 ORDER BY series_id, sequence_index""")
def rank1_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = best(spark, sf_dir).where("rank = 1").select("observation_id", "mode_id", "total")
    return C.dealt(first, V.series(spark, sf_dir), "series_id", "sequence_index").select(
        "series_id", "sequence_index", "mode_id", "total"
    ).orderBy("series_id", "sequence_index")


@query(f"""WITH {T.SCORED}, pr AS (SELECT l.observation_id, l.mode_id AS a, r.mode_id AS b, round(abs(l.total - r.total) + 1e-9, 6) AS d FROM topk l JOIN topk r
  ON l.observation_id = r.observation_id AND l.rank = 1 AND r.rank > 1 AND l.mode_id <> r.mode_id)
  SELECT o.series_id, a AS mode_id, b AS contradicted, count(*) AS n FROM pr JOIN obs o USING (observation_id) WHERE d >= 0.05 GROUP BY ALL""")
def contradiction_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series to best candidate to the candidates that it contradicts, counted."""
    path = C.pairs(best(spark, sf_dir)).where("source_rank = 1 and mode_id <> contradicted").select("observation_id", "mode_id", "contradicted")
    return C.dealt(path, V.observations(spark, sf_dir), "series_id").groupBy("series_id", "mode_id", "contradicted").agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role) AS before FROM conversations)
  SELECT conv_id, count(*) AS turns, sum((before IS NOT NULL AND before <> role)::INT) AS role_changes FROM t GROUP BY conv_id""")
def turn_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second ordered series: turns of a conversation and changes of the speaker."""
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn", "role"))
    rows = V.table(spark, sf_dir, "conversations").withColumn("before", before)
    changed = F.coalesce((F.col("before") != F.col("role")).cast("int"), F.lit(0))
    return rows.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(changed).alias("role_changes"))


@query(f"""WITH {T.OBS}, p AS (SELECT observation_id, (value % 120) - 60 AS lat, (series_id % 360) - 180 AS lon, (value * 7) % 360 AS heading, value * 3 AS kph, coalesce(k, 0) AS s FROM obs),
  q AS (SELECT *, kph * s / 3600 AS km FROM p)
  SELECT observation_id, round(lat + km * cos(radians(heading)) / 111 + 1e-9, 6) AS lat, round(lon + km * sin(radians(heading)) / (111 * greatest(0.1::DOUBLE, cos(radians(lat)))) + 1e-9, 6) AS lon FROM q""")
def dead_reckoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    lat, lon = S.dead_reckoning(v % 120 - 60, (F.col("series_id") % 360) - 180, (v * 7) % 360, v * 3, F.coalesce("k", F.lit(0.0)))
    return V.observations(spark, sf_dir).select("observation_id", S.r6(lat).alias("lat"), S.r6(lon).alias("lon"))


@query("SELECT event_id, user_id, ts, value FROM events")
def strip_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that hold the truth are removed at any depth of a nested record."""
    rows = V.table(spark, sf_dir, "events")
    nested = rows.select(
        F.struct("event_id", "user_id", F.struct("ts", "value", F.col("event_type").alias("ground_truth_label")).alias("seen"), F.col("props").alias("ground_truth_mode")).alias("r")
    )
    clean = O.strip_fields(nested, {"ground_truth_label", "ground_truth_mode"})
    return clean.select("r.event_id", "r.user_id", "r.seen.ts", "r.seen.value")
