"""Queries that score nine fields of observations and give the tables of evidence.

Of an event seven measurements are made by rule: measurement i has the center value * (i + 1) + 7 i and an
error of 2 (i + 1) percent; the third is missing for every seventh event, the sixth where props hold no number,
and the scan type for every eleventh. A mode's bounds follow its center likewise; the kind "guide" lacks the
fourth. Carriers and operators are those of the other views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credence.functions import scores as S
from credence.operators import etl
from credence.operators import ranges as R
from credence.plans import twins as T
from credence.plans.registry import query
from credence.sources import views as V

NOW = "2024-06-01 00:00:00"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = V.observations(spark, sf_dir)
    cols = []
    for i in range(etl.N):
        center = F.col("value") * (i + 1) + 7.0 * i
        there = {2: F.col("observation_id") % 7 != 0, 5: F.col("k").isNotNull()}.get(i, F.lit(True))
        error = F.abs(center) * (0.02 * (i + 1)) + 0.01
        cols += [F.when(there, S.r6(center - error)).alias(f"lo{i}"), F.when(there, S.r6(center + error)).alias(f"hi{i}")]
    none = F.lit(None).cast("map<string,double>")
    named = F.struct(
        F.concat(F.lit("mode:"), F.col("series_id") % 25, F.lit(":"), F.col("code") + 1).alias("mode_id"), F.lit(None).cast("string").alias("radar_id"),
        F.lit(None).cast("string").alias("aircraft_id"), F.lit(None).cast("string").alias("operator"),
    )
    rows = obs.select(
        "observation_id", "series_id", F.col("ts"), F.lit(None).cast("int").alias("sequence_index"), F.lit(None).cast("double").alias("elapsed_time_s"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp_iso8601"), *cols, F.col("code").alias("waveform"),
        F.when(F.col("observation_id") % 11 != 0, F.col("observation_id") % 4).alias("scan"), (F.col("value") * 20).alias("speed"), (F.col("value") * 100).alias("height"),
        F.when(F.col("code") == 0, F.create_map(F.lit("EUROPE"), F.lit(0.9))).otherwise(none).alias("priors"),
        F.when(F.col("code") == 1, F.create_map(F.lit("ASIA"), F.lit(0.8))).otherwise(none).alias("more_priors"),
        F.when(F.col("code") == 2, F.array(F.lit("AFRICA"))).alias("named"), named.alias("truth"),
    )
    width = [F.coalesce(F.col(f"hi{i}") - F.col(f"lo{i}"), F.lit(0.0)) for i in range(etl.N)]
    return rows.withColumn("width", S.r6(sum(width[1:], width[0])))


def mode_bounds(modes: DataFrame) -> DataFrame:
    """Modes with the bounds of seven measurements and two categories."""
    cols = []
    for i in range(etl.N):
        there = F.col("mode_name") != "guide" if i == 3 else F.lit(True)
        cols += [F.when(there, S.r6(F.col("klo") * (i + 1))).alias(f"klo{i}"), F.when(there, S.r6(F.col("khi") * (i + 1) + i)).alias(f"khi{i}")]
    return modes.select("mode_id", "radar_id", "nation", *cols, F.col("mode_code").alias("mode_waveform"), ((F.col("nation") + F.col("mode_index")) % 4).cast("long").alias("mode_scan"))


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kg = V.candidate_rows(spark, sf_dir).select("mode_id", F.col("carrier_id").alias("aircraft_id"), "operator", "uses_radar", "speed_limit", "ceiling")
    order = Window.orderBy("mode_id", F.coalesce("aircraft_id", F.lit("")), F.coalesce("operator", F.lit("")))
    return mode_bounds(V.modes(spark, sf_dir)).drop("nation").join(kg, "mode_id").select(
        "*", F.col("uses_radar").alias("has_props"), F.when(F.col("uses_radar"), 1.0).otherwise(0.5).alias("link"), F.row_number().over(order).alias("row")
    ).drop("uses_radar").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("speed_limit", "ceiling")})


def _bound(i: int, sign: str) -> str:
    there = {2: "observation_id % 7 <> 0", 5: "k IS NOT NULL"}.get(i, "true")
    center = f"(value * {i + 1} + {7.0 * i}::DOUBLE)"
    return f"CASE WHEN {there} THEN {T.r6(f'{center} {sign} (abs({center}) * ({0.02 * (i + 1)!r}::DOUBLE) + 0.01::DOUBLE)')} END"


_OBS9 = T.OBS + ", obs9 AS (SELECT *, " + ", ".join(f"{_bound(i, '-')} AS lo{i}, {_bound(i, '+')} AS hi{i}" for i in range(etl.N)) + """,
  CASE WHEN observation_id % 11 <> 0 THEN observation_id % 4 END AS scan FROM obs)"""
_NOT_GUIDE = lambda i: "mode_name <> 'guide'" if i == 3 else "true"
_MODES9 = "modes9 AS (SELECT *, " + ", ".join(
    f"CASE WHEN {_NOT_GUIDE(i)} THEN {T.r6(f'klo * {i + 1}')} END AS klo{i}, CASE WHEN {_NOT_GUIDE(i)} THEN {T.r6(f'khi * {i + 1} + {i}')} END AS khi{i}" for i in range(etl.N)
) + ", (nation + mode_index) % 4 AS mode_scan FROM modes)"
_FIELDS = ", ".join(f"{T.overlap(f'o.lo{i}', f'o.hi{i}', f'm.klo{i}', f'm.khi{i}')} AS s{i}" for i in range(etl.N)) + (
    ", CASE WHEN o.code = m.mode_code THEN 1.0 ELSE 0.0 END::DOUBLE AS s7, CASE WHEN o.scan IS NULL THEN NULL WHEN o.scan = m.mode_scan THEN 1.0 ELSE 0.0 END::DOUBLE AS s8"
)
_KNOWN = " + ".join(f"(s{i} IS NOT NULL)::INT" for i in range(9))
_MEAN = "(" + " + ".join(f"coalesce(s{i}, 0)" for i in range(9)) + f") / ({_KNOWN})"
_RES = ", ".join(
    f"round(abs((o.lo{i} + o.hi{i}) / 2 - (m.klo{i} + m.khi{i}) / 2) / greatest(m.khi{i} - m.klo{i}, abs((m.klo{i} + m.khi{i}) / 2), 1.0) + 1e-9, 6) AS {name}" for i, (*_, name) in enumerate(etl.MEASURES)
)
_MATCHED = " + ".join(f"coalesce((s{i} >= 0.5)::INT, 0)" for i in range(9))


@query(f"""WITH {_OBS9}, {T.MODES}, {_MODES9}, f AS (SELECT o.observation_id, m.mode_id, {_FIELDS}, {_RES}, (o.code = m.mode_code)::INT::DOUBLE AS waveform_match_score,
  (o.scan IS NOT DISTINCT FROM m.mode_scan)::INT::DOUBLE AS scan_type_match_score FROM obs9 o JOIN modes9 m ON m.nation = o.series_id % 25)
  SELECT observation_id, mode_id, {", ".join(name for *_, name in etl.MEASURES)}, round({_MEAN} + 1e-9, 6) AS radar_interval_overlap_score, waveform_match_score, scan_type_match_score,
  (9 - ({_KNOWN}))::DOUBLE AS missing_feature_count, {_MATCHED} AS matched, {_KNOWN} AS compared FROM f""")
def nine_field_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of every observation against the modes of the radar that its series is dealt to."""
    # Scores are the work here, so one input file must not mean one task.
    obs = etl.spread(observations(spark, sf_dir), "observation_id").withColumn("nation", (F.col("series_id") % 25).cast("int"))
    met = obs.join(F.broadcast(mode_bounds(V.modes(spark, sf_dir))), "nation")
    return etl.with_fields(met).select("observation_id", "mode_id", *etl.feature_columns())


_BEST = f"""{_OBS9}, {T.KG}, {_MODES9}, f AS (SELECT o.observation_id, m.mode_id, o.value, o.code, {_FIELDS} FROM obs9 o, modes9 m),
  ms AS (SELECT observation_id, mode_id, value, code, {_MEAN} AS raw FROM f),
  c AS (SELECT t.*, g.radar_id, g.carrier_id AS aircraft_id, g.operator,
    CASE WHEN NOT uses_radar THEN 0.5 WHEN speed_limit <= 0 OR value * 20 <= 1.05 * speed_limit THEN 1.0 ELSE speed_limit / (value * 20) END::DOUBLE AS sp,
    CASE WHEN NOT uses_radar THEN 0.5 WHEN ceiling <= 0 OR value * 100 <= 1.05 * ceiling THEN 1.0 ELSE ceiling / (value * 100) END::DOUBLE AS al,
    CASE WHEN uses_radar THEN 1.0 ELSE 0.5 END::DOUBLE AS link,
    CASE WHEN operator IS NULL THEN 0.5 WHEN code = 0 AND operator = 'EUROPE' THEN 0.9 WHEN code = 1 AND operator = 'ASIA' THEN 0.8 WHEN code = 2 AND operator = 'AFRICA' THEN 1.0
      WHEN code = 2 THEN 0.0 ELSE 0.5 END::DOUBLE AS prior FROM ms t JOIN kg g USING (mode_id)),
  sc AS (SELECT *, {T.r6('raw')} AS mode_score, {T.r6('0.8::DOUBLE * (sp + al) / 2 + 0.2::DOUBLE * link')} AS aircraft_score,
    {T.r6('0.75::DOUBLE * raw + 0.15::DOUBLE * (0.8::DOUBLE * (sp + al) / 2 + 0.2::DOUBLE * link) + 0.10::DOUBLE * prior')} AS total FROM c),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY observation_id ORDER BY total DESC, mode_id, coalesce(aircraft_id, ''), coalesce(operator, '')) AS rank FROM sc) WHERE rank <= 5)"""


def tables(spark: SparkSession, sf_dir: str, truth: bool = True) -> dict[str, DataFrame]:
    """The six tables; the ranking, five rows of an observation, is kept while they are read."""
    return etl.ingest(observations(spark, sf_dir), rows(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz"), truth=truth, keep=DataFrame.persist)


@query(f"""WITH {_BEST} SELECT 'evidence:candidate:' || observation_id || ':' || rank AS id, observation_id, rank, mode_id, radar_id, aircraft_id, operator, mode_score, aircraft_score, total AS text_score FROM best""")
def ingest_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all candidate rows by nine fields, carrier and operator."""
    known = rows(spark, sf_dir)
    best = etl.topk(observations(spark, sf_dir), known).join(F.broadcast(known.select("row", *etl.NAMES)), "row")
    node = F.concat(F.lit("evidence:candidate:"), "observation_id", F.lit(":"), "rank")
    return best.select(node.alias("id"), "observation_id", "rank", *etl.NAMES, "mode_score", "aircraft_score", F.col("total_score").alias("text_score"))


@query(f"""WITH {_BEST}, g AS (SELECT observation_id, max(total) FILTER (rank = 1) AS s1, max(total) FILTER (rank = 2) AS s2, count(*) AS n, max(mode_id) FILTER (rank = 1) AS best_candidate_mode_id FROM best GROUP BY 1),
  u AS (SELECT *, least(greatest(CASE WHEN n > 1 THEN greatest(0.05::DOUBLE, 1 - (s1 - s2)) ELSE 0.1 END, 0.05::DOUBLE), 0.6::DOUBLE) AS u FROM g)
  SELECT 'evidence:observation:' || observation_id AS id, s1 AS text_score, round(n / 5.0::DOUBLE + 1e-9, 6) AS degree_score, best_candidate_mode_id,
  round({T.recency(T.days(f"TIMESTAMP '{NOW}'", 'o.ts'), 30, 0)} + 1e-9, 6) AS recency_score, round((1 - u) * least(greatest(s1, 0), 1) + 1e-9, 6) AS matching FROM u JOIN obs o USING (observation_id)""")
def ingest_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tables(spark, sf_dir)["observations"]
    return out.select("id", "text_score", "degree_score", "best_candidate_mode_id", "recency_score", F.col("ds_masses")[1].alias("matching"))


_D = lambda c: f"CASE WHEN l.{c} IS DISTINCT FROM r.{c} THEN '{c}' END"


@query(f"""WITH {_BEST}, contra AS (SELECT round(l.total - r.total + 1e-9, 6) AS delta, concat_ws(',', {", ".join(map(_D, etl.NAMES))}) AS reason FROM best l JOIN best r
    ON l.observation_id = r.observation_id AND l.rank < r.rank), n AS (SELECT observation_id, mode_id FROM best WHERE rank = 1), m AS (SELECT count(*) AS k FROM n GROUP BY mode_id)
  SELECT 'observations' AS name, (SELECT count(*) FROM n) AS rows UNION ALL SELECT 'candidates', (SELECT count(*) FROM best) UNION ALL SELECT 'candidate_edges', (SELECT count(*) FROM best)
  UNION ALL SELECT 'contradiction_edges', (SELECT count(*) FROM contra WHERE delta >= 0.05 AND reason <> '')
  UNION ALL SELECT 'truth_edges', (SELECT count(*) FROM best b JOIN obs o USING (observation_id) WHERE b.mode_id = 'mode:' || (o.series_id % 25) || ':' || (o.code + 1) AND aircraft_id IS NULL)
  UNION ALL SELECT 'similarity_edges', (SELECT sum(2 * (k - 1))::BIGINT FROM m)""")
def ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the six tables of evidence."""
    return etl.counts(tables(spark, sf_dir))


_AGREE = " + ".join(f"coalesce((o.lo{i} <= m.khi{i} AND m.klo{i} <= o.hi{i})::INT, 0)" for i in range(etl.N)) + " + coalesce((o.code = m.mode_code)::INT, 0) + coalesce((o.scan = m.mode_scan)::INT, 0)"


@query(f"""WITH {_OBS9}, {T.MODES}, {_MODES9}, v AS (SELECT o.observation_id, m.mode_id, {_AGREE} AS votes FROM obs9 o, modes9 m), h AS (SELECT * FROM v WHERE votes >= 3)
  SELECT * FROM h UNION ALL SELECT observation_id, mode_id, -1 FROM v WHERE observation_id NOT IN (SELECT observation_id FROM h)""")
def compatible_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every observation's modes that three of nine fields agree with; all modes, with votes of -1, where none do."""
    obs, modes = observations(spark, sf_dir), mode_bounds(V.modes(spark, sf_dir))
    fields = [(f"lo{i}", f"hi{i}", f"klo{i}", f"khi{i}") for i in range(etl.N)]
    agreed = R.agreements(obs, modes, "observation_id", "mode_id", fields, [("waveform", "mode_waveform"), ("scan", "mode_scan")], 3)
    return R.compatible(agreed, obs, modes, "observation_id", "mode_id").fillna(-1, ["votes"])
