"""Queries that score observations against intervals and candidate rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credence.functions import scores as S
from credence.operators import candidates as C
from credence.operators import etl as E
from credence.operators import frames
from credence.operators import ranges as R
from credence.plans import twins as T
from credence.plans.registry import query
from credence.sources import views as V

_OWN = "own AS (SELECT o.*, m.* FROM obs o JOIN modes m ON m.nation = o.series_id % 25)"


def own_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every observation with the five modes of the radar that its series is dealt to."""
    obs = V.observations(spark, sf_dir).withColumn("nation", (F.col("series_id") % 25).cast("int"))
    return obs.join(F.broadcast(V.modes(spark, sf_dir)), "nation")


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount > 0.02 AND l_tax > 0.01 THEN l_discount ELSE l_quantity - coalesce(nullif(l_tax, 0), 0) END + 1e-9, 6) AS lo,
  round(CASE WHEN l_discount > 0.02 AND l_tax > 0.01 THEN l_tax ELSE l_quantity + coalesce(nullif(l_tax, 0), 0) END + 1e-9, 6) AS hi FROM lineitem""")
def measurement_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated bounds where both are given, else value and error; an error that is missing counts as 0."""
    item = V.table(spark, sf_dir, "lineitem")
    low, high = F.when(F.col("l_discount") > 0.02, F.col("l_discount")), F.when(F.col("l_tax") > 0.01, F.col("l_tax"))
    lo, hi = S.measurement_interval(F.col("l_quantity"), F.nullif(F.col("l_tax"), F.lit(0.0)), low, high)
    return item.select("l_orderkey", "l_linenumber", S.r6(lo).alias("lo"), S.r6(hi).alias("hi"))


@query(f"WITH {T.OBS}, {T.MODES}, {_OWN} SELECT observation_id, mode_id, round({T.overlap('lo', 'hi', 'klo', 'khi')} + 1e-9, 6) AS overlap FROM own")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = S.interval_overlap(F.col("lo"), F.col("hi"), F.col("klo"), F.col("khi"))
    return own_modes(spark, sf_dir).select("observation_id", "mode_id", S.r6(score).alias("overlap"))


@query(f"""WITH {T.OBS}, {T.MODES}, {_OWN} SELECT observation_id, mode_id,
  round(abs((lo + hi) / 2 - (klo + khi) / 2) / greatest(khi - klo, abs((klo + khi) / 2), 1.0) + 1e-9, 6) AS value_residual,
  round(abs(k - (k_klo + k_khi) / 2) / greatest(k_khi - k_klo, abs((k_klo + k_khi) / 2), 1.0) + 1e-9, 6) AS k_residual, code = mode_code AS waveform_match FROM own""")
def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = S.residual(F.col("lo"), F.col("hi"), F.col("klo"), F.col("khi"))
    k = S.residual(F.col("k"), F.col("k"), F.col("k_klo"), F.col("k_khi"))
    match = F.col("code").eqNullSafe(F.col("mode_code"))
    return own_modes(spark, sf_dir).select("observation_id", "mode_id", value.alias("value_residual"), k.alias("k_residual"), match.alias("waveform_match"))


@query(f"""WITH {T.OBS}, {T.MODES}, {_OWN}, s AS (SELECT observation_id, mode_id, {T.overlap('lo', 'hi', 'klo', 'khi')} AS s1,
  {T.overlap('k * 0.95', 'k * 1.05', 'k_klo', 'k_khi')} AS s2, (code = mode_code)::INT::DOUBLE AS s3 FROM own)
  SELECT observation_id, mode_id, round((coalesce(s1, 0) + coalesce(s2, 0) + s3) / ((s1 IS NOT NULL)::INT + (s2 IS NOT NULL)::INT + 1) + 1e-9, 6) AS mode_score,
  coalesce((s1 >= 0.5)::INT, 0) + coalesce((s2 >= 0.5)::INT, 0) + (s3 >= 0.5)::INT AS matched, (s1 IS NULL)::INT + (s2 IS NULL)::INT AS missing FROM s""")
def feature_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over the fields that both sides have, matched fields and missing ones."""
    parts = [
        S.interval_overlap(F.col("lo"), F.col("hi"), F.col("klo"), F.col("khi")),
        S.interval_overlap(F.col("k") * 0.95, F.col("k") * 1.05, F.col("k_klo"), F.col("k_khi")),
        (F.col("code") == F.col("mode_code")).cast("double"),
    ]
    missing = parts[0].isNull().cast("int") + parts[1].isNull().cast("int")
    return own_modes(spark, sf_dir).select(
        "observation_id", "mode_id", S.r6(S.mean_known(parts)).alias("mode_score"), S.count_at_least(parts, 0.5).alias("matched"), missing.alias("missing")
    )


@query("""WITH j AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 5 AS seen, s_acctbal AS lim, s_suppkey IS NOT NULL AS there, p_size > 10 AS linked
  FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_acctbal < 8000 LEFT JOIN part ON l_partkey = p_partkey),
  s AS (SELECT *, (CASE WHEN NOT there THEN 0.5 WHEN lim <= 0 OR seen <= 1.05 * lim THEN 1.0 ELSE lim / seen END)::DOUBLE AS c,
  (CASE WHEN NOT there THEN 0.5 WHEN linked THEN 1.0 ELSE 0.0 END)::DOUBLE AS link FROM j)
  SELECT l_orderkey, l_linenumber, round(c + 1e-9, 6) AS consistency, link AS link_score, round(0.8::DOUBLE * c + 0.2::DOUBLE * link + 1e-9, 6) AS carrier_score FROM s""")
def consistency_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits below zero, within and beyond; carriers that are missing or not linked."""
    item = V.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice")
    own = V.table(spark, sf_dir, "supplier").where("s_acctbal < 8000").select("s_suppkey", "s_acctbal")
    part = V.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") > 10).alias("linked"))
    j = item.join(own, item.l_suppkey == own.s_suppkey, "left").join(part, item.l_partkey == part.p_partkey, "left")
    there = F.col("s_suppkey").isNotNull()
    c = S.limit_consistency(there, F.col("l_extendedprice") / 5, F.col("s_acctbal"))
    link = S.carrier_link(there, F.col("linked"))
    return j.select("l_orderkey", "l_linenumber", S.r6(c).alias("consistency"), link.alias("link_score"), S.r6(S.carrier_score(c, link)).alias("carrier_score"))


@query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN least(greatest(c_acctbal / 5000, 0), 1)
  WHEN c_nationkey < 5 THEN 0.25 WHEN c_nationkey < 10 THEN (c_mktsegment IN ('MACHINERY', 'FURNITURE'))::INT ELSE 0.5 END::DOUBLE AS prior FROM customer""")
def external_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map's value, clamped; a second map's; membership of a list; else a half."""
    cust = V.table(spark, sf_dir, "customer")
    none = F.lit(None).cast("map<string,double>")
    first = F.create_map(F.lit("BUILDING"), F.col("c_acctbal") / 5000)
    second = F.when(F.col("c_nationkey") < 5, F.map_from_arrays(F.array("c_mktsegment"), F.array(F.lit(0.25)))).otherwise(none)
    named = F.when(F.col("c_nationkey") < 10, F.array(F.lit("MACHINERY"), F.lit("FURNITURE")))
    return cust.select("c_custkey", S.external_prior(F.col("c_mktsegment"), first, second, named).alias("prior"))


@query(f"""SELECT o_orderkey, round({T.recency(T.days("TIMESTAMP '1998-01-01'", 'o_orderdate'), 30, 0)} + 1e-9, 6) AS observation_recency,
  round({T.recency("CASE WHEN o_orderstatus <> 'F' THEN " + T.days("TIMESTAMP '1998-01-01'", 'o_orderdate') + " END", 365, 0.25)} + 1e-9, 6) AS report_recency FROM orders""")
def recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ages against a given time; ages below zero are none; a missing time has a default."""
    age = S.days_between(F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"), F.col("o_orderdate"))
    known = F.when(F.col("o_orderstatus") != "F", age)
    return V.table(spark, sf_dir, "orders").select(
        "o_orderkey", S.r6(S.recency(age, 30.0, 0.0)).alias("observation_recency"), S.r6(S.recency(known, 365.0, 0.25)).alias("report_recency")
    )


_TOPK = f"WITH {T.SCORED} SELECT observation_id, rank, total, mode_id, radar_id, carrier_id, operator FROM topk"


def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best candidates of each different measurement, which ``C.dealt`` gives to its observations."""
    return C.topk(C.measurements(V.observations(spark, sf_dir)), V.candidate_rows(spark, sf_dir))


@query(_TOPK)
def candidate_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.dealt(best(spark, sf_dir), V.observations(spark, sf_dir))
    return found.select("observation_id", "rank", "total", "mode_id", "radar_id", "carrier_id", "operator")


@query(_TOPK)
def candidate_topk_factored(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = V.observations(spark, sf_dir)
    found = C.topk_factored(C.measurements(obs), V.modes(spark, sf_dir), V.candidate_rows(spark, sf_dir))
    return C.dealt(found, obs).select("observation_id", "rank", "total", "mode_id", "radar_id", "carrier_id", "operator")


def _differ(c: str) -> str:
    return f"CASE WHEN l.{c} IS DISTINCT FROM r.{c} THEN '{c}' END"


_CONTRA = T.SCORED + f""", contra AS (SELECT * FROM (SELECT l.observation_id, l.rank AS source_rank, r.rank AS target_rank, round(abs(l.total - r.total) + 1e-9, 6) AS score_delta,
  concat_ws(',', {_differ('mode_id')}, {_differ('radar_id')}, {_differ('carrier_id')}, {_differ('operator')}) AS reason
  FROM topk l JOIN topk r ON l.observation_id = r.observation_id AND l.rank < r.rank) WHERE score_delta >= 0.05 AND reason <> '')"""


@query(f"WITH {_CONTRA} SELECT * FROM contra")
def candidate_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.dealt(C.contradictions(best(spark, sf_dir)), V.observations(spark, sf_dir))


@query(f"""WITH {_CONTRA} SELECT unnest(string_split(reason, ',')) AS reason, count(*) AS n FROM contra GROUP BY 1""")
def reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = C.measurement(V.observations(spark, sf_dir)).groupBy(F.col("measurement").alias("observation_id")).agg(F.count("*").alias("n"))
    found = C.contradictions(best(spark, sf_dir)).join(shared, "observation_id")
    return found.select(F.explode(F.split("reason", ",")).alias("reason"), "n").groupBy("reason").agg(F.sum("n").alias("n"))


_AMB = T.SCORED + """, g AS (SELECT observation_id, max(total) FILTER (rank = 1) AS s1, max(total) FILTER (rank = 2) AS s2, count(*) AS n FROM topk GROUP BY 1),
  a AS (SELECT *, CASE WHEN s2 IS NULL THEN 0.1 ELSE greatest(0.05::DOUBLE, 1 - (s1 - s2)) END::DOUBLE AS unclear FROM g),
  u AS (SELECT *, least(greatest(unclear, 0.05::DOUBLE), 0.6::DOUBLE) AS u FROM a),
  amb AS (SELECT observation_id, s1 AS best_total, round(unclear + 1e-9, 6) AS ambiguity, n / 5.0::DOUBLE AS degree_score,
  round(1 - u - (1 - u) * least(greatest(s1, 0), 1) + 1e-9, 6) AS against, round((1 - u) * least(greatest(s1, 0), 1) + 1e-9, 6) AS matching, round(u + 1e-9, 6) AS unknown FROM u)"""


@query(f"WITH {_AMB} SELECT * FROM amb")
def ambiguity_masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.dealt(C.ambiguity(best(spark, sf_dir)).drop("best_mode"), V.observations(spark, sf_dir))


@query(f"""WITH {_AMB} SELECT amb.*, 'evidence:observation:' || o.observation_id AS node_id, t.mode_id AS best_mode, round(o.hi - o.lo + coalesce(o.k * 1.05::DOUBLE - o.k * 0.95::DOUBLE, 0) + 1e-9, 6) AS uncertainty,
  round({T.recency(T.days("TIMESTAMP '2024-06-01'", 'o.ts'), 30, 0)} + 1e-9, 6) AS recency FROM amb JOIN obs o USING (observation_id) JOIN topk t ON t.observation_id = o.observation_id AND t.rank = 1""")
def observation_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence row of every observation: best candidate, masses, widths of its measurements, recency."""
    age = S.days_between(F.lit("2024-06-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    width = F.col("hi") - F.col("lo") + F.coalesce(F.col("k") * 1.05 - F.col("k") * 0.95, F.lit(0.0))
    obs = V.observations(spark, sf_dir).select(
        "*", F.concat(F.lit("evidence:observation:"), "observation_id").alias("node_id"), S.r6(width).alias("uncertainty"), S.r6(S.recency(age, 30.0, 0.0)).alias("recency")
    )
    return C.dealt(C.ambiguity(best(spark, sf_dir)), obs, "node_id", "uncertainty", "recency")


@query(f"""WITH {T.SCORED} SELECT 'evidence:candidate:' || observation_id || ':' || rank AS node_id, observation_id, rank, mode_id, total,
  round(abs((SELECT 0)) + (rank - 1) / 4.0::DOUBLE + 1e-9, 6) AS rank_fraction, operator AS operator_country FROM topk""")
def candidate_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence row of every kept candidate; its place among its observation's candidates as a fraction."""
    n = F.count("*").over(Window.partitionBy("observation_id"))
    found = best(spark, sf_dir).withColumn("rank_fraction", S.r6((F.col("rank") - 1) / F.greatest(n - 1, F.lit(1))))
    return C.dealt(found, V.observations(spark, sf_dir)).select(
        F.concat(F.lit("evidence:candidate:"), "observation_id", F.lit(":"), "rank").alias("node_id"), "observation_id", "rank", "mode_id", "total",
        "rank_fraction", F.col("operator").alias("operator_country"),
    )


_BEST_MODE = T.SCORED + """, bm AS (SELECT o.observation_id, o.ts, t.mode_id FROM obs o JOIN topk t USING (observation_id) WHERE t.rank = 1),
  nx AS (SELECT mode_id, observation_id AS a, lead(observation_id) OVER (PARTITION BY mode_id ORDER BY ts, observation_id) AS b FROM bm)"""


@query(f"WITH {_BEST_MODE} SELECT mode_id, a AS source, b AS target FROM nx WHERE b IS NOT NULL UNION ALL SELECT mode_id, b, a FROM nx WHERE b IS NOT NULL")
def shares_best_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours in time among the observations of one best mode, both ways."""
    first = C.dealt(best(spark, sf_dir).where("rank = 1").select("observation_id", "mode_id"), V.observations(spark, sf_dir), "ts")
    ends = F.array(F.struct("source", "target"), F.struct(F.col("target").alias("source"), F.col("source").alias("target")))
    return E.chain(first, "mode_id", "ts", "observation_id").select("mode_id", F.inline(ends))


@query(f"""WITH {T.SCORED} SELECT t.observation_id, t.rank, t.mode_id, t.carrier_id FROM topk t JOIN obs o USING (observation_id)
  WHERE t.mode_id = 'mode:' || (o.series_id % 25) || ':' || (o.code + 1) AND t.carrier_id IS NOT DISTINCT FROM (SELECT min(carrier_id) FROM carriers c WHERE c.radar_id = t.radar_id)""")
def truth_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that are the truth by mode and carrier; the operator does not matter."""
    truth = V.observations(spark, sf_dir).withColumn("true_mode", F.concat(F.lit("mode:"), (F.col("series_id") % 25), F.lit(":"), F.col("code") + 1))
    known = V.carriers(spark, sf_dir).groupBy("radar_id").agg(F.min("carrier_id").alias("truth"))
    return (
        C.dealt(best(spark, sf_dir), truth, "true_mode").where("mode_id = true_mode").join(F.broadcast(known), "radar_id", "left")
        .where(F.col("carrier_id").eqNullSafe(F.col("truth"))).select("observation_id", "rank", "mode_id", "carrier_id")
    )


_VOTE = f"""WITH {T.OBS}, {T.MODES}, v AS (SELECT o.observation_id, m.mode_id, coalesce((least(o.hi, m.khi) >= greatest(o.lo, m.klo))::INT, 0)
  + coalesce((least(o.k * 1.05::DOUBLE, m.k_khi) >= greatest(o.k * 0.95::DOUBLE, m.k_klo))::INT, 0) + (o.code = m.mode_code)::INT AS votes FROM obs o, modes m),
  h AS (SELECT observation_id, count(*) AS n, min(mode_id) AS first_mode FROM v WHERE votes >= 2 GROUP BY 1)
  SELECT o.observation_id, coalesce(h.n, (SELECT count(*) FROM modes)) AS compatible, coalesce(first_mode, (SELECT min(mode_id) FROM modes)) AS first_mode, h.n IS NULL AS fell_back
  FROM obs o LEFT JOIN h USING (observation_id)"""


@query(_VOTE)
def interval_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modes that two of three fields agree with; all modes where none do."""
    modes = V.modes(spark, sf_dir)
    return R.vote(V.observations(spark, sf_dir), modes, [("lo", "hi", "klo", "khi"), ("k_lo", "k_hi", "k_klo", "k_khi")], [("code", "mode_code")], 2)


@query(f"""WITH {T.KG}, {T.OBS}, hit AS (SELECT o.observation_id, m.radar_id FROM obs o JOIN modes m ON o.value BETWEEN m.klo AND m.khi),
  n AS (SELECT h.observation_id, count(DISTINCT h.radar_id) AS radars, count(DISTINCT c.carrier_id) AS carriers FROM hit h LEFT JOIN carriers c USING (radar_id) GROUP BY 1)
  SELECT o.observation_id, coalesce(n.radars, (SELECT count(DISTINCT radar_id) FROM modes)) AS radars, CASE WHEN coalesce(n.carriers, 0) = 0 THEN (SELECT count(*) FROM carriers) ELSE n.carriers END AS carriers,
  coalesce(n.carriers, 0) = 0 AS used_fallback FROM obs o LEFT JOIN n USING (observation_id)""")
def point_in_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Radars with a mode around the value, and their carriers; all carriers where there are none."""
    obs = V.observations(spark, sf_dir).select("observation_id", "value")
    modes = V.modes(spark, sf_dir).select("radar_id", "klo", "khi")
    # Each value is looked up once, and its hits are numbers of radars, not pairs with carriers.
    values = R.spread(obs.select("value").distinct(), "value")
    carriers = V.carriers(spark, sf_dir).select("radar_id", "carrier_id")
    hits = R.point_in_interval(values, modes, "value", "klo", "khi", width=50.0).groupBy("value").agg(F.collect_set("radar_id").alias("radars"))
    # A row for each set of radars that some value meets.
    sets = hits.select("radars").distinct().select("radars", F.explode("radars").alias("radar_id")).join(F.broadcast(carriers), "radar_id", "left")
    counted = sets.groupBy("radars").agg(F.countDistinct("radar_id").alias("r"), F.countDistinct("carrier_id").alias("c"))
    n = hits.join(counted, "radars").select("value", "r", "c")
    everything = F.broadcast(carriers.agg(F.count("*").alias("all")).crossJoin(modes.agg(F.countDistinct("radar_id").alias("radar_total"))))
    none = F.coalesce("c", F.lit(0)) == 0
    return obs.join(n, "value", "left").crossJoin(everything).select(
        "observation_id", F.coalesce("r", "radar_total").alias("radars"), F.when(none, F.col("all")).otherwise(F.col("c")).alias("carriers"), none.alias("used_fallback")
    )


@query(f"""WITH {T.KG}, p AS (SELECT a.mode_id, b.mode_id AS other, b.nation, b.mode_index, row_number() OVER (PARTITION BY a.mode_id ORDER BY b.nation, b.mode_index) AS r
  FROM modes a JOIN modes b ON a.mode_id <> b.mode_id AND (a.radar_id = b.radar_id OR (a.nation % 5 = b.nation % 5 AND b.mode_name <> 'guide')))
  SELECT mode_id, other, r AS place FROM p WHERE r <= 10""")
def ambiguous_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten modes, in catalogue order, of the same radar, or of the same family but for one kind."""
    m = V.modes(spark, sf_dir)
    b = m.select(F.col("mode_id").alias("other"), F.col("radar_id").alias("rb"), F.col("nation").alias("nb"), F.col("mode_index").alias("ib"), F.col("mode_name").alias("kind"))
    near = (F.col("radar_id") == F.col("rb")) | ((F.col("nation") % 5 == F.col("nb") % 5) & (F.col("kind") != "guide"))
    w = Window.partitionBy("mode_id").orderBy("nb", "ib")
    pairs = m.join(F.broadcast(b), near & (F.col("mode_id") != F.col("other")))
    return pairs.withColumn("place", F.row_number().over(w)).where("place <= 10").select("mode_id", "other", "place")


@query(f"WITH {T.SCORED} SELECT o.series_id, t.observation_id, t.rank, t.mode_id FROM topk t JOIN obs o USING (observation_id) WHERE t.rank <= 3 AND o.series_id IS NOT NULL")
def rank_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best candidates of every observation that is in a series."""
    obs = V.observations(spark, sf_dir).where(F.col("series_id").isNotNull())
    return C.dealt(best(spark, sf_dir).where("rank <= 3"), obs, "series_id").select("series_id", "observation_id", "rank", "mode_id")


@query(f"""WITH {T.SCORED}, ids AS (SELECT series_id, mode_id FROM topk JOIN obs USING (observation_id) WHERE rank <= 2
  UNION SELECT series_id, 'mode:' || (series_id % 25) || ':' || (code + 1) FROM obs)
  SELECT series_id, count(*) AS frame, (SELECT count(*) FROM modes) - count(*) AS outside, min(mode_id) AS first_id, max(mode_id) AS last_id FROM ids GROUP BY series_id""")
def frame_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame of a series: its observations' two best modes and its true ones; how many modes are outside."""
    obs = V.observations(spark, sf_dir)
    truth = obs.select("series_id", F.concat(F.lit("mode:"), F.col("series_id") % 25, F.lit(":"), F.col("code") + 1).alias("mode_id"))
    seen = C.dealt(best(spark, sf_dir).where("rank <= 2").select("observation_id", "mode_id"), obs, "series_id").select("series_id", "mode_id")
    ids = seen.unionByName(truth).distinct()
    n = F.broadcast(V.modes(spark, sf_dir).agg(F.count("*").alias("all")))
    frames = ids.groupBy("series_id").agg(F.count("*").alias("frame"), F.min("mode_id").alias("first_id"), F.max("mode_id").alias("last_id"))
    return frames.crossJoin(n).select("series_id", "frame", (F.col("all") - F.col("frame")).alias("outside"), "first_id", "last_id")


@query(f"""WITH {T.KG}, {T.OBS}, hit AS (SELECT o.observation_id, m.radar_id FROM obs o JOIN modes m ON o.value BETWEEN m.klo AND m.khi),
  f AS (SELECT h.observation_id, list(DISTINCT h.radar_id) AS radars, list(DISTINCT c.carrier_id) FILTER (c.carrier_id IS NOT NULL) AS carriers FROM hit h LEFT JOIN carriers c USING (radar_id) GROUP BY 1),
  g AS (SELECT o.series_id, strftime(o.ts, '%Y-%m-%d %H') AS hour, coalesce(len(carriers), 0) = 0 AS none, CASE WHEN coalesce(len(carriers), 0) = 0 THEN (SELECT list(DISTINCT radar_id) FROM modes) ELSE radars END AS radars,
    CASE WHEN coalesce(len(carriers), 0) = 0 THEN (SELECT list(carrier_id) FROM carriers) ELSE carriers END AS carriers FROM obs o LEFT JOIN f USING (observation_id)),
  u AS (SELECT series_id, hour, count(*) AS observations, sum(none::INT)::BIGINT AS fell_back, list_sort(list_distinct(flatten(list(radars)))) AS r, list_sort(list_distinct(flatten(list(carriers)))) AS c FROM g GROUP BY series_id, hour)
  SELECT series_id, hour, observations, fell_back, array_to_string(r, ',') AS radars, array_to_string(c, ',') AS carriers,
    array_to_string(list_sort(list_filter((SELECT list(carrier_id) FROM carriers), lambda x: NOT list_contains(c, x))), ',') AS outside FROM u""")
def frequency_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame of each series in each hour: radars and carriers that some observation's value leaves open, and carriers outside; sets are bit masks until the end."""
    obs, modes, carriers = V.observations(spark, sf_dir), V.modes(spark, sf_dir), V.carriers(spark, sf_dir)
    # Each value is gated once.
    values = obs.select("value").distinct()
    gate = frames.gated(R.spread(values, "value"), modes, carriers, "value", "value", 50.0)
    radar, carrier = (frames.vocabulary(x, c) for x, c in ((modes.select("radar_id").unionByName(carriers.select("radar_id")), "radar_id"), (carriers, "carrier_id")))
    wr, wc = (frames.words(x.count()) for x in (radar, carrier))
    rows = obs.select("value", "series_id", F.date_format("ts", "yyyy-MM-dd HH").alias("hour")).join(gate.withColumnRenamed("value", "__v"), F.col("value").eqNullSafe(F.col("__v")))
    united = rows.groupBy("series_id", "hour").agg(
        F.count("*").alias("observations"), F.sum(F.col("used_fallback").cast("long")).alias("fell_back"), *[F.bit_or(F.col("radars")[w]).alias(f"r{w}") for w in range(wr)], *frames.unite(F.col("carriers"), wc)
    )
    # Few different frames stand for many hours, so each is written out once.
    bits = [*[f"r{w}" for w in range(wr)], *[f"__w{w}" for w in range(wc)]]
    everyone = F.broadcast(frames.listing(radar).select(F.col("names").alias("radar_names")).crossJoin(frames.listing(carrier).select(F.col("names").alias("carrier_names"))))
    sets = united.select(*bits).distinct().crossJoin(everyone).select("*", F.array(*[f"r{w}" for w in range(wr)]).alias("r"), frames.collected(wc).alias("c"))
    named = sets.select(
        *bits, F.array_join(frames.members(F.col("r"), F.col("radar_names")), ",").alias("radars"), F.array_join(frames.members(F.col("c"), F.col("carrier_names")), ",").alias("carriers"),
        F.array_join(frames.members(frames.without(frames.everything(F.size("carrier_names"), wc), F.col("c")), F.col("carrier_names")), ",").alias("outside"),
    )
    return united.join(named, bits).select("series_id", "hour", "observations", "fell_back", "radars", "carriers", "outside")
