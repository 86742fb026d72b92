"""Queries over reports and the claims in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.functions import scores as S
from credence.plans import twins as T
from credence.plans.registry import query
from credence.sources import views as V

HALF = V.REPORT_HALF_LIFE_DAYS

_SCORE = T.CLAIMS + f""", cs AS (SELECT *, {T.recency(T.days('reference_time', 'observed_at'), HALF, 0.25)} AS rec,
  CASE WHEN claim_type = 'R' THEN 0.9 WHEN claim_type = 'A' THEN 0.3 ELSE 0.5 END::DOUBLE AS prior FROM claims),
  sc AS (SELECT *, round(0.25::DOUBLE * {T.clamp('confidence')} + 0.20::DOUBLE * {T.clamp('credibility')} + 0.15::DOUBLE * {T.clamp('rec')} + 0.15::DOUBLE * {T.clamp('extraction')}
  + 0.10::DOUBLE * prior + 0.10::DOUBLE * 0.7::DOUBLE + 0.05::DOUBLE * {T.clamp('specificity')} + 1e-9, 6) AS score FROM cs)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = V.claims(spark, sf_dir)
    age = S.recency(S.days_between(F.col("reference_time"), F.col("observed_at")), HALF, 0.25)
    none = F.lit(None).cast("map<string,double>")
    prior = S.external_prior(F.col("claim_type"), F.create_map(F.lit("R"), F.lit(0.9), F.lit("A"), F.lit(0.3)), none, F.lit(None).cast("array<string>"))
    missing = F.lit(None).cast("double")
    score = S.claim_score(F.col("confidence"), F.col("credibility"), age, F.col("extraction"), prior, missing, F.col("specificity"))
    return claims.withColumn("score", score)


@query(f"WITH {_SCORE} SELECT report_id, claim_no, claim_type, score FROM sc")
def claim_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("report_id", "claim_no", "claim_type", "score")


@query("""SELECT 'evidence:report:' || o_orderkey AS node_id, o_orderkey AS report_id, least(greatest(o_totalprice / 500000, 0), 1) AS credibility,
  count(l_linenumber) AS claims, coalesce(sum((l_linestatus = 'F')::INT), 0) AS refuting FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_totalprice""")
def report_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each report, with or without claims."""
    item = V.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum((F.col("l_linestatus") == "F").cast("int")).alias("f"))
    report = V.table(spark, sf_dir, "orders")
    return report.join(item, report.o_orderkey == item.l_orderkey, "left").select(
        F.concat(F.lit("evidence:report:"), "o_orderkey").alias("node_id"), F.col("o_orderkey").alias("report_id"),
        S.clamp(F.col("o_totalprice") / 500000).alias("credibility"), F.coalesce("n", F.lit(0)).alias("claims"), F.coalesce("f", F.lit(0)).alias("refuting"),
    )


@query(f"""WITH {_SCORE}, m AS (SELECT *, CASE WHEN stance = 'refutes' THEN 0.35 ELSE 0.2 END::DOUBLE AS u FROM sc)
  SELECT 'evidence:claim:' || report_id || '-' || claim_no AS node_id, report_id, claim_no, stance, score,
  round(1 - u - (1 - u) * score + 1e-9, 6) AS against, round((1 - u) * score + 1e-9, 6) AS matching, round(u + 1e-9, 6) AS unknown FROM m""")
def claim_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each claim with masses from its score; refuting claims leave more unknown."""
    unclear = F.when(F.col("stance") == "refutes", 0.35).otherwise(0.2)
    m = S.masses_from_score(F.col("score"), unclear)
    return scored(spark, sf_dir).select(
        F.concat(F.lit("evidence:claim:"), "report_id", F.lit("-"), "claim_no").alias("node_id"), "report_id", "claim_no", "stance", "score",
        m[0].alias("against"), m[1].alias("matching"), m[2].alias("unknown"),
    )


@query(f"""WITH {_SCORE} SELECT l.report_id, l.claim_type, CASE WHEN r.score > l.score THEN r.claim_no ELSE l.claim_no END AS source,
  CASE WHEN r.score > l.score THEN l.claim_no ELSE r.claim_no END AS target, round(abs(l.score - r.score) + 1e-9, 6) AS score_delta
  FROM sc l JOIN sc r ON l.report_id = r.report_id AND l.claim_type = r.claim_type AND l.claim_no < r.claim_no AND l.object_id IS DISTINCT FROM r.object_id""")
def claim_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of one kind in a report about different objects; from the higher score, on ties from the earlier."""
    sc = scored(spark, sf_dir).select("report_id", "claim_type", "claim_no", "object_id", "score")
    r = sc.select("report_id", "claim_type", F.col("claim_no").alias("rn"), F.col("object_id").alias("ro"), F.col("score").alias("rs"))
    turned = F.col("rs") > F.col("score")
    return sc.join(r, ["report_id", "claim_type"]).where((F.col("claim_no") < F.col("rn")) & ~F.col("object_id").eqNullSafe(F.col("ro"))).select(
        "report_id", "claim_type", F.when(turned, F.col("rn")).otherwise(F.col("claim_no")).alias("source"),
        F.when(turned, F.col("claim_no")).otherwise(F.col("rn")).alias("target"), S.r6(F.abs(F.col("score") - F.col("rs"))).alias("score_delta"),
    )


@query(f"""WITH {_SCORE} SELECT report_id AS source, 'REPORT_CONTAINS_CLAIM' AS type, claim_no AS target, NULL::DOUBLE AS score, NULL AS stance FROM sc
  UNION ALL SELECT report_id, 'CLAIM_SUPPORTS_OBSERVATION', claim_no, score, stance FROM sc""")
def contains_support_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both links of each claim; a refuting claim supports too, with its stance."""
    # Claims meet their reports once for both.
    contains = F.struct(F.lit("REPORT_CONTAINS_CLAIM").alias("type"), F.col("claim_no").alias("target"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("stance"))
    supports = F.struct(F.lit("CLAIM_SUPPORTS_OBSERVATION").alias("type"), F.col("claim_no").alias("target"), "score", "stance")
    return scored(spark, sf_dir).select(F.col("report_id").alias("source"), F.inline(F.array(contains, supports)))


@query("""SELECT 'claims' AS name, l_returnflag AS kind, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'reports', o_orderstatus, count(*) FROM orders GROUP BY 2
  UNION ALL SELECT 'observations', event_type, count(*) FROM events GROUP BY 2 UNION ALL SELECT 'turns', role, count(*) FROM conversations GROUP BY 2""")
def evidence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every evidence table by kind."""
    out = None
    for name, table, kind in (("claims", "lineitem", "l_returnflag"), ("reports", "orders", "o_orderstatus"), ("observations", "events", "event_type"), ("turns", "conversations", "role")):
        n = V.table(spark, sf_dir, table).groupBy(F.col(kind).alias("kind")).count().select(F.lit(name).alias("name"), "kind", F.col("count").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


@query("""SELECT report_id, count(*) AS claims, sum(price) AS price_total FROM (SELECT l_orderkey AS report_id, round(l_extendedprice + 1e-9, 6) AS price FROM lineitem) GROUP BY 1
  """.replace("sum(price)", "round(sum(price), 2)"))
def flatten_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims nested into their reports and flattened again."""
    item = V.table(spark, sf_dir, "lineitem")
    nested = item.groupBy(F.col("l_orderkey").alias("report_id")).agg(
        F.collect_list(F.struct("l_linenumber", S.r6(F.col("l_extendedprice")).alias("price"))).alias("claims")
    )
    flat = nested.select("report_id", F.explode("claims").alias("claim"))
    return flat.groupBy("report_id").agg(F.count("*").alias("claims"), F.round(F.sum("claim.price"), 2).alias("price_total"))
