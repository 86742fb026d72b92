"""Queries that deal whole groups to splits by counts, number nodes densely, and make one feature matrix of mixed nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.operators import splits as S
from credence.plans import learning as L
from credence.plans import twins as T
from credence.plans.registry import query
from credence.sources import views as V

SHARES = {"train": 0.5, "test": 0.3, "val": 0.2}
_HASH = "({c} * 7919 + 104729) % 1000003"
_REST = "[" + ", ".join(f"struct_pack(lack := {share!r}::DOUBLE * n - floor({share!r}::DOUBLE * n), due := w{k} - g{k} - floor({share!r}::DOUBLE * n), place := -{k})" for k, share in enumerate(SHARES.values())) + "]"
_FLOOR = [f"floor({share!r}::DOUBLE * n)" for share in SHARES.values()]
_LEFT = f"n - ({' + '.join(_FLOOR)})"
_OWN = [f"({f} + list_contains(list_transform(list_sort({_REST}, 'DESC')[1:({_LEFT})::BIGINT], lambda x: x.place), -{k})::INT)" for k, f in enumerate(_FLOOR)]


@query(f"""WITH RECURSIVE cust AS (SELECT c_custkey, json_object('c_nationkey', c_nationkey, 'c_mktsegment', c_mktsegment)::VARCHAR AS stratum FROM customer),
  sizes AS (SELECT stratum, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, stratum) AS i FROM cust GROUP BY stratum), allc AS (SELECT count(*) AS c FROM cust),
  dealt AS (SELECT i, stratum, n, {", ".join(f"{share!r}::DOUBLE * c AS w{k}, 0.0::DOUBLE AS g{k}" for k, share in enumerate(SHARES.values()))} FROM sizes, allc WHERE i = 1
    UNION ALL SELECT s.i, s.stratum, s.n, {", ".join(f"d.w{k}, d.g{k} + d.o{k}" for k in range(3))} FROM (SELECT *, {", ".join(f"{o} AS o{k}" for k, o in enumerate(_OWN))} FROM dealt) d JOIN sizes s ON s.i = d.i + 1),
  ends AS (SELECT stratum, {", ".join(f"{o} AS o{k}" for k, o in enumerate(_OWN))} FROM dealt),
  placed AS (SELECT c_custkey, stratum, row_number() OVER (PARTITION BY stratum ORDER BY {_HASH.format(c="c_custkey")}, c_custkey) AS p FROM cust)
  SELECT o_orderkey, c_custkey, CASE WHEN p <= o0 THEN 'train' WHEN p <= o0 + o1 THEN 'test' ELSE 'val' END AS split FROM orders JOIN placed ON o_custkey = c_custkey JOIN ends USING (stratum)""")
def quota_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders dealt to splits by whole customers, by quota in each nation and segment."""
    own = V.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    dealt = S.quota_split(own, "c_custkey", ["c_nationkey", "c_mktsegment"], SHARES, L._shuffled, L.SLICE).select("c_custkey", "split")
    return V.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(dealt, "c_custkey").select("o_orderkey", "c_custkey", "split")


_GROUP = "CASE WHEN event_id % 13 <> 0 THEN user_id END"


@query(f"""WITH e AS (SELECT event_id, {_GROUP} AS g FROM events), named AS (SELECT event_id, g, g IS NULL AS alone, coalesce(g, event_id) AS name FROM e),
  grp AS (SELECT alone, name, row_number() OVER (ORDER BY {_HASH.format(c="name")}, alone, name::VARCHAR) AS p, count(*) OVER () AS n FROM (SELECT DISTINCT alone, name FROM named))
  SELECT event_id, coalesce(g, -1) AS group_id, CASE WHEN p <= floor(n * 0.7::DOUBLE + 0.5) THEN 'train' WHEN p <= floor(n * 0.7::DOUBLE + 0.5) + floor(n * 0.15::DOUBLE + 0.5) THEN 'test' ELSE 'val' END AS split FROM named JOIN grp USING (alone, name)""")
def rounded_group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events dealt to splits by user, rounded shares of all groups; an event without a user stands alone."""
    rows = V.table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 13 != 0, F.col("user_id")).alias("group_id"))
    return S.rounded_split(rows, "group_id", "event_id", 0.7, 0.15, L._shuffled, L.SLICE).fillna(-1, ["group_id"])


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of observations, modes and carriers."""
    obs = V.observations(spark, sf_dir).select(F.concat(F.lit("observation:"), "observation_id").alias("id"))
    return obs.unionByName(V.modes(spark, sf_dir).select(F.col("mode_id").alias("id"))).unionByName(V.carriers(spark, sf_dir).select(F.col("carrier_id").alias("id")))


_NODES = """nodes AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS index FROM (SELECT 'observation:' || observation_id AS id FROM obs UNION ALL SELECT mode_id FROM modes UNION ALL SELECT carrier_id FROM carriers))"""


@query(f"WITH {T.KG}, {T.OBS}, {_NODES} SELECT id, index FROM nodes")
def dense_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes numbered from 0 in the order of their ids."""
    return S.dense_index(nodes(spark, sf_dir), "id")


@query(f"""WITH {T.KG}, {T.OBS}, {_NODES}, link AS (SELECT 'observation:' || observation_id AS source, 'SHOWS_MODE' AS relation, 'mode:' || (series_id % 30) || ':' || (code + 1) AS target FROM obs
    UNION ALL SELECT 'observation:' || observation_id, 'NEXT', 'observation:' || (observation_id + 1) FROM obs UNION ALL SELECT carrier_id, 'USES_RADAR_WITH', mode_id FROM carriers JOIN modes USING (radar_id)),
  kinds AS (SELECT relation, row_number() OVER (ORDER BY relation) - 1 AS rel FROM (SELECT DISTINCT relation FROM link))
  SELECT a.index AS src, b.index AS dst, rel FROM link JOIN nodes a ON source = a.id JOIN nodes b ON target = b.id JOIN kinds USING (relation)""")
def dense_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by the numbers of their ends and relation; those to a mode or observation that is not there go."""
    obs = V.observations(spark, sf_dir)
    source = F.concat(F.lit("observation:"), "observation_id").alias("source")
    shows = obs.select(source, F.lit("SHOWS_MODE").alias("relation"), F.concat(F.lit("mode:"), F.col("series_id") % 30, F.lit(":"), F.col("code") + 1).alias("target"))
    follows = obs.select(source, F.lit("NEXT").alias("relation"), F.concat(F.lit("observation:"), F.col("observation_id") + 1).alias("target"))
    uses = V.carriers(spark, sf_dir).join(F.broadcast(V.modes(spark, sf_dir)), "radar_id").select(F.col("carrier_id").alias("source"), F.lit("USES_RADAR_WITH").alias("relation"), F.col("mode_id").alias("target"))
    return S.resolve(shows.unionByName(follows).unionByName(uses), S.dense_index(nodes(spark, sf_dir), "id"))


@query("""WITH names AS (SELECT unnest(['c_acctbal', 'c_nationkey', 'k', 'p_retailprice', 'p_size']) AS feature),
  n AS (SELECT 'customer:' || c_custkey AS id, c_acctbal::DOUBLE AS a, c_nationkey::DOUBLE AS b, NULL::DOUBLE AS k, NULL::DOUBLE AS c, NULL::DOUBLE AS d FROM customer
    UNION ALL SELECT 'part:' || p_partkey, NULL, NULL, NULL, p_retailprice::DOUBLE, p_size::DOUBLE FROM part UNION ALL SELECT 'event:' || event_id, NULL, NULL, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), NULL, NULL FROM events)
  SELECT id, feature, round(coalesce(CASE feature WHEN 'c_acctbal' THEN a WHEN 'c_nationkey' THEN b WHEN 'k' THEN k WHEN 'p_retailprice' THEN c ELSE d END, 0) + 1e-9, 6) AS value FROM n, names""")
def mixed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One matrix over customers, parts and events: the sorted names of all their numeric properties, 0 where a node has none."""
    def kind(table: str, key: str, prefix: str, text) -> DataFrame:
        return V.table(spark, sf_dir, table).select(F.concat(F.lit(prefix), F.col(key)).alias("id"), S.numeric_properties(text).alias("properties"))

    kinds = [
        kind("customer", "c_custkey", "customer:", F.to_json(F.struct("c_acctbal", "c_nationkey", "c_mktsegment"))),
        kind("part", "p_partkey", "part:", F.to_json(F.struct("p_size", "p_retailprice", "p_brand"))),
        kind("events", "event_id", "event:", F.col("props")),
    ]
    names = S.feature_names(kinds)
    matrix = S.feature_matrix(kinds, names)
    named = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("feature"), F.col("x").alias("value"))
    return matrix.select("id", F.explode(named).alias("c")).select("id", "c.feature", F.round(F.col("c.value") + 1e-9, 6).alias("value"))
