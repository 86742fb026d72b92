"""Queries over the knowledge graph: sources, keys, paths, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.functions import scores as S
from credence.operators import tables
from credence.plans import twins as T
from credence.plans.registry import query
from credence.sources import views as V


@query("""SELECT p_partkey, round(p_retailprice * 0.9 + 1e-9, 6) AS lo, round(p_retailprice * 1.1 + 1e-9, 6) AS hi,
  round(greatest(p_size * 0.98, 2.0) + 1e-9, 6) AS size_lo, round(least(p_size * 1.02, 45.0) + 1e-9, 6) AS size_hi FROM part""")
def numeric_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = V.table(spark, sf_dir, "part")
    lo, hi = S.numeric_range(F.col("p_retailprice"))
    slo, shi = S.numeric_range(F.col("p_size").cast("double"), 0.02, 2.0, 45.0)
    return part.select("p_partkey", S.r6(lo).alias("lo"), S.r6(hi).alias("hi"), S.r6(slo).alias("size_lo"), S.r6(shi).alias("size_hi"))


@query(f"WITH {T.MODES} SELECT mode_id, radar_id, mode_name, mode_index, center, klo, khi, k_klo, k_khi, mode_code FROM modes")
def mode_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.modes(spark, sf_dir).drop("nation")


@query(f"SELECT p_partkey, 'part:' || {T.slug('p_name')} || ':' || {T.slug('p_brand')} AS id FROM part")
def slug_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = V.table(spark, sf_dir, "part")
    return part.select("p_partkey", F.concat(F.lit("part:"), S.slug(F.col("p_name")), F.lit(":"), S.slug(F.col("p_brand"))).alias("id"))


@query(f"WITH {T.KG} SELECT mode_id, radar_id, carrier_id, operator, uses_radar FROM kg")
def kg_candidate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.candidate_rows(spark, sf_dir).select("mode_id", "radar_id", "carrier_id", "operator", "uses_radar")


@query(f"""WITH {T.KG} SELECT o.operator, c.carrier_id, c.radar_id, m.mode_id FROM operates o JOIN carriers c ON o.carrier_id = c.carrier_id
  JOIN modes m ON m.radar_id = c.radar_id ORDER BY 1, 2, 3, 4 LIMIT 20""")
def kg_path_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator to carrier to radar to mode; the first 20 paths by name."""
    path = V.operates(spark, sf_dir).drop("nation").join(V.carriers(spark, sf_dir).select("carrier_id", "radar_id"), "carrier_id")
    path = path.join(F.broadcast(V.modes(spark, sf_dir).select("radar_id", "mode_id")), "radar_id")
    return path.orderBy("operator", "carrier_id", "radar_id", "mode_id").limit(20).select("operator", "carrier_id", "radar_id", "mode_id")


def triple_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = V.table(spark, sf_dir, "nation")
    carriers = V.carriers(spark, sf_dir)
    rel = lambda df, s, r, t: df.select(F.col(s).alias("source"), F.lit(r).alias("relation"), F.col(t).alias("target"))
    variant = nation.select(F.concat(F.lit("radar:"), "n_nationkey").alias("s"), F.concat(F.lit("region:"), "n_regionkey").alias("t"))
    stock = V.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("supplier:"), "l_suppkey").alias("s"), F.concat(F.lit("part:"), "l_partkey").alias("t")
    )
    return (
        rel(V.modes(spark, sf_dir), "radar_id", "HAS_MODE", "mode_id")
        .unionByName(rel(carriers, "carrier_id", "USES_RADAR", "radar_id"))
        .unionByName(rel(variant, "s", "VARIANT_OF", "t"))
        .unionByName(rel(V.operates(spark, sf_dir), "operator", "OPERATES", "carrier_id"))
        .unionByName(rel(stock, "s", "SUPPLIES", "t"))
    )


_TRIPLES = f"""WITH {T.KG}, triples AS (SELECT radar_id AS source, 'HAS_MODE' AS relation, mode_id AS target FROM modes
  UNION ALL SELECT carrier_id, 'USES_RADAR', radar_id FROM carriers
  UNION ALL SELECT 'radar:' || n_nationkey, 'VARIANT_OF', 'region:' || n_regionkey FROM nation
  UNION ALL SELECT operator, 'OPERATES', carrier_id FROM operates
  UNION ALL SELECT 'supplier:' || l_suppkey, 'SUPPLIES', 'part:' || l_partkey FROM lineitem)"""


@query(_TRIPLES + " SELECT DISTINCT source, relation, target FROM triples")
def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges as a set: each triple once."""
    return triple_rows(spark, sf_dir).dropDuplicates(["source", "relation", "target"])


@query(_TRIPLES + """, e AS (SELECT DISTINCT source, relation, target FROM triples)
  SELECT 'edge' AS kind, relation AS name, count(*) AS n FROM e GROUP BY relation
  UNION ALL SELECT 'node', split_part(id, ':', 1), count(*) FROM (SELECT source AS id FROM e UNION SELECT target FROM e) GROUP BY 2""")
def node_edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by relation and nodes by namespace."""
    edge = triples(spark, sf_dir)
    node = edge.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return (
        edge.groupBy(F.col("relation").alias("name")).count().select(F.lit("edge").alias("kind"), "name", F.col("count").alias("n"))
        .unionByName(node.groupBy(F.substring_index("id", ":", 1).alias("name")).count().select(F.lit("node").alias("kind"), "name", F.col("count").alias("n")))
    )


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_acctbal >= 2500 ORDER BY s_acctbal DESC, s_name")
def high_value_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "supplier").where("s_acctbal >= 2500")
    return rows.orderBy(F.desc("s_acctbal"), "s_name").select("s_suppkey", "s_name", "s_acctbal")


@query("""SELECT id, origin, value FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY origin) AS r FROM (
  SELECT s_suppkey AS id, 1 AS origin, s_acctbal AS value FROM supplier UNION ALL SELECT c_custkey, 2, c_acctbal FROM customer
  UNION ALL SELECT p_partkey, 3, p_retailprice FROM part)) WHERE r = 1""")
def keyed_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of three tables by id; an id is set by the first table that has it."""
    pick = lambda t, k, n, v: V.table(spark, sf_dir, t).select(F.col(k).alias("id"), F.lit(n).alias("origin"), F.col(v).alias("value"))
    rows = pick("supplier", "s_suppkey", 1, "s_acctbal").unionByName(pick("customer", "c_custkey", 2, "c_acctbal")).unionByName(pick("part", "p_partkey", 3, "p_retailprice"))
    return tables.first_wins(rows, "id", "origin")


@query("""WITH u AS (SELECT o_custkey AS c_custkey, max(o_totalprice) AS c_acctbal, count(*) AS n_orders FROM orders GROUP BY o_custkey HAVING count(*) >= 8)
  SELECT c_custkey, c.c_name, CASE WHEN u.n_orders IS NOT NULL THEN u.c_acctbal ELSE c.c_acctbal END AS c_acctbal, u.n_orders FROM customer c
  FULL JOIN (SELECT c_custkey, CASE WHEN n_orders % 2 = 0 THEN c_acctbal END AS c_acctbal, n_orders FROM u) u USING (c_custkey)""")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers merged with rows from their orders: a given column wins, and a null in it removes the old value."""
    base = V.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = V.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max("o_totalprice").alias("c_acctbal"), F.count("*").alias("n_orders")
    )
    new = new.where("n_orders >= 8").withColumn("c_acctbal", F.when(F.col("n_orders") % 2 == 0, F.col("c_acctbal")))
    return tables.upsert(base, new, "c_custkey")


@query("""SELECT source, type, target, max(stamp) AS stamp, arg_max(score, (stamp, score)) AS score FROM (
  SELECT l_suppkey AS source, l_returnflag AS type, l_partkey AS target, l_shipdate AS stamp, l_quantity AS score FROM lineitem)
  WHERE source IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND target IN (SELECT p_partkey FROM part WHERE p_size > 10) GROUP BY ALL""")
def upsert_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between known ends; the latest line item sets an edge's properties."""
    item = V.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("source"), F.col("l_returnflag").alias("type"), F.col("l_partkey").alias("target"),
        F.col("l_shipdate").alias("stamp"), F.col("l_quantity").alias("score"),
    )
    sources = V.table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("source"))
    targets = V.table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("target"))
    return tables.upsert_edges(item, sources, targets, ["stamp", "score"])


@query("SELECT user_id AS id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 1")
def uniqueness_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.duplicates(V.table(spark, sf_dir, "events"), "user_id").select(F.col("user_id").alias("id"), F.col("count").alias("n"))


@query("""SELECT 'supplier' AS label, id FROM (SELECT DISTINCT l_suppkey AS id FROM lineitem) WHERE id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)
  UNION ALL SELECT 'document', doc_id FROM (SELECT DISTINCT doc_id FROM documents) WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def fk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that no key of the other table resolves."""
    rich = V.table(spark, sf_dir, "supplier").where("s_acctbal > 5000")
    a = tables.missing_links(V.table(spark, sf_dir, "lineitem"), "l_suppkey", rich, "s_suppkey").select(F.lit("supplier").alias("label"), "id")
    b = tables.missing_links(V.table(spark, sf_dir, "documents"), "doc_id", V.table(spark, sf_dir, "labels"), "doc_id")
    return a.unionByName(b.select(F.lit("document").alias("label"), "id"))


@query("""WITH n AS (SELECT p_partkey, string_split(regexp_replace(lower(split_part(p_type, ' ', 1) || '-' || p_size || '/' || p_name), '[/ _-]+', '_', 'g'), '_') AS t FROM part),
  d AS (SELECT *, regexp_replace(t[2], '[^0-9]', '', 'g') AS digits FROM n)
  SELECT p_partkey, CASE WHEN regexp_full_match(t[1], '[a-z]+') AND regexp_full_match(t[2], '[a-z0-9]+') AND digits <> '' THEN t[1] || '-' || digits ELSE t[1] END AS type_key FROM d""")
def type_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of names such as "part:large-12/blue": letters and the number after them."""
    part = V.table(spark, sf_dir, "part")
    name = F.concat(F.lit("part:"), F.substring_index("p_type", " ", 1), F.lit("-"), "p_size", F.lit("/"), "p_name")
    return part.select("p_partkey", S.type_key(name).alias("type_key"))


@query("""WITH t AS (SELECT p_partkey - 1 AS pos, p_type FROM part), g AS (SELECT p_type, min(pos) AS first_pos, count(*) AS members FROM t GROUP BY p_type HAVING count(*) >= 2)
  SELECT p_type, first_pos, members, row_number() OVER (ORDER BY first_pos) AS group_no FROM g""")
def grouped_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types that two or more hypotheses share, by first member: the focal sets that a compact frame adds."""
    from pyspark.sql import Window

    groups = V.table(spark, sf_dir, "part").groupBy("p_type").agg(F.min(F.col("p_partkey") - 1).alias("first_pos"), F.count("*").alias("members"))
    # As many rows as types; the frame's order needs one sequence.
    return groups.where("members >= 2").withColumn("group_no", F.row_number().over(Window.orderBy("first_pos")).cast("long"))


@query("""SELECT count(d.doc_id) AS documents, count(l.doc_id) AS aligned, count(*) - count(l.doc_id) AS missing, count(d.doc_id) - count(DISTINCT d.doc_id) AS duplicates
  FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id""")
def target_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets aligned to nodes by id: how many have one, how many lack it, and ids that stand twice."""
    labels = V.table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("there", F.lit(1))
    joined = V.table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left")
    n = joined.groupBy("doc_id").agg(F.count("*").alias("n"), F.count("there").alias("k"))
    return n.agg(
        F.sum("n").alias("documents"), F.sum("k").alias("aligned"), F.sum(F.col("n") - F.col("k")).alias("missing"), F.sum(F.col("n") - 1).alias("duplicates")
    )


@query("SELECT o_custkey AS series_id, count(DISTINCT (o_orderstatus, o_orderpriority)) AS strata FROM orders GROUP BY 1 HAVING count(DISTINCT (o_orderstatus, o_orderpriority)) <> 1")
def strata_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that do not lie in exactly one stratum."""
    n = F.countDistinct(F.struct("o_orderstatus", "o_orderpriority"))
    return V.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("series_id")).agg(n.alias("strata")).where("strata <> 1")


@query("""SELECT l_orderkey::DOUBLE AS "r.key", coalesce(CASE WHEN l_discount > 0.05 THEN l_discount END, 0)::DOUBLE AS "r.deep.discount", l_tax AS "r.deep.tax" FROM lineitem""")
def numeric_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric fields at any depth under dotted names; text and truth values are left out, null reads as 0."""
    from credence.operators.temporal import flatten_numeric

    item = V.table(spark, sf_dir, "lineitem")
    deep = F.struct(F.when(F.col("l_discount") > 0.05, F.col("l_discount")).alias("discount"), F.col("l_tax").alias("tax"), (F.col("l_tax") > 0).alias("taxed"))
    return flatten_numeric(item.select(F.struct(F.col("l_orderkey").alias("key"), deep.alias("deep"), F.col("l_returnflag").alias("flag")).alias("r")))
