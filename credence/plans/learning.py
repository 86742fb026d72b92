"""Queries that make features, splits, messages, losses and predictions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credence.functions import masses as M
from credence.functions.scores import r6
from credence.operators import etl, generate
from credence.operators import gnn
from credence.operators import graph as G
from credence.plans import ingest as I
from credence.plans import twins as T
from credence.plans.evidence import _masses_sql, masses
from credence.plans.registry import query
from credence.sources import views as V

N = 64  # entries of a vector
WIDTH = 3
SLICE = 1000  # of the range of a seeded order, 1,000,003 numbers wide
#: Fixed weights of the layers that queries evaluate, by rule.
BASES = [[[((7 * i + 3 * j + 5 * b) % 11 - 5) / 10 for j in range(WIDTH)] for i in range(N)] for b in range(2)]
MIX = [[1.0, 0.5], [-0.5, 1.0], [0.25, 0.75]]
GATES = [1.0, 0.5, 0.8]
WEIGHTS = [[[round(c, 6) for c in row] for row in w] for w in G.matrices(BASES, MIX)]
OWN = [[((5 * i + 2 * j) % 7 - 3) / 10 for j in range(WIDTH)] for i in range(N)]
BIAS = [0.1, -0.1, 0.05]
Q, K, VAL = ([[((a * i + c * j) % 9 - 4) / 10 for j in range(WIDTH)] for i in range(N)] for a, c in ((2, 5), (4, 7), (8, 1)))
PRIOR = [1.0, 0.8, 1.2]


def _d(x: float) -> str:
    return f"({x!r}::DOUBLE)"


def _rel(values: list[float]) -> str:
    return "CASE rel " + " ".join(f"WHEN {r} THEN {_d(v)}" for r, v in enumerate(values)) + " END"


def _mean_out(prefix: str, width: int) -> list:
    return [r6(F.element_at("m", j + 1)).alias(f"{prefix}{j}") for j in range(width)]


_Z = ", ".join(f"round((x[{i}] - avg(x[{i}]) OVER ()) / coalesce(nullif(stddev_pop(x[{i}]) OVER (), 0), 1), 4) + 0.0 AS z{i}" for i in range(1, N + 1))


@query(f"WITH {T.VECS} SELECT node_id, {_Z} FROM vecs")
def zscore_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries less their mean over their deviation; a deviation of 0 counts as 1. One row of statistics is broadcast."""
    rows = V.vectors(spark, sf_dir)
    stats = rows.agg(*[f(F.element_at("x", i)).alias(f"{n}{i}") for i in range(1, N + 1) for f, n in ((F.avg, "a"), (F.stddev_pop, "s"))])
    z = [(F.element_at("x", i) - F.col(f"a{i}")) / F.when(F.col(f"s{i}") == 0, 1.0).otherwise(F.col(f"s{i}")) for i in range(1, N + 1)]
    return rows.crossJoin(F.broadcast(stats)).select("node_id", *[(F.round(c, 4) + 0.0).alias(f"z{i + 1}") for i, c in enumerate(z)])


@query("""SELECT e.event_id, v.event_type AS category, (e.event_type = v.event_type)::INT AS hot FROM events e, (SELECT DISTINCT event_type FROM events) v""")
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 0/1 entry for each category; the vocabulary has as many rows as there are event types."""
    rows = V.table(spark, sf_dir, "events").select("event_id", "event_type")
    vocabulary = rows.select(F.col("event_type").alias("category")).distinct()
    return rows.crossJoin(F.broadcast(vocabulary)).select("event_id", "category", (F.col("event_type") == F.col("category")).cast("int").alias("hot"))


@query("""WITH v AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS i FROM (SELECT DISTINCT CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS c FROM customer) WHERE c IS NOT NULL)
  SELECT c_custkey, coalesce(i, -1) AS class_index FROM customer LEFT JOIN v ON c = c_mktsegment AND c_acctbal >= 0""")
def class_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels to indexes of the sorted vocabulary; a missing label is -1."""
    rows = V.table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("class"))
    return rows.join(F.broadcast(G.vocabulary(rows, "class")), "class", "left").select("c_custkey", F.coalesce("index", F.lit(-1)).alias("class_index"))


@query("SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE list_contains(['en', 'de'], lang) AND toxic IS NOT NULL AND quality IS NOT NULL AND len(string_split(text, ' ')) > 0")
def supervised_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with all labels that they need and something to learn from."""
    docs, labels = V.table(spark, sf_dir, "documents"), V.table(spark, sf_dir, "labels")
    required = F.size(F.array_except(F.array("lang"), F.array(F.lit("en"), F.lit("de")))) == 0
    kept = docs.where(required & (F.size(F.split("text", " ")) > 0)).select("doc_id")
    return kept.join(labels.where("toxic is not null and quality is not null").select("doc_id"), "doc_id")


def _shuffled(c):
    return F.pmod(c * 7919 + 104729, F.lit(1_000_003))


_SPLIT = """CASE WHEN ((({g}) * 7919 + 104729) % 1000003) % 1000 < 700 THEN 'train' WHEN ((({g}) * 7919 + 104729) % 1000003) % 1000 < 850 THEN 'test' ELSE 'val' END"""


@query(f"SELECT event_id, user_id, {_SPLIT.format(g='user_id')} AS split FROM events")
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events of a user in one split."""
    return G.grouped_split(V.table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", 0.7, 0.15, _shuffled)


_STRAT = """sp AS (SELECT vec_id AS node_id, label, CASE WHEN p <= floor(n * 0.7::DOUBLE + 0.5) THEN 'train' WHEN p <= floor(n * 0.7::DOUBLE + 0.5) + floor(n * 0.15::DOUBLE + 0.5) THEN 'test' ELSE 'val' END AS split FROM (
  SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY (vec_id * 7919 + 104729) % 1000003, vec_id) AS p, count(*) OVER (PARTITION BY label) AS n FROM embeddings))"""


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.vectors(spark, sf_dir).select("node_id", "label")
    return G.stratified_split(rows, "label", 0.7, 0.15, _shuffled(F.col("node_id")), [F.col("node_id")], SLICE)


@query(f"WITH {_STRAT} SELECT * FROM sp")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits(spark, sf_dir)


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY (o_orderkey * 7919 + 104729) % 1000003, o_orderkey) AS place FROM orders")
def deterministic_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in a seeded order within batches by priority."""
    rows = V.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    placed = G.places(rows, "o_orderpriority", _shuffled(F.col("o_orderkey")), [F.col("o_orderkey")], SLICE)
    return placed.select("o_orderkey", F.col("__p").alias("place"))


@query(f"""WITH {T.EDGES}, {_STRAT}, kept AS (SELECT e.* FROM edges e LEFT JOIN sp a ON a.node_id = src LEFT JOIN sp b ON b.node_id = dst WHERE rel <> 1 AND (a.split IS NULL OR b.split IS NULL OR a.split = b.split))
  SELECT src, dst, dense_rank() OVER (ORDER BY rel) - 1 AS new_rel FROM kept""")
def edge_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without one relation and without edges across splits; relations numbered anew."""
    return G.filter_edges(V.edges(spark, sf_dir), splits(spark, sf_dir), [1])


@query(f"WITH {T.EDGES} SELECT vec_id AS node_id, greatest(count(src), 1) AS degree FROM embeddings LEFT JOIN edges ON dst = vec_id GROUP BY vec_id")
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inbound edges over all relations, 1 at least."""
    n = V.edges(spark, sf_dir).groupBy(F.col("dst").alias("node_id")).count()
    return V.vectors(spark, sf_dir).select("node_id").join(n, "node_id", "left").select("node_id", F.greatest(F.coalesce("count", F.lit(1)), F.lit(1)).alias("degree"))


@query(f"""WITH {T.EDGES}, capped AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY rel, src) AS p FROM edges)
  SELECT rel, count(*) AS edges, sum((p <= 2)::INT) AS sampled, 2 * sum((p <= 2)::INT) + count(*) AS edge_work FROM capped GROUP BY rel""")
def relation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by relation, those within the fan-out, and the edge work of two sampled layers and a full one."""
    place = F.row_number().over(Window.partitionBy("dst").orderBy("rel", "src"))
    kept = F.sum((F.col("p") <= 2).cast("int"))
    return V.edges(spark, sf_dir).withColumn("p", place).groupBy("rel").agg(
        F.count("*").alias("edges"), kept.alias("sampled"), (2 * kept + F.count("*")).alias("edge_work")
    )


@query(f"WITH {T.EDGES} SELECT src, dst, rel FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY rel, src) AS p FROM edges) WHERE p <= 2")
def fanout_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.fan_out(V.edges(spark, sf_dir), 2)


@query(f"""WITH {T.VECS}, {T.EDGES}, capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY rel, src) AS p FROM edges) WHERE p <= 2)
  SELECT dst AS node_id, {', '.join(f'round(sum(x[{j + 1}]) / count(*) + 1e-9, 6) AS m{j}' for j in range(N))} FROM capped JOIN vecs ON src = node_id GROUP BY dst""")
def sage_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the capped neighbours' vectors."""
    rows = G.with_source(G.fan_out(V.edges(spark, sf_dir), 2), V.vectors(spark, sf_dir))
    return G.vector_mean(rows, "dst", G.entries("x", N)).select(F.col("dst").alias("node_id"), *_mean_out("m", N))


_MSG = ", ".join(
    "sum(" + " + ".join(f"x[{i + 1}] * ({_rel([w[i][j] * g for w, g in zip(WEIGHTS, GATES, strict=True)])})" for i in range(N)) + f") / count(*) AS m{j}" for j in range(WIDTH)
)
_SELF = ", ".join(
    f"round({_d(BIAS[j])} + coalesce(m{j}, 0) + " + " + ".join(f"x[{i + 1}] * {_d(OWN[i][j])}" for i in range(N)) + f" + 1e-9, 6) AS h{j}" for j in range(WIDTH)
)


@query(f"WITH {T.VECS}, {T.EDGES}, msg AS (SELECT dst, {_MSG} FROM edges JOIN vecs ON src = node_id GROUP BY dst) SELECT node_id, {_SELF} FROM vecs LEFT JOIN msg ON dst = node_id")
def rgcn_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One relational layer with basis-shared matrices and gates."""
    out = G.relational_layer(V.vectors(spark, sf_dir).select("node_id", "x"), V.edges(spark, sf_dir), WEIGHTS, OWN, GATES, BIAS)
    return out.select("node_id", *[r6(F.element_at("x", j + 1)).alias(f"h{j}") for j in range(WIDTH)])


def _project(x: str, w: list, j: int) -> str:
    return "(" + " + ".join(f"{x}[{i + 1}] * {_d(w[i][j])}" for i in range(N)) + ")"


_GATE = " + ".join(f"{_project('t.x', Q, j)} * {_project('s.x', K, j)}" for j in range(WIDTH))


@query(f"""WITH {T.VECS}, {T.EDGES}, g AS (SELECT dst, 1 / (1 + exp(-(({_GATE}) * ({_rel(PRIOR)}) / sqrt({WIDTH}::DOUBLE)))) AS gate, {', '.join(f'{_project("s.x", VAL, j)} AS v{j}' for j in range(WIDTH))}
  FROM edges JOIN vecs s ON src = s.node_id JOIN vecs t ON dst = t.node_id)
  SELECT dst AS node_id, {', '.join(f'round(sum(gate * v{j}) / count(*) + 1e-9, 6) AS m{j}' for j in range(WIDTH))} FROM g GROUP BY dst""")
def hgt_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of values under a sigmoid gate for each edge and relation."""
    out = G.gated_mean(V.vectors(spark, sf_dir).select("node_id", "x"), V.edges(spark, sf_dir), Q, K, VAL, PRIOR)
    return out.select(F.col("dst").alias("node_id"), *_mean_out("m", WIDTH))


_P10 = "list_transform(x[1:10], lambda v: exp(v - list_max(x[1:10])))"
_SOFT = f"soft AS (SELECT node_id, label, list_transform(p, lambda v: v / list_sum(p)) AS p FROM (SELECT node_id, label, {_P10} AS p FROM vecs))"


def soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.vectors(spark, sf_dir).select("node_id", "label", M.softmax(F.slice("x", 1, 10)).alias("p"))


@query(f"""WITH {T.VECS}, {_masses_sql(3, 't')}, {_SOFT}, r AS (SELECT node_id, p[1] + p[4] + p[7] + p[10] AS p1, p[2] + p[5] + p[8] AS p2, p[3] + p[6] + p[9] AS p3 FROM soft)
  SELECT round(sum({' + '.join(f'CASE WHEN t{i} > 0 THEN t{i} * (ln(t{i}) - ln(greatest(p{i}, 1e-9))) ELSE 0 END' for i in (1, 2, 3))}) / count(*), 4) AS kl FROM ts JOIN r USING (node_id)""")
def kl_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of predicted masses from targets, mean over rows."""
    p = F.col("p")
    folded = F.array(p[0] + p[3] + p[6] + p[9], p[1] + p[4] + p[7], p[2] + p[5] + p[8])
    rows = masses(spark, sf_dir, 3).select("node_id", "m").join(soft(spark, sf_dir).select("node_id", folded.alias("q")), "node_id")
    return rows.agg(F.round(F.sum(M.kl_divergence(F.col("m"), F.col("q"))) / F.count("*"), 4).alias("kl"))


@query(f"""WITH {T.VECS}, {_SOFT}, l AS (SELECT CASE WHEN node_id % 7 = 0 THEN -1 ELSE label END AS y, p FROM soft)
  SELECT round(avg(-(0.9::DOUBLE * ln(p[y + 1]) + 0.1::DOUBLE * list_sum(list_transform(p, lambda v: ln(v))) / 10)), 4) AS loss, count(*) AS rows FROM l WHERE y >= 0""")
def cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed cross entropy over rows with a label; -1 marks a missing one."""
    rows = soft(spark, sf_dir).withColumn("y", F.when(F.col("node_id") % 7 == 0, -1).otherwise(F.col("label"))).where("y >= 0")
    rest = M.vec_sum(F.transform("p", lambda v: F.log(v))) / 10
    loss = -(0.9 * F.log(F.element_at("p", F.col("y") + 1)) + 0.1 * rest)
    return rows.agg(F.round(F.avg(loss), 4).alias("loss"), F.count("*").alias("rows"))


@query(f"WITH {T.VECS}, {_SOFT} SELECT round(avg(list_sum(list_transform(p, lambda v: -v * ln(greatest(v, 1e-9))))), 4) AS entropy FROM soft")
def entropy_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return soft(spark, sf_dir).agg(F.round(F.avg(M.entropy(F.col("p"))), 4).alias("entropy"))


@query(f"""WITH {T.VECS}, {_SOFT}, {_STRAT} SELECT split, count(*) AS rows, round(avg((list_position(p, list_max(p)) - 1 = soft.label)::INT::DOUBLE), 6) AS accuracy FROM soft JOIN sp USING (node_id) GROUP BY split""")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of right classes by split."""
    rows = soft(spark, sf_dir).select("node_id", "label", "p").join(splits(spark, sf_dir).select("node_id", "split"), "node_id")
    return rows.groupBy("split").agg(F.count("*").alias("rows"), F.round(F.avg((M.argmax(F.col("p")) == F.col("label")).cast("double")), 6).alias("accuracy"))


@query(f"WITH {T.VECS}, {_SOFT} SELECT node_id, label, list_position(p, list_max(p)) - 1 AS predicted, round(list_max(p) + 1e-9, 6) AS confidence FROM soft")
def argmax_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return soft(spark, sf_dir).select("node_id", "label", M.argmax(F.col("p")).alias("predicted"), r6(F.array_max("p")).alias("confidence"))


@query("""SELECT task, classes, label, n FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY n DESC, label) AS r, count(*) OVER (PARTITION BY task) AS classes FROM (
  SELECT 'segment' AS task, c_mktsegment AS label, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'brand', p_brand, count(*) FROM part GROUP BY 2
  UNION ALL SELECT 'lang', lang, count(*) FROM documents GROUP BY 2)) WHERE r <= 3""")
def class_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of each task and the three most frequent ones."""
    rows = None
    for task, table, col in (("segment", "customer", "c_mktsegment"), ("brand", "part", "p_brand"), ("lang", "documents", "lang")):
        n = V.table(spark, sf_dir, table).groupBy(F.col(col).alias("label")).count().select(F.lit(task).alias("task"), "label", F.col("count").alias("n"))
        rows = n if rows is None else rows.unionByName(n)
    w = Window.partitionBy("task")
    ranked = rows.withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "label"))).withColumn("classes", F.count("*").over(w))
    return ranked.where("r <= 3").select("task", "classes", "label", "n")


def carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The carriers of the views as a catalogue for the generators; segments stand for kinds and families."""
    low, high = (F.array(*[F.coalesce(f"{e}{i}", F.lit(1.0 + i)) for i in range(etl.N)]).alias(n) for e, n in (("klo", "lo"), ("khi", "hi")))
    names = V.modes(spark, sf_dir).select("mode_id", "mode_name")
    bounds = I.mode_bounds(V.modes(spark, sf_dir)).join(names, "mode_id").select(
        "radar_id", F.struct("mode_id", F.col("mode_name").alias("mode"), F.col("mode_waveform").cast("string").alias("waveform"), F.col("mode_scan").cast("string").alias("scan"), low, high).alias("m")
    )
    modes = bounds.groupBy("radar_id").agg(F.array_sort(F.collect_list("m")).alias("modes"))
    operators = V.operates(spark, sf_dir).groupBy("carrier_id").agg(F.array_sort(F.collect_set("operator")).alias("operators"))
    own = V.carriers(spark, sf_dir).join(F.broadcast(modes), "radar_id").join(F.broadcast(operators), "carrier_id")
    kind = F.when(F.col("variant") == "MACHINERY", "rotary").when(F.col("variant") == "BUILDING", "bomber").otherwise("other")
    return own.select(
        F.col("carrier_id").alias("aircraft_id"), "variant", F.col("variant").alias("family"), "radar_id", F.col("radar_id").alias("radar"), kind.alias("kind"),
        (F.col("speed_limit") / 4).alias("vmax"), (F.abs("ceiling") + 9000).alias("ceiling"), "operators", "modes",
    )


def _u(seed: int, name: str, *keys: str) -> str:
    """The generators' draw in DuckDB."""
    return f"(('0x' || substr(md5(concat_ws(':', '{seed}', '{name}', {', '.join(keys)})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


_CATALOGUE = f"""{T.KG}, {I._MODES9}, ml AS (SELECT radar_id, list(struct_pack(mode_id := mode_id, mode := mode_name, lo := [{", ".join(f"coalesce(klo{i}, {1.0 + i})" for i in range(etl.N))}],
    hi := [{", ".join(f"coalesce(khi{i}, {1.0 + i})" for i in range(etl.N))}]) ORDER BY mode_id) AS modes FROM modes9 GROUP BY radar_id),
  ol AS (SELECT carrier_id, list(DISTINCT operator ORDER BY operator) AS operators FROM operates GROUP BY carrier_id),
  cat AS (SELECT list(struct_pack(aircraft_id := c.carrier_id, variant := c.variant, radar_id := c.radar_id, kind := CASE c.variant WHEN 'MACHINERY' THEN 'rotary' WHEN 'BUILDING' THEN 'bomber' ELSE 'other' END,
    vmax := c.speed_limit / 4, ceiling := abs(c.ceiling) + 9000, operators := operators, modes := modes) ORDER BY c.carrier_id) AS al FROM carriers c JOIN ml USING (radar_id) JOIN ol USING (carrier_id))"""
_GENERATED = f"""{_CATALOGUE}, drawn AS (SELECT n, al[1 + floor(@carrier * len(al))::INT] AS own FROM range(1, @count + 1) r(n), cat),
  chosen AS (SELECT n, own, own.operators[1 + floor(@operator * len(own.operators))::INT] AS operator, own.modes[1 + floor(@mode * len(own.modes))::INT] AS mode FROM drawn)"""
COUNT = 5000


def _generated(count: int) -> str:
    out = _GENERATED.replace("@count", str(count))
    for k in ("carrier", "operator", "mode"):
        out = out.replace(f"@{k}", _u(7, k, "n"))
    return out


def _between(low: str, high: str, name: str) -> str:
    return f"({low} + ({high} - {low}) * {_u(7, name, 'n')})"


_SPEED = f"""CASE own.kind WHEN 'rotary' THEN {_between("120.0", "least(own.vmax, 310.0)", "speed")} WHEN 'bomber' THEN {_between("650.0", "least(own.vmax * 0.9::DOUBLE, 1050.0)", "speed")}
  ELSE {_between("450.0", "least(own.vmax * 0.85::DOUBLE, 1450.0)", "speed")} END"""
_ALTITUDE = f"""CASE own.kind WHEN 'rotary' THEN {_between("100.0", "least(own.ceiling * 0.75::DOUBLE, 4500.0)", "altitude")} WHEN 'bomber' THEN {_between("7000.0", "own.ceiling * 0.9::DOUBLE", "altitude")}
  ELSE {_between("1500.0", "own.ceiling * 0.9::DOUBLE", "altitude")} END"""


@query(f"""WITH {_generated(COUNT)} SELECT 'esm_obs_' || lpad(n::VARCHAR, 5, '0') AS observation_id, own.aircraft_id AS aircraft_id, operator, mode.mode_id AS mode_id,
  {", ".join(f"round({_between(f'mode.lo[{i + 1}]', f'mode.hi[{i + 1}]', f'm{i}')} + 1e-9, 6) AS v{i}" for i in range(etl.N))},
  round({_SPEED} + 1e-9, 1) AS speed, round({_ALTITUDE} + 1e-9, 1) AS altitude, {generate.START}::DOUBLE + floor({_u(7, "time", "n")} * {generate.END - generate.START}) AS at FROM chosen""")
def generate_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic observations with their truth, drawn in the bounds of the modes."""
    rows = generate.observations(spark, carriers(spark, sf_dir), COUNT, seed=7)
    label, kin = "ground_truth_label", "approximate_kinematics"
    values = [F.col(f"esm_radar_parameters.{name}.value").alias(f"v{i}") for i, (name, *_) in enumerate(etl.MEASURES)]
    return rows.select(
        "observation_id", f"{label}.aircraft_id", f"{label}.operator", f"{label}.mode_id", *values, F.col(f"{kin}.ground_speed_kph").alias("speed"), F.col(f"{kin}.altitude_m").alias("altitude"),
        F.col("timestamp_unix").alias("at"),
    )


_T = lambda name, *keys: _u(42, name, *(keys or ("n", "i")))
_N = lambda name: f"(sqrt(-2 * ln(1 - {_T(name + '_radius')})) * cos({2 * math.pi!r}::DOUBLE * {_T(name + '_angle')}))"
_SPAN = lambda low, high, u: f"({low}::DOUBLE + ({high}::DOUBLE - ({low}::DOUBLE)) * {u})"
_AREA = "[" + ", ".join(f"struct_pack(lat := {lat}::DOUBLE, lon := {lon}::DOUBLE)" for _, lat, lon in generate.AREAS) + "]"
#: Tracks and their observations; the mode of a step is the first one moved on by every switch up to it.
_TRACKS = f"""{_CATALOGUE}, t0 AS (SELECT n, al[1 + floor({_T("carrier", "n")} * len(al))::INT] AS own, {_SPAN(1.0, 60.0, _T("duration", "n"))} AS duration FROM (SELECT unnest(range(1, count(*) + 1)) AS n FROM supplier), cat),
  t1 AS (SELECT *, len(own.modes) AS m, greatest(2, round(duration / 0.5::DOUBLE)::INT + 1) AS steps, {_AREA}[1 + floor({_T("area", "n")} * {len(generate.AREAS)})::INT] AS area,
    own.operators[1 + floor({_T("operator", "n")} * len(own.operators))::INT] AS operator, {generate.START} + floor({_T("start", "n")} * greatest(1, floor({generate.END - generate.START} - duration))) AS begin_s,
    round({_SPEED} + 1e-9, 1) AS speed0, round({_ALTITUDE} + 1e-9, 1) AS altitude0, round({_SPAN(0, 360, _T("heading", "n"))} + 1e-9, 1) AS heading0 FROM t0),
  t2 AS (SELECT *, round(area.lat + {_SPAN(-1.5, 1.5, _T("lat", "n"))} + 1e-9, 6) AS lat0, round(area.lon + {_SPAN(-1.5, 1.5, _T("lon", "n"))} + 1e-9, 6) AS lon0,
    list_transform(list_sort(list_transform(list_filter(range(1, steps), lambda i: m > 1 AND {_T("switch")} < 0.03::DOUBLE), lambda i: struct_pack(u := {_T("keep")}, i := i)))[1:3], lambda x: x.i) AS shifts FROM t1),
  step AS (SELECT *, unnest(range(0, steps)) AS i FROM t2),
  s1 AS (SELECT *, own.modes[1 + (floor({_T("mode", "n")} * m)::BIGINT + coalesce(list_sum(list_transform(list_filter(shifts, lambda s: s <= i), lambda s: 1 + floor({_T("jump", "n", "s")} * (m - 1))))::BIGINT, 0)) % m] AS mode,
    greatest(0.0::DOUBLE, i * 0.5::DOUBLE + {_SPAN(-0.04, 0.04, _T("jitter"))}) AS gone FROM step),
  s2 AS (SELECT *, round(greatest(0.0::DOUBLE, speed0 + {_N("speed")} * 0.6::DOUBLE * gone) + 1e-9, 1) AS speed, round(greatest(0.0::DOUBLE, altitude0 + {_N("altitude")} * 1.8::DOUBLE * gone) + 1e-9, 1) AS altitude,
    heading0 + {_N("heading")} * 0.04::DOUBLE * gone AS turned FROM s1),
  obs AS (SELECT *, round((CASE WHEN turned % 360 < 0 THEN turned % 360 + 360 ELSE turned % 360 END) + 1e-9, 1) AS heading, 'esm_series_' || printf('%05d', n) AS series_id FROM s2)""".replace("'7', '", "'42', '")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many tracks as there are suppliers."""
    return generate.series(spark, carriers(spark, sf_dir), V.table(spark, sf_dir, "supplier").count(), seed=42, most=3)


@query(f"""WITH {_TRACKS} SELECT series_id, series_id || '_obs_' || printf('%03d', i + 1) AS observation_id, i AS sequence_index, round(gone + 1e-9, 3) AS elapsed, round((begin_s * 1000000 + round(gone * 1000000)) / 1e6, 6) AS at,
  own.aircraft_id AS aircraft_id, operator, mode.mode_id AS mode_id, {", ".join(f"round({_SPAN(f'mode.lo[{k + 1}]', f'mode.hi[{k + 1}]', _T(f'm{k}'))} + 1e-9, 6) AS v{k}" for k in range(etl.N))},
  speed, altitude, heading, round(lat0 + speed * gone / 3600 * cos(radians(heading)) / 111 + 1e-9, 6) AS latitude,
  round(lon0 + speed * gone / 3600 * sin(radians(heading)) / (111 * greatest(0.1::DOUBLE, cos(radians(lat0)))) + 1e-9, 6) AS longitude FROM obs""")
def generate_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of synthetic tracks with their truth: mode schedules, seven measurements, drifting kinematics, places that follow them."""
    kin, where, label = "approximate_kinematics", "estimated_emitter_location", "ground_truth_label"
    values = [F.col(f"esm_radar_parameters.{name}.value").alias(f"v{i}") for i, (name, *_) in enumerate(etl.MEASURES)]
    return tracks(spark, sf_dir).select(
        "series_id", "observation_id", "sequence_index", F.col("elapsed_time_s").alias("elapsed"), F.round("timestamp_unix", 6).alias("at"), f"{label}.aircraft_id", f"{label}.operator", f"{label}.mode_id", *values,
        F.col(f"{kin}.ground_speed_kph").alias("speed"), F.col(f"{kin}.altitude_m").alias("altitude"), F.col(f"{kin}.heading_deg").alias("heading"),
        F.col(f"{where}.estimated_latitude_deg").alias("latitude"), F.col(f"{where}.estimated_longitude_deg").alias("longitude"),
    )


@query(f"""WITH {_TRACKS}, seen AS (SELECT series_id, i, mode.mode_id AS mode_id, lag(mode.mode_id) OVER (PARTITION BY n ORDER BY i) AS before, round(gone + 1e-9, 3) AS gone FROM obs)
  SELECT series_id, count(*) AS observation_count, round(max(gone) - min(gone), 3) AS duration_s, coalesce(string_agg(i, ',' ORDER BY i) FILTER (i > 0 AND mode_id <> before), '') AS shifts,
  coalesce(min(i) FILTER (i > 0 AND mode_id <> before), -1) AS first_shift, CASE WHEN count(DISTINCT mode_id) > 1 THEN 'multiple' ELSE min(mode_id) END AS mode_id FROM seen GROUP BY series_id""")
def series_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the tracks: length, duration, steps at which the mode shifts, and the mode of the whole track."""
    rows = generate.series_documents(tracks(spark, sf_dir))
    return rows.select(
        "series_id", "observation_count", "duration_s", F.array_join("mode_shift_sequence_indices", ",").alias("shifts"), F.coalesce("mode_shift_sequence_index", F.lit(-1)).alias("first_shift"), "ground_truth_track_label.mode_id",
    )


_S = lambda name, key: _u(4200, name, key)


@query(f"""WITH RECURSIVE {_TRACKS}, o AS (SELECT series_id, series_id || '_obs_' || printf('%03d', i + 1) AS observation_id, i, steps FROM obs),
  dealt AS (SELECT observation_id, series_id, i, steps, CASE WHEN steps = 1 THEN left0 ELSE floor({_S("share", "observation_id")} * (left0 + 1))::BIGINT END AS n, left0 AS have FROM (SELECT *, floor({_S("budget", "series_id")} * 21)::BIGINT + 20 AS left0 FROM o WHERE i = 0)
    UNION ALL SELECT o.observation_id, o.series_id, o.i, o.steps, CASE WHEN o.i = o.steps - 1 THEN d.have - d.n ELSE floor({_S("share", "o.observation_id")} * (d.have - d.n + 1))::BIGINT END, d.have - d.n FROM dealt d JOIN o ON o.series_id = d.series_id AND o.i = d.i + 1)
  SELECT observation_id, n AS reports FROM dealt""")
def series_report_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many reports each observation of a track gets out of its series' total."""
    rows = generate.budgets(tracks(spark, sf_dir).select("series_id", "observation_id", "sequence_index"), 4200, 20, 40)
    return rows.select("observation_id", F.col("reports_left_to_it").alias("reports"))


_R = lambda name: _u(4200, name, "observation_id", "no")


@query(f"""WITH {_generated(500)}, obs5 AS (SELECT 'esm_obs_' || lpad(n::VARCHAR, 5, '0') AS observation_id, own, operator, mode FROM chosen),
  rep AS (SELECT *, unnest(range(0, 10 + floor({_u(4200, "reports", "observation_id")} * 3)::INT)) AS no FROM obs5),
  typed AS (SELECT *, ['{"', '".join(generate.CLAIM_TYPES)}'][no % 7 + 1] AS claim_type, {_R("right")} < 0.72::DOUBLE AND no NOT IN (1, 5) AS correct FROM rep)
  SELECT 'intel_report:' || observation_id || ':' || lpad((no + 1)::VARCHAR, 2, '0') AS report_id, claim_type, CASE WHEN {_R("stance")} <= 0.12::DOUBLE THEN 'refutes' ELSE 'supports' END AS stance, correct,
  round(CASE WHEN correct THEN 0.6::DOUBLE + (0.92::DOUBLE - 0.6::DOUBLE) * {_R("confidence")} ELSE 0.35::DOUBLE + (0.82::DOUBLE - 0.35::DOUBLE) * {_R("confidence")} END + 1e-9, 6) AS claim_confidence,
  CASE WHEN claim_type = 'aircraft_variant' THEN CASE WHEN correct THEN own.aircraft_id ELSE list_filter(al, lambda x: x.aircraft_id <> own.aircraft_id)[1 + floor({_R("other")} * (len(al) - 1))::INT].aircraft_id END
    WHEN claim_type = 'radar_type' THEN CASE WHEN correct THEN own.radar_id ELSE list_filter(al, lambda x: x.radar_id <> own.radar_id)[1 + floor({_R("radar")} * len(list_filter(al, lambda x: x.radar_id <> own.radar_id)))::INT].radar_id END
  END AS object_id FROM typed, cat""")
def generate_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic reports with claims, right and wrong, about synthetic observations."""
    own = carriers(spark, sf_dir)
    claim = generate.reports(generate.observations(spark, own, 500, seed=7), own, seed=4200).select("report_id", F.explode("claims").alias("c"))
    named = F.when(F.col("c.claim_type").isin("aircraft_variant", "radar_type"), F.col("c.object_id"))
    return claim.select(
        "report_id", "c.claim_type", "c.stance", (F.col("c.synthetic_truth_value") == "correct").alias("correct"), "c.claim_confidence", named.alias("object_id")
    )


@query()
def gnn_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of the nodes after propagation over relations, trained on the training split."""
    nodes = V.vectors(spark, sf_dir)
    split = splits(spark, sf_dir).select("node_id", "split")
    return gnn.propagate_and_classify(nodes, V.edges(spark, sf_dir), split, hops=2, width=64)
