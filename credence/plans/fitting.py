"""Queries that train the evidence model on the vectors, their three relations and their labels.

Two hypotheses stand for even and odd labels: a target has 0.85 on the label's own, the rest on both together. The label
itself is a task of ten classes with a head of its own, its parity one that is read off the masses.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.functions import masses as M
from credence.operators import network, training
from credence.plans import learning as L
from credence.plans import twins as T
from credence.plans.registry import query
from credence.sources import views as V

CLASSES = 10
#: The step that the twin repeats: one layer, three units, every kind of weight but gates.
STEP = training.Net(("even", "odd"), L.N, hidden=3, relations=3, layers=1, bases=2, tasks={"label": CLASSES, "parity": 2}, dropout=0.0)
STEP_PLAN = training.Schedule(task_weights={"label": 2.0}, penalty=0.05)
#: A small model that a query can train.
MODEL = training.Net(("even", "odd"), L.N, hidden=8, relations=3, layers=2, bases=2, tasks={"label": CLASSES, "parity": 2}, gates=True, dropout=0.1)
PLAN = training.Schedule(epochs=3, learning_rate=0.02, task_weights={"label": 2.0})


def supervised(spark: SparkSession, sf_dir: str) -> DataFrame:
    parity = (F.col("label") % 2).cast("int")
    split = L.splits(spark, sf_dir).select("node_id", "split", "label")
    return split.select("node_id", "split", M.singleton_target(parity, 2).alias("target"), F.col("label").cast("int").alias("label_label"), parity.alias("parity_label"))


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return V.vectors(spark, sf_dir).select("node_id", "x"), V.edges(spark, sf_dir), supervised(spark, sf_dir)


# The twin: the same step in plain SQL, forwards and backwards, one column for each unit.

_d = L._d
#: Coefficients of x^(2k+1) in erf(x) * exp(x^2), times sqrt(pi) / 2.
_ERF = "[" + ", ".join(repr(4.0**k * math.gamma(k + 1) / math.gamma(2 * k + 2)) for k in range(70)) + "]::DOUBLE[]"


def _phi(x: str) -> str:
    """Half of 1 + erf(x / sqrt 2)."""
    z = f"({x}) / sqrt(2.0::DOUBLE)"
    return f"(0.5::DOUBLE * (1 + {2 / math.sqrt(math.pi)!r}::DOUBLE * exp(-(({z}) ** 2)) * list_sum(list_transform({_ERF}, lambda c, i: c * pow({z}, 2 * i - 1)))))"


def _gelu(x: str) -> str:
    return f"({x}) * {_phi(x)}"


def _slope(x: str) -> str:
    return f"({_phi(x)} + ({x}) * exp(-(({x}) ** 2) / 2) / {math.sqrt(2 * math.pi)!r}::DOUBLE)"


def _sum(parts: list[str]) -> str:
    return "(" + " + ".join(parts) + ")"


def _normal(cells: list[str], out: str, deviation: str) -> str:
    mean = _sum(cells) + f" / {len(cells)}"
    var = _sum([f"({c} - {mean}) ** 2" for c in cells]) + f" / {len(cells)}"
    return ", ".join(f"({c} - {mean}) / sqrt({var} + 1e-5) AS {out}{j}" for j, c in enumerate(cells)) + f", sqrt({var} + 1e-5) AS {deviation}"


def _normal_back(d: list[str], y: str, deviation: str, out: str) -> str:
    n = len(d)
    mean, along = _sum(d) + f" / {n}", _sum([f"({c}) * {y}{j}" for j, c in enumerate(d)]) + f" / {n}"
    return ", ".join(f"(({c}) - {mean} - {y}{j} * {along}) / {deviation} AS {out}{j}" for j, c in enumerate(d))


def _softmax(z: str, n: int, out: str) -> str:
    top = "greatest(" + ", ".join(f"{z}{k}" for k in range(n)) + ")"
    total = _sum([f"exp({z}{k} - {top})" for k in range(n)])
    return ", ".join(f"exp({z}{k} - {top}) / {total} AS {out}{k}" for k in range(n))


def _step_sql(net: training.Net, plan: training.Schedule, weights: training.Weights) -> str:
    d, masks, w = range(net.hidden), range(len(net.masks)), {k: v.tolist() for k, v in weights.items()}
    relation = [[[sum(m * b[i][o] for m, b in zip(mix, w["layer0.bases"], strict=True)) for o in d] for i in d] for mix in w["layer0.mix"]]
    rels = range(net.relations)
    times = lambda row, m, o: [f"{row}{i} * {_d(m[i][o])}" for i in d]
    smooth, tw = plan.class_smoothing, {t: plan.class_weight * plan.task_weights.get(t, 1.0) for t in net.tasks}
    target = [f"({_d(1 - plan.mass_smoothing)} * t{k} + {_d(plan.mass_smoothing / len(net.masks))})" for k in masks]
    middle = [["p0", "p2"], ["p1", "p2"]]  # belief and plausibility of each hypothesis: its own mass, and half of both
    bases, mix = w["layer0.bases"], w["layer0.mix"]
    per = lambda r, i, o: f"sum(n{r}_{i} * e{o})"

    def task_grad(p: str, n: int, label: str, weight: float, at: int) -> str:
        calm = _sum([f"(ln({p}{k}) + 1) * {p}{k}" for k in range(n)])
        want = f"(CASE WHEN {label} = {at} THEN {_d(1 - smooth)} ELSE 0 END + {_d(smooth / n)})"
        return f"({_d(plan.penalty)} / total * {p}{at} * (ln({p}{at}) + 1 - {calm}) + {_d(weight)} / total * ({p}{at} - {want}))"

    parts = [
        T.VECS, T.EDGES, L._STRAT,
        "e0 AS (SELECT node_id, x, label, " + ", ".join(f"list_dot_product(x, [{', '.join(repr(r[j]) for r in w['entry.w'])}]::DOUBLE[]) + {_d(w['entry.b'][j])} AS u{j}" for j in d) + " FROM vecs)",
        f"e1 AS (SELECT *, {_normal([f'u{j}' for j in d], 'y', 'dev')} FROM e0)",
        "e2 AS (SELECT *, " + ", ".join(f"y{j} * {_d(w['entry.gain'][j])} + {_d(w['entry.shift'][j])} AS s{j}" for j in d) + " FROM e1)",
        "e3 AS (SELECT *, " + ", ".join(f"{_gelu(f's{j}')} AS h{j}, {_slope(f's{j}')} AS ds{j}" for j in d) + " FROM e2)",
        "sums AS (SELECT dst, count(*) AS degree, " + ", ".join(f"sum(CASE WHEN rel = {r} THEN h{i} ELSE 0 END) AS g{r}_{i}" for r in rels for i in d) + " FROM edges JOIN e3 ON src = node_id GROUP BY dst)",
        "l0 AS (SELECT e3.*, greatest(coalesce(degree, 0), 1) AS deg, " + ", ".join(f"coalesce(g{r}_{i}, 0) / greatest(coalesce(degree, 0), 1) AS n{r}_{i}" for r in rels for i in d) + " FROM e3 LEFT JOIN sums ON dst = node_id)",
        "l1 AS (SELECT *, " + ", ".join(
            _sum([_d(w["layer0.bias"][o]), *times("h", w["layer0.own"], o), *[f"n{r}_{i} * {_d(relation[r][i][o])}" for r in rels for i in d]]) + f" AS z{o}" for o in d
        ) + " FROM l0)",
        "l2 AS (SELECT *, " + ", ".join(f"{_gelu(f'z{o}')} AS a{o}, {_slope(f'z{o}')} AS dz{o}" for o in d) + " FROM l1)",
        f"l3 AS (SELECT *, {_normal([f'a{o}' for o in d], 'v', 'dev2')} FROM l2)",
        "l4 AS (SELECT *, " + ", ".join(f"h{o} + v{o} * {_d(w['layer0.gain'][o])} + {_d(w['layer0.shift'][o])} AS o{o}" for o in d) + " FROM l3)",
        "k0 AS (SELECT *, " + ", ".join(f"{_sum([_d(w['mass.b'][k]), *times('o', w['mass.w'], k)])} AS m{k}" for k in masks) + ", "
        + ", ".join(f"{_sum([_d(w['task.label.b'][k]), *times('o', w['task.label.w'], k)])} AS c{k}" for k in range(CLASSES)) + " FROM l4)",
        f"k1 AS (SELECT *, {_softmax('m', len(masks), 'p')}, {_softmax('c', CLASSES, 'q')} FROM k0)",
        "k2 AS (SELECT *, " + ", ".join(f"{middle[k][0]} + {middle[k][1]} / 2 AS w{k}" for k in range(2)) + " FROM k1)",
        f"k3 AS (SELECT k2.*, label % 2 AS parity, {_softmax('w', 2, 'b')}, CASE WHEN label % 2 = 0 THEN 0.85 ELSE 0 END::DOUBLE AS t0, CASE WHEN label % 2 = 1 THEN 0.85 ELSE 0 END::DOUBLE AS t1, 0.15::DOUBLE AS t2, split = 'train' AS inside,"
        " (SELECT count(*) FROM sp WHERE split = 'train')::DOUBLE AS total FROM k2 JOIN (SELECT node_id, split FROM sp) USING (node_id))",
        "k4 AS (SELECT *, " + ", ".join(f"CASE WHEN inside THEN {task_grad('q', CLASSES, 'label', tw['label'], k)} ELSE 0 END AS gq{k}" for k in range(CLASSES)) + ", "
        + ", ".join(f"{task_grad('b', 2, 'parity', tw['parity'], k)} AS gb{k}" for k in range(2)) + " FROM k3)",
        "k5 AS (SELECT *, " + ", ".join(
            f"-{target[k]} / p{k} / total + {_d(plan.penalty)} / total * (ln(p{k}) + 1) + {['gb0', 'gb1', '(gb0 + gb1) / 2'][k]} AS dp{k}" for k in masks
        ) + " FROM k4)",
        "k6 AS (SELECT *, " + ", ".join(f"CASE WHEN inside THEN p{k} * (dp{k} - {_sum([f'dp{x} * p{x}' for x in masks])}) ELSE 0 END AS dm{k}" for k in masks) + " FROM k5)",
        "k7 AS (SELECT *, " + ", ".join(
            _sum([*[f"dm{k} * {_d(w['mass.w'][i][k])}" for k in masks], *[f"gq{k} * {_d(w['task.label.w'][i][k])}" for k in range(CLASSES)]]) + f" AS do{i}" for i in d
        ) + " FROM k6)",
        f"b0 AS (SELECT *, {_normal_back([f'do{o} * ' + _d(w['layer0.gain'][o]) for o in d], 'v', 'dev2', 'da')} FROM k7)",
        "b1 AS (SELECT *, " + ", ".join(f"da{o} * dz{o} AS e{o}" for o in d) + " FROM b0)",
        "b2 AS (SELECT *, " + ", ".join(f"do{i} + {_sum([f'e{o} * ' + _d(w['layer0.own'][i][o]) for o in d])} AS own{i}" for i in d) + ", "
        + ", ".join(f"{_sum([f'e{o} * ' + _d(relation[r][i][o]) for o in d])} / deg AS r{r}_{i}" for r in rels for i in d) + " FROM b1)",
        "given AS (SELECT src, " + ", ".join(f"sum(CASE rel " + " ".join(f"WHEN {r} THEN r{r}_{i}" for r in rels) + f" END) AS f{i}" for i in d) + " FROM edges JOIN b2 ON dst = node_id GROUP BY src)",
        "b3 AS (SELECT b2.*, " + ", ".join(f"(own{i} + coalesce(f{i}, 0)) * ds{i} AS k{i}" for i in d) + " FROM b2 LEFT JOIN given ON src = node_id)",
        f"b4 AS (SELECT *, {_normal_back([f'k{j} * ' + _d(w['entry.gain'][j]) for j in d], 'y', 'dev', 'du')} FROM b3)",
    ]
    grads = {
        "entry.w": [f"sum(x[{i + 1}] * du{j})" for i in range(net.inputs) for j in d], "entry.b": [f"sum(du{j})" for j in d], "entry.gain": [f"sum(k{j} * y{j})" for j in d], "entry.shift": [f"sum(k{j})" for j in d],
        "layer0.bases": [_sum([f"{_d(mix[r][b])} * {per(r, i, o)}" for r in rels]) for b in range(len(bases)) for i in d for o in d],
        "layer0.mix": [_sum([f"{_d(bases[b][i][o])} * {per(r, i, o)}" for i in d for o in d]) for r in rels for b in range(len(bases))],
        "layer0.own": [f"sum(h{i} * e{o})" for i in d for o in d], "layer0.bias": [f"sum(e{o})" for o in d], "layer0.gain": [f"sum(do{o} * v{o})" for o in d], "layer0.shift": [f"sum(do{o})" for o in d],
        "mass.w": [f"sum(o{i} * dm{k})" for i in d for k in masks], "mass.b": [f"sum(dm{k})" for k in masks],
        "task.label.w": [f"sum(o{i} * gq{k})" for i in d for k in range(CLASSES)], "task.label.b": [f"sum(gq{k})" for k in range(CLASSES)],
    }
    cells = [f"{{'name': '{name}', 'at': {i}, 'g': {g}}}" for name, some in grads.items() for i, g in enumerate(some)]
    return "WITH " + ", ".join(parts) + f", g AS (SELECT unnest([{', '.join(cells)}]) AS s FROM b4) SELECT s.name AS name, s.at AS at, round(1000 * s.g + 1e-9, 6) AS gradient FROM g"


_WEIGHTS = {n: v.round(6) for n, v in STEP.initial(11).items()}


@query(_step_sql(STEP, STEP_PLAN, _WEIGHTS))
def training_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradients (thousandths) of one step over the training split, a row for each weight."""
    nodes, edges, rows = _tables(spark, sf_dir)
    grads = training.gradients(nodes, edges, rows.where("split = 'train'"), STEP, _WEIGHTS, STEP_PLAN)
    cells = [(name, i, float(x)) for name, g in grads.items() for i, x in enumerate(g.ravel())]
    return spark.createDataFrame(cells, "name string, at int, g double").select("name", "at", F.round(1000 * F.col("g") + 1e-9, 6).alias("gradient"))


@query()
def training_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses and accuracies of each epoch and split."""
    nodes, edges, rows = _tables(spark, sf_dir)
    fit = training.fit(nodes, edges, rows, MODEL, PLAN)
    out = [(h["epoch"], s, *[round(h[f"{s}_{k}"], 5) for k in ("loss", "mass_loss", "classification_loss", "label_acc", "parity_acc")]) for h in fit.history for s in ("train", "test", "val")]
    return spark.createDataFrame(out, "epoch int, split string, loss double, mass_loss double, classification_loss double, label_acc double, parity_acc double")


@query()
def evidence_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of the hypotheses, and label and probability of each task, of every node after training."""
    nodes, edges, rows = _tables(spark, sf_dir)
    fit = training.fit(nodes, edges, rows, MODEL, PLAN)
    found = network.predictions(training.score(nodes, edges, MODEL, fit.best), MODEL, {"label": [str(i) for i in range(CLASSES)], "parity": list(MODEL.hypotheses)})
    cells = [F.round(F.col("intervals")[h][k], 4).alias(f"{k}_{name}") for h, name in enumerate(MODEL.hypotheses) for k in ("belief", "plausibility")]
    tasks = [c for t in MODEL.tasks for c in (F.col(f"classifications.{t}.label").alias(f"{t}_predicted"), F.round(F.col(f"classifications.{t}.probability"), 4).alias(f"{t}_probability"))]
    return found.select("node_id", *cells, *tasks)


#: A classifier of whole series: a hidden layer in each task's head, gates, no masses.
SERIES = training.Net((), L.N, hidden=8, relations=3, layers=2, bases=2, tasks={"label": CLASSES, "parity": 2}, gates=True, dropout=0.2, head_hidden=16, mass=False)


@query()
def series_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of series of ten vectors, pooled over their nodes, after training the classifier of series."""
    nodes, edges, rows = _tables(spark, sf_dir)
    fit = training.fit(nodes, edges, rows.withColumn("target", F.lit(None).cast("array<double>")), SERIES, PLAN)
    series = nodes.select("node_id", F.floor(F.col("node_id") / 10).alias("series_id"))
    found = training.pooled(training.score(nodes, edges, SERIES, fit.best), series, {"label": [str(i) for i in range(CLASSES)], "parity": ["even", "odd"]})
    return found.select("series_id", "nodes", *[c for t in SERIES.tasks for c in (F.col(f"{t}.label").alias(f"{t}_predicted"), F.round(f"{t}.probability", 4).alias(f"{t}_probability"))])
