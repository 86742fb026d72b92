"""An evidence model over a graph: relational blocks, a head for masses, heads for classes, losses, predictions.

Layers are joins and grouped sums (``graph``, ``gnn``); heads are dot products of a node's vector. Weights are
given: the model is evaluated here, and ``fit_heads`` fits its heads on vectors that are there.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.functions import masses as M
from credence.operators import gnn
from credence.operators import graph as G

Matrix = Sequence[Sequence[float]]


def linear(x: Column, weight: Matrix, bias: Sequence[float] | None = None) -> Column:
    """x W + b, each entry a product with a literal column of W."""
    width = len(weight[0])
    cells = [M.dot(x, F.array(*[F.lit(float(row[j])) for row in weight])) + float(bias[j] if bias is not None else 0.0) for j in range(width)]
    return F.array(*cells)


@dataclass(frozen=True)
class Layer:
    """Weights of a relational block."""

    bases: Sequence[Matrix]
    mix: Matrix
    own: Matrix
    gates: Sequence[float]
    bias: Sequence[float]


@dataclass(frozen=True)
class Model:
    """Weights of the whole model; tasks with as many classes as hypotheses are read off the masses and have no head."""

    hypotheses: Sequence[str]
    entry: tuple[Matrix, Sequence[float]]
    layers: Sequence[Layer]
    mass_head: tuple[Matrix, Sequence[float]]
    tasks: Mapping[str, int] = field(default_factory=dict)
    heads: Mapping[str, tuple[Matrix, Sequence[float]]] = field(default_factory=dict)
    kind: str = "softmax"

    def __post_init__(self) -> None:
        n = len(self.hypotheses)
        if n < 1:
            raise ValueError("a model needs one hypothesis at least")
        if not self.layers:
            raise ValueError("a model needs one layer at least")
        if self.kind not in ("softmax", "dirichlet"):
            raise ValueError("masses come by softmax or dirichlet")
        for task, classes in self.tasks.items():
            if classes < 2:
                raise ValueError(f"task {task!r} needs two classes at least")
            if "." in task:
                raise ValueError(f"the name {task!r} holds a dot")
            if classes != n and (task not in self.heads or len(self.heads[task][1]) != classes):
                raise ValueError(f"task {task!r} needs a head of {classes} classes")
        if len(self.mass_head[1]) != len(self.masks):
            raise ValueError(f"the head of masses must have {len(self.masks)} entries")

    @property
    def masks(self) -> list[int]:
        return M.frame(self.hypotheses)

    def parameters(self) -> list[float]:
        """All weights, one after the other."""
        parts = [*self.entry, *self.mass_head, *(x for h in self.heads.values() for x in h)]
        for layer in self.layers:
            parts += [*layer.bases, layer.mix, layer.own, layer.gates, layer.bias]
        return np.concatenate([np.ravel(np.array(p, dtype=np.float64)) for p in parts]).tolist()


def l1_norm(model: Model) -> float:
    """Sum of the absolute weights."""
    return float(np.abs(model.parameters()).sum())


def encode(nodes: DataFrame, edges: DataFrame, model: Model) -> DataFrame:
    """(node_id, x): the entry projection, normalised and activated, and the blocks."""
    out = nodes.select("node_id", gnn.normal_then_active(linear(F.col("x"), *model.entry)).alias("x"))
    for layer in model.layers:
        out = gnn.block(out, edges, G.matrices(layer.bases, layer.mix), layer.own, layer.gates, layer.bias)
    return out


def midpoints(masses: Column, masks: Sequence[int], n: int) -> Column:
    """Middle of belief and plausibility of each hypothesis."""
    return F.array(*[(M.belief(masses, masks, h) + M.plausibility(masses, masks, h)) / 2 for h in range(n)])


def forward(nodes: DataFrame, edges: DataFrame, model: Model) -> DataFrame:
    """node_id, masses, uncertainty (of a dirichlet head), and the scores of each task's classes."""
    masks, n = model.masks, len(model.hypotheses)
    rows = encode(nodes, edges, model).select("node_id", "x", linear(F.col("x"), *model.mass_head).alias("logits"))
    if model.kind == "dirichlet":
        mean, unknown = M.dirichlet(F.col("logits"))
    else:
        mean, unknown = M.softmax(F.col("logits")), F.lit(None).cast("double")
    rows = rows.select("node_id", "x", mean.alias("masses"), unknown.alias("uncertainty"))
    scores = [(midpoints(F.col("masses"), masks, n) if c == n else linear(F.col("x"), *model.heads[t])).alias(t) for t, c in model.tasks.items()]
    return rows.select("node_id", "masses", "uncertainty", *scores)


def predictions(scored: DataFrame, model: Model, classes: Mapping[str, Sequence[str]]) -> DataFrame:
    """node_id, masses, uncertainty, intervals of each hypothesis, and for each task label, probability and all probabilities."""
    masks = model.masks
    rows = scored.withColumn("masses", M.validate_masses(F.col("masses"), strict=True)).withColumns({f"{t}__p": M.softmax(F.col(t)) for t in model.tasks})
    intervals = F.array(*[
        F.struct(F.lit(name).alias("hypothesis"), M.belief(F.col("masses"), masks, h).alias("belief"), M.plausibility(F.col("masses"), masks, h).alias("plausibility"))
        for h, name in enumerate(model.hypotheses)
    ])
    tasks = [
        F.struct(
            F.element_at(F.array(*[F.lit(c) for c in classes[t]]), M.argmax(F.col(f"{t}__p")) + 1).alias("label"), F.array_max(f"{t}__p").alias("probability"), F.col(f"{t}__p").alias("probabilities")
        ).alias(t)
        for t in model.tasks
    ]
    return rows.select("node_id", "masses", "uncertainty", intervals.alias("intervals"), F.struct(*tasks).alias("classifications") if tasks else F.lit(None).alias("classifications"))


def cross_entropy(p: Column, label: Column, classes: int, smoothing: float = 0.0) -> Column:
    """Smoothed cross entropy of a row's probabilities; null where the label is -1 or null."""
    logs = F.transform(p, lambda x: F.log(F.greatest(x, F.lit(1e-300))))
    loss = -((1 - smoothing) * F.element_at(logs, label + 1) + smoothing / classes * M.vec_sum(logs))
    return F.when(label.isNotNull() & (label >= 0), loss)


def losses(rows: DataFrame, tasks: Mapping[str, int], weights: Mapping[str, float], smoothing: float = 0.05, penalty: float = 0.01) -> DataFrame:
    """One row: mass_loss, classification_loss and loss over rows with ``masses``, ``target`` and, for each task, scores and ``<task>_label``.

    A task without any label adds nothing. ``penalty`` weighs the entropy that confident rows lack.
    """
    parts = [F.avg(M.kl_divergence(F.col("target"), F.col("masses"))).alias("mass_loss"), F.avg(M.entropy(F.col("masses"))).alias("calm")]
    for t, n in tasks.items():
        p = M.softmax(F.col(t))
        parts += [F.avg(cross_entropy(p, F.col(f"{t}_label"), n, smoothing)).alias(f"{t}_loss"), F.avg(M.entropy(p)).alias(f"{t}_calm")]
    one = rows.agg(*parts)
    weighted = sum((F.coalesce(F.col(f"{t}_loss"), F.lit(0.0)) * float(weights.get(t, 1.0)) for t in tasks), F.lit(0.0))
    calm = F.col("calm") + sum((F.col(f"{t}_calm") for t in tasks), F.lit(0.0))
    return one.select("mass_loss", weighted.alias("classification_loss"), (F.col("mass_loss") + weighted - penalty * calm).alias("loss"))


def class_indexes(rows: DataFrame, label: str, classes: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """``rows`` with ``<label>_label``, the index of the class or -1, and the classes: given, or those there, sorted.

    Fewer than two classes, and a label that is none of the given ones, are errors. Classes come to the driver.
    """
    known = [str(r[0]) for r in rows.select(F.col(label).cast("string")).where(F.col(label).isNotNull()).distinct().collect()]
    names = [str(c) for c in classes] if classes is not None else sorted(known)
    if len(names) < 2:
        raise ValueError(f"task {label!r} needs two classes at least")
    if strange := sorted(set(known) - set(names)):
        raise ValueError(f"labels of {label!r} that are no class: {strange[:5]}")
    at = F.array_position(F.array(*[F.lit(c) for c in names]), F.col(label).cast("string"))
    return rows.withColumn(f"{label}_label", F.coalesce(at - 1, F.lit(-1)).cast("int")), names


def attention(nodes: DataFrame, edges: DataFrame, q: Sequence[Matrix], k: Sequence[Sequence[Matrix]], v: Sequence[Sequence[Matrix]], prior: Matrix, out: Matrix) -> DataFrame:
    """(node_id, x): LN(x + GELU(W mean of gated values)) over several heads.

    ``q[h]`` projects the target, ``k[r][h]`` and ``v[r][h]`` the source of relation r; a sigmoid of their
    product over the root of the head's width, times ``prior[r][h]``, gates the value. Nodes without inbound
    edges have a mean of zero.
    """
    heads, width = len(q), len(q[0][0])
    ends = G.with_source(edges, nodes).join(nodes.select(F.col("node_id").alias("dst"), F.col("x").alias("y")), "dst")

    def by_relation(per: Callable[[int], Column]) -> Column:
        cell = F.lit(None).cast("double")
        for r in range(len(k)):
            cell = F.when(F.col("rel") == r, per(r)).otherwise(cell)
        return cell

    column = lambda x, w, j: M.dot(F.col(x), F.array(*[F.lit(float(row[j])) for row in w]))
    gated = ends
    for h in range(heads):
        score = by_relation(lambda r, h=h: sum((column("y", q[h], j) * column("x", k[r][h], j) for j in range(width)), F.lit(0.0)) * float(prior[r][h]))
        gated = gated.withColumn(f"g{h}", 1 / (1 + F.exp(-score / width**0.5)))
    cells = [F.col(f"g{h}") * by_relation(lambda r, h=h, j=j: column("x", v[r][h], j)) for h in range(heads) for j in range(width)]
    mean = G.vector_mean(gated, "dst", cells).select(F.col("dst").alias("node_id"), "m")
    zero = F.array(*[F.lit(0.0)] * (heads * width))
    joined = nodes.join(mean, "node_id", "left").select("node_id", "x", linear(F.coalesce("m", zero), out).alias("h"))
    return joined.select("node_id", gnn.add_then_normal("h", "x").alias("x"))


def fit_heads(rows: DataFrame, tasks: Mapping[str, int], weights: Mapping[str, float], reg: float = 0.05, iterations: int = 30) -> dict[str, tuple[Matrix, Sequence[float]]]:
    """Linear heads of the tasks on vectors ``x`` with ``<task>_label``: a distributed multinomial regression for each.

    A task's weight scales its loss against the regularisation.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    out = {}
    for task, n in tasks.items():
        known = rows.where(F.col(f"{task}_label") >= 0).select(array_to_vector("x").alias("features"), F.col(f"{task}_label").cast("double").alias("label"))
        model = LogisticRegression(maxIter=iterations, regParam=reg / max(float(weights.get(task, 1.0)), 1e-9), family="multinomial").fit(known)
        matrix, bias = np.zeros((n, len(model.coefficientMatrix.toArray()[0]))), np.full(n, -30.0)
        matrix[: model.numClasses], bias[: model.numClasses] = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
        out[task] = (matrix.T.tolist(), bias.tolist())
    return out
