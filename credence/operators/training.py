"""Training of the evidence model end to end: gradients through joins, summed over partitions.

Only weights, their gradients and sums of losses come to the driver, so what it holds grows with the model alone. Node
states stay in tables. A layer forwards by one sum of source states for each (target, relation), then works on rows:
what a node receives goes through the relations' matrices once, not once for an edge. Backwards, a row gives the
gradient of what it received; each edge takes its relation's part of it back to the source, again a grouped sum. Every
layer's rows are written once each way, so a lost executor costs the tasks of one layer. Gradients of weights are
summed within a task, then by position.

Dropout masks and batches are drawn by hashes of (seed, epoch, place, node), so a task that runs again draws the same.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credence.functions import masses as M
from credence.functions.settings import setting
from credence.operators.gnn import _erf
from credence.sources.artifacts import write_document
from credence.sources.stages import Stages

Weights = dict[str, np.ndarray]
_EPS, _FLOOR = 1e-5, 1e-9


@dataclass(frozen=True)
class Net:
    """Form of the model. A task with as many classes as hypotheses is read off the masses and has no head.

    With ``head_hidden`` a head has a layer of so many units before its last one. Without ``mass`` there is no head of
    masses: every task has its own head, and targets are not looked at.
    """

    hypotheses: Sequence[str]
    inputs: int
    hidden: int = 64
    relations: int = 1
    layers: int = 5
    bases: int | None = None
    tasks: Mapping[str, int] = field(default_factory=dict)
    gates: bool = False
    residual: bool = True
    normal: bool = True
    dropout: float = 0.1
    kind: str = "softmax"
    head_hidden: int = 0
    mass: bool = True

    def __post_init__(self) -> None:
        if not self.mass and not self.tasks:
            raise ValueError("a model without masses needs a task")
        if min(len(self.hypotheses) if self.mass else 1, self.layers, self.relations, self.inputs, self.hidden) < 1 or (self.bases is not None and self.bases < 1):
            raise ValueError("hypotheses, layers, relations, bases and widths must be positive")
        if self.kind not in ("softmax", "dirichlet"):
            raise ValueError("masses come by softmax or dirichlet")
        if not 0 <= self.dropout < 1:
            raise ValueError("dropout must lie in [0, 1)")
        if bad := [t for t, n in self.tasks.items() if n < 2 or "." in t]:
            raise ValueError(f"tasks need two classes and a name without a dot: {bad}")

    @property
    def masks(self) -> list[int]:
        return M.frame(self.hypotheses)

    @property
    def n_bases(self) -> int:
        return min(self.bases or self.relations, self.relations)

    @property
    def heads(self) -> dict[str, int]:
        return {t: n for t, n in self.tasks.items() if not self.mass or n != len(self.hypotheses)}

    @property
    def outputs(self) -> dict[str, int]:
        """Every head by the name of its weights, with its width."""
        return ({"mass": len(self.masks)} if self.mass else {}) | {f"task.{t}": n for t, n in self.heads.items()}

    def shapes(self) -> dict[str, tuple[int, ...]]:
        """Every weight by name, in a fixed order."""
        d, out = self.hidden, {"entry.w": (self.inputs, self.hidden), "entry.b": (self.hidden,)}
        norm = {"gain": (d,), "shift": (d,)} if self.normal else {}
        out |= {f"entry.{k}": s for k, s in norm.items()}
        for k in range(self.layers):
            own = {"bases": (self.n_bases, d, d), "mix": (self.relations, self.n_bases), "own": (d, d), "bias": (d,)} | norm
            if self.gates:
                own["gates"] = (self.relations,)
            out |= {f"layer{k}.{n}": s for n, s in own.items()}
        for name, width in self.outputs.items():
            first = self.head_hidden or width
            out |= {f"{name}.w": (d, first), f"{name}.b": (first,)}
            if self.head_hidden:
                out |= {f"{name}.w2": (first, width), f"{name}.b2": (width,)}
        return out

    def initial(self, seed: int) -> Weights:
        """Uniform draws whose width follows from fan-in (and fan-out for bases and mixes); gains are 1, shifts and gate logits 0."""
        rng, out, shapes = np.random.default_rng(seed), {}, self.shapes()
        for name, shape in shapes.items():
            part = name.rsplit(".", 1)[1]
            if part in ("bases", "mix"):
                fan = (shape[0] + shape[1]) if part == "mix" else self.hidden * (shape[0] + shape[1])
                bound = math.sqrt(6 / fan)
            elif part in ("w", "b", "w2", "b2", "own"):
                bound = 1 / math.sqrt(self.hidden if part == "own" else shapes[f"{name.rsplit('.', 1)[0]}.{part.replace('b', 'w')}"][0])
            else:
                bound = 0.0
            out[name] = rng.uniform(-bound, bound, shape) if bound else np.full(shape, 1.0 if part == "gain" else 0.0)
        return out


@dataclass(frozen=True)
class Schedule:
    """How it is trained. ``batch_size`` 0 takes all training nodes at once; batches are drawn by hash, so sizes vary a little."""

    epochs: int = 200
    batch_size: int = 0
    learning_rate: float = 1e-3
    weight_decay: float = 1e-4
    mass_smoothing: float = 0.01
    class_smoothing: float = 0.05
    class_weight: float = 1.0
    task_weights: Mapping[str, float] = field(default_factory=dict)
    penalty: float = 0.01
    l1: float = 1e-5
    max_norm: float = 1.0
    plateau: bool = True
    plateau_factor: float = 0.5
    plateau_patience: int | None = None
    patience: int = 10
    min_delta: float = 1e-4
    seed: int = 42

    def __post_init__(self) -> None:
        if not (0 <= self.mass_smoothing <= 1 and 0 <= self.class_smoothing <= 1):
            raise ValueError("smoothing must lie between 0 and 1")
        if min(self.penalty, self.max_norm, self.batch_size, self.epochs, self.l1, *self.task_weights.values(), 0) < 0:
            raise ValueError("weights, bounds and sizes must not be negative")


@dataclass(frozen=True)
class Fit:
    """The weights of the best epoch by validation loss, those of the last, and a row of losses and accuracies for each epoch."""

    best: Weights
    last: Weights
    history: list[dict[str, float]]
    best_epoch: int


# Row kernels. Each forward keeps what its backward needs.


def _gelu(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """GELU and its derivative."""
    phi = 0.5 * (1 + _erf(u / math.sqrt(2)).astype(np.float64))
    return u * phi, phi + u * np.exp(-u * u / 2) / math.sqrt(2 * math.pi)


def _norm(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    deviation = np.sqrt(a.var(axis=1, keepdims=True) + _EPS)
    return (a - a.mean(axis=1, keepdims=True)) / deviation, deviation


def _norm_back(d: np.ndarray, y: np.ndarray, deviation: np.ndarray) -> np.ndarray:
    return (d - d.mean(axis=1, keepdims=True) - y * (d * y).mean(axis=1, keepdims=True)) / deviation


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass(frozen=True)
class Draw:
    """A dropout of one step; without one nothing is dropped."""

    share: float
    seed: int

    def mask(self, keys: np.ndarray, place: int, width: int) -> np.ndarray:
        if not self.share:
            return np.ones((len(keys), width))
        unit = _mixed(np.arange(width, dtype=np.uint64) + np.uint64((self.seed * 1009 + place * 7919) % 2**63))
        u = _mixed(keys.view(np.uint64)[:, None] ^ unit[None, :]) >> np.uint64(11)
        return (u.astype(np.float64) / 2**53 >= self.share) / (1 - self.share)


EVAL = Draw(0.0, 0)


class _Kernels:
    """The model on a batch of rows, forwards and backwards."""

    def __init__(self, net: Net, weights: Weights, draw: Draw = EVAL):
        self.net, self.w, self.draw = net, weights, draw
        if not net.mass:
            return
        n = len(net.hypotheses)
        singles = np.array([[float(m == 1 << h) for m in net.masks] for h in range(n)])
        meets = np.array([[float(bool(m >> h & 1)) for m in net.masks] for h in range(n)])
        self.middle = (singles + meets) / 2

    def _scaled(self, name: str, y: np.ndarray) -> np.ndarray:
        return y * self.w[f"{name}.gain"] + self.w[f"{name}.shift"] if self.net.normal else y

    def _scaled_back(self, name: str, d: np.ndarray, y: np.ndarray, grads: Weights) -> np.ndarray:
        if not self.net.normal:
            return d
        grads[f"{name}.gain"], grads[f"{name}.shift"] = (d * y).sum(axis=0), d.sum(axis=0)
        return d * self.w[f"{name}.gain"]

    def entry(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        u = x @ self.w["entry.w"] + self.w["entry.b"]
        return _gelu(self._scaled("entry", _norm(u)[0] if self.net.normal else u))[0] * self.draw.mask(keys, 0, self.net.hidden)

    def entry_back(self, x: np.ndarray, keys: np.ndarray, d: np.ndarray) -> Weights:
        grads: Weights = {}
        u = x @ self.w["entry.w"] + self.w["entry.b"]
        y, deviation = _norm(u) if self.net.normal else (u, None)
        d = d * self.draw.mask(keys, 0, self.net.hidden) * _gelu(self._scaled("entry", y))[1]
        d = self._scaled_back("entry", d, y, grads)
        d = _norm_back(d, y, deviation) if self.net.normal else d
        return grads | {"entry.w": x.T @ d, "entry.b": d.sum(axis=0)}

    def _matrices(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Each relation's matrix without its gate, and the gates."""
        plain = np.einsum("rb,bio->rio", self.w[f"layer{k}.mix"], self.w[f"layer{k}.bases"])
        gates = 1 / (1 + np.exp(-self.w[f"layer{k}.gates"])) if self.net.gates else np.ones(self.net.relations)
        return plain, gates

    def _received(self, got: np.ndarray, degree: np.ndarray) -> np.ndarray:
        return got.reshape(len(got), self.net.relations, self.net.hidden) / np.maximum(degree, 1)[:, None, None]

    def layer(self, k: int, h: np.ndarray, got: np.ndarray, degree: np.ndarray, keys: np.ndarray) -> np.ndarray:
        plain, gates = self._matrices(k)
        u = h @ self.w[f"layer{k}.own"] + self.w[f"layer{k}.bias"] + np.einsum("nri,rio,r->no", self._received(got, degree), plain, gates, optimize=True)
        a = _gelu(u)[0]
        y = self._scaled(f"layer{k}", _norm(a)[0] if self.net.normal else a) * self.draw.mask(keys, k + 1, self.net.hidden)
        return h + y if self.net.residual else y

    def layer_back(self, k: int, h: np.ndarray, got: np.ndarray, degree: np.ndarray, keys: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, Weights]:
        """Gradients of the row's own state, of the sums it received, and of the weights."""
        name, grads = f"layer{k}", {}
        plain, gates = self._matrices(k)
        mean = self._received(got, degree)
        u = h @ self.w[f"{name}.own"] + self.w[f"{name}.bias"] + np.einsum("nri,rio,r->no", mean, plain, gates, optimize=True)
        a, slope = _gelu(u)
        y, deviation = _norm(a) if self.net.normal else (a, None)
        own = d if self.net.residual else np.zeros_like(h)
        e = self._scaled_back(name, d * self.draw.mask(keys, k + 1, self.net.hidden), y, grads)
        e = (_norm_back(e, y, deviation) if self.net.normal else e) * slope
        per = np.einsum("nri,no->rio", mean, e, optimize=True)  # of each gated matrix
        gated = per * gates[:, None, None]
        grads |= {
            f"{name}.own": h.T @ e, f"{name}.bias": e.sum(axis=0), f"{name}.bases": np.einsum("rb,rio->bio", self.w[f"{name}.mix"], gated),
            f"{name}.mix": np.einsum("bio,rio->rb", self.w[f"{name}.bases"], gated),
        }
        if self.net.gates:
            grads[f"{name}.gates"] = (per * plain).sum(axis=(1, 2)) * gates * (1 - gates)
        back = np.einsum("no,rio,r->nri", e, plain, gates, optimize=True) / np.maximum(degree, 1)[:, None, None]
        return own + e @ self.w[f"{name}.own"].T, back.reshape(len(h), -1), grads

    def head(self, name: str, h: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray] | None]:
        """What a head says of rows, and what its way back needs."""
        u = h @ self.w[f"{name}.w"] + self.w[f"{name}.b"]
        if not self.net.head_hidden:
            return u, None
        a, slope = _gelu(u)
        mask = self.draw.mask(keys, self.net.layers + 1 + list(self.net.outputs).index(name), self.net.head_hidden)
        return (a * mask) @ self.w[f"{name}.w2"] + self.w[f"{name}.b2"], (a * mask, slope * mask)

    def head_back(self, name: str, h: np.ndarray, kept: tuple[np.ndarray, np.ndarray] | None, d: np.ndarray) -> tuple[np.ndarray, Weights]:
        grads = {}
        if kept is not None:
            grads = {f"{name}.w2": kept[0].T @ d, f"{name}.b2": d.sum(axis=0)}
            d = d @ self.w[f"{name}.w2"].T * kept[1]
        return d @ self.w[f"{name}.w"].T, grads | {f"{name}.w": h.T @ d, f"{name}.b": d.sum(axis=0)}

    def scores(self, h: np.ndarray, keys: np.ndarray) -> tuple[dict[str, tuple], np.ndarray | None, np.ndarray | None, dict[str, np.ndarray]]:
        """What each head says, the masses, their uncertainty, and the scores of each task."""
        said = {name: self.head(name, h, keys) for name in self.net.outputs}
        masses = unknown = None
        if self.net.mass:
            z = said["mass"][0]
            if self.net.kind == "dirichlet":
                alpha = np.logaddexp(0, z) + 1
                masses, unknown = alpha / alpha.sum(axis=1, keepdims=True), len(self.net.masks) / alpha.sum(axis=1)
            else:
                masses = _softmax(z)
        tasks = {t: said[f"task.{t}"][0] if t in self.net.heads else masses @ self.middle.T for t in self.net.tasks}
        return said, masses, unknown, tasks

    def masses_back(self, z: np.ndarray, masses: np.ndarray, d: np.ndarray) -> np.ndarray:
        if self.net.kind == "softmax":
            return masses * (d - (d * masses).sum(axis=1, keepdims=True))
        total = (np.logaddexp(0, z) + 1).sum(axis=1, keepdims=True)
        return (d - (d * masses).sum(axis=1, keepdims=True)) / total / (1 + np.exp(-z))

    def loss_back(self, h: np.ndarray, keys: np.ndarray, target: np.ndarray | None, labels: np.ndarray, plan: Schedule, n: float, valid: Sequence[float]) -> tuple[np.ndarray, Weights]:
        """Gradient of a batch's loss (without the L1 term) for the rows in it; ``n`` rows in all, ``valid`` labels of each task."""
        said, masses, _, tasks = self.scores(h, keys)
        out, grads, d = np.zeros_like(h), {}, None
        if self.net.mass:
            inside = masses > _FLOOR
            d = np.where(inside, -target / np.maximum(masses, _FLOOR), 0.0) / n
            d += plan.penalty / n * np.where(inside, np.log(np.maximum(masses, _FLOOR)) + 1, math.log(_FLOOR))
        given = {}
        for k, (t, classes) in enumerate(self.net.tasks.items()):
            p = _softmax(tasks[t])
            e = np.where(p > _FLOOR, np.log(np.maximum(p, _FLOOR)) + 1, math.log(_FLOOR))
            g = plan.penalty / n * p * (e - (e * p).sum(axis=1, keepdims=True))
            known = labels[:, k] >= 0
            if valid[k]:
                want = np.full((int(known.sum()), classes), plan.class_smoothing / classes)
                want[np.arange(len(want)), labels[known, k]] += 1 - plan.class_smoothing
                g[known] += plan.class_weight * plan.task_weights.get(t, 1.0) / valid[k] * (p[known] - want)
            if t in self.net.heads:
                given[f"task.{t}"] = g
            else:
                d += g @ self.middle
        if self.net.mass:
            given["mass"] = self.masses_back(said["mass"][0], masses, d)
        for name, g in given.items():
            back, more = self.head_back(name, h, said[name][1], g)
            out += back
            grads |= more
        return out, grads

    def counted(self, h: np.ndarray, keys: np.ndarray, target: np.ndarray | None, labels: np.ndarray, smoothing: float) -> np.ndarray:
        """Per row: 1, the divergence, and for each task whether it is labelled, its smoothed cross entropy, whether it is right."""
        _, masses, _, tasks = self.scores(h, keys)
        kl = np.zeros(len(h)) if masses is None else np.where(target > 0, target * (np.log(np.where(target > 0, target, 1.0)) - np.log(np.maximum(masses, _FLOOR))), 0.0).sum(axis=1)
        out = [np.ones(len(h)), kl]
        for k, (t, classes) in enumerate(self.net.tasks.items()):
            known, at = labels[:, k] >= 0, np.maximum(labels[:, k], 0)
            shifted = tasks[t] - tasks[t].max(axis=1, keepdims=True)
            logs = shifted - np.log(np.exp(shifted).sum(axis=1, keepdims=True))
            ce = -((1 - smoothing) * logs[np.arange(len(h)), at] + smoothing / classes * logs.sum(axis=1))
            out += [known.astype(float), np.where(known, ce, 0.0), (known & (tasks[t].argmax(axis=1) == at)).astype(float)]
        return np.stack(out, axis=1)


# Tables.


def _matrix(b: pa.RecordBatch, name: str) -> np.ndarray:
    cells = b.column(name)
    flat = cells.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(b.num_rows, len(flat) // max(1, b.num_rows)) if b.num_rows else flat.reshape(0, 0)


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, max(1, width))[: n + 1].astype(np.int32)), pa.array(np.ascontiguousarray(values, dtype=np.float64).ravel()))


_VECTOR = T.ArrayType(T.DoubleType())


def _schema(rows: DataFrame, *columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField("node_id", rows.schema["node_id"].dataType), *[T.StructField(n, kind) for n, kind in columns]])


class _Graph:
    """Nodes (node_id, key, x) and edges, held by source for the way forward and by target for the way back."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, net: Net):
        self.net = net
        self.nodes = nodes.select("node_id", F.xxhash64(F.col("node_id").cast("string")).alias("key"), "x")
        links = edges.select("src", "dst", F.col("rel").cast("int").alias("rel"))
        # Read by every layer of every step; dealt once. Lost parts are made again from the tables.
        self.by_source, self.by_target = links.repartition("src").persist(), links.repartition("dst").persist()

    def close(self) -> None:
        self.by_source.unpersist()
        self.by_target.unpersist()

    def _rows(self, source: DataFrame, kernel: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column("node_id"), b.column("key"), _lists(kernel(b))], names=["node_id", "key", "h"])

        return source.mapInArrow(run, _schema(source, ("key", T.LongType()), ("h", _VECTOR)))

    def received(self, states: DataFrame) -> DataFrame:
        """``states`` (node_id, key, h) with ``got``, the sums of sources' states by relation, end to end, and the degree."""
        d = self.net.hidden
        ends = self.by_source.join(states.select(F.col("node_id").alias("src"), "h"), "src")
        sums = ends.groupBy("dst", "rel").agg(*[F.sum(F.col("h")[j]).alias(f"s{j}") for j in range(d)], F.count("*").alias("n"))
        cell = F.struct("rel", F.array(*[f"s{j}" for j in range(d)]).alias("s"))
        # No more entries than relations.
        by_node = sums.groupBy("dst").agg(F.map_from_entries(F.collect_list(cell)).alias("m"), F.sum("n").alias("degree"))
        zero = F.array_repeat(F.lit(0.0), d)
        relation = F.sequence(F.lit(0), F.lit(self.net.relations - 1))
        got = F.when(F.col("m").isNull(), F.array_repeat(F.lit(0.0), d * self.net.relations)).otherwise(F.flatten(F.transform(relation, lambda r: F.coalesce(F.try_element_at("m", r), zero))))
        return states.join(by_node, states.node_id == by_node.dst, "left").select("node_id", "key", "h", got.alias("got"), F.coalesce("degree", F.lit(0)).cast("double").alias("degree"))

    def forward(self, kernels: _Kernels, stages: Stages) -> list[DataFrame]:
        """The written rows that enter each layer."""
        states = self._rows(self.nodes, lambda b: kernels.entry(_matrix(b, "x"), b.column("key").to_numpy()))
        out = []
        for k in range(self.net.layers):
            out.append(stages.written(self.received(states)))
            if k + 1 < self.net.layers:
                states = self._rows(out[-1], lambda b, k=k: kernels.layer(k, *_layer_rows(b)))
        return out

    def back(self, grads: DataFrame) -> DataFrame:
        """(node_id, d): the gradient of states from rows (node_id, own, got): their own part and what targets give back."""
        d = self.net.hidden
        cells = [F.sum(F.element_at("got", F.col("rel") * d + j + 1)).alias(f"s{j}") for j in range(d)]
        ends = self.by_target.join(grads.select(F.col("node_id").alias("dst"), "got"), "dst")
        from_targets = ends.groupBy(F.col("src").alias("node_id")).agg(*cells).select("node_id", F.array(*[f"s{j}" for j in range(d)]).alias("b"))
        both = F.zip_with("own", F.coalesce("b", F.array_repeat(F.lit(0.0), d)), lambda x, y: x + y)
        return grads.select("node_id", "own").join(from_targets, "node_id", "left").select("node_id", both.alias("d"))


def _layer_rows(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return _matrix(b, "h"), _matrix(b, "got"), b.column("degree").to_numpy(), b.column("key").to_numpy()


def _with_payload(source: DataFrame, kernel: Callable[[pa.RecordBatch], tuple[np.ndarray | None, np.ndarray | None, Weights]]) -> DataFrame:
    """(node_id, own, got, name, payload): gradients of rows, then those of weights, summed over the task, a row for each."""
    node = source.schema["node_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Weights = {}
        kind = None
        for b in batches:
            if not b.num_rows:
                continue
            kind = b.schema.field("node_id").type
            own, got, grads = kernel(b)
            for name, g in grads.items():
                sums[name] = sums[name] + g if name in sums else g
            if own is not None:
                blank = pa.nulls(b.num_rows, pa.string()), pa.nulls(b.num_rows, pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column("node_id"), _lists(own), _lists(got), *blank], names=["node_id", "own", "got", "name", "payload"])
        if sums:
            n, vector = len(sums), pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, kind), pa.nulls(n, vector), pa.nulls(n, vector), pa.array(list(sums)), pa.array([g.ravel().tolist() for g in sums.values()], vector)],
                names=["node_id", "own", "got", "name", "payload"],
            )

    schema = T.StructType([T.StructField("node_id", node), T.StructField("own", _VECTOR), T.StructField("got", _VECTOR), T.StructField("name", T.StringType()), T.StructField("payload", _VECTOR)])
    return source.mapInArrow(run, schema)


def _summed(parts: Sequence[DataFrame], shapes: Mapping[str, tuple[int, ...]]) -> Weights:
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    cells = rows.where("name is not null").select("name", F.posexplode("payload").alias("at", "g")).groupBy("name", "at").agg(F.sum("g").alias("g"))
    out = {n: np.zeros(int(np.prod(s))) for n, s in shapes.items()}
    for name, at, g in cells.collect():  # as many rows as the model has weights
        out[name][at] = g
    return {n: out[n].reshape(s) for n, s in shapes.items()}


def _targets(rows: DataFrame, net: Net, smoothing: float) -> DataFrame:
    """(node_id, split, target, labels) of the supervised rows."""
    n = len(net.masks) if net.mass else 1
    target = F.transform("target", lambda t: t * (1 - smoothing) + smoothing / n) if net.mass else F.lit(None).cast("array<double>")
    labels = F.array(*[F.coalesce(F.col(f"{t}_label").cast("int"), F.lit(-1)) for t in net.tasks]) if net.tasks else F.array().cast("array<int>")
    return rows.where("split is not null").select("node_id", "split", target.alias("target"), labels.alias("labels"))


def _target_matrix(b: pa.RecordBatch, net: Net) -> np.ndarray | None:
    return _matrix(b, "target") if net.mass else None


def _label_matrix(b: pa.RecordBatch, net: Net) -> np.ndarray:
    flat = b.column("labels").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(b.num_rows, len(net.tasks)).astype(np.int64)


def gradients(nodes: DataFrame, edges: DataFrame, supervised: DataFrame, net: Net, weights: Weights, plan: Schedule, draw: Draw = EVAL) -> Weights:
    """The gradient of the loss over ``supervised`` (node_id, split, target, and ``<task>_label``), without the L1 term."""
    graph = _Graph(nodes, edges, net)
    try:
        return _step(graph, _targets(supervised, net, plan.mass_smoothing), F.lit(True), _Kernels(net, weights, draw), plan)
    finally:
        graph.close()


def _sizes(rows: DataFrame, net: Net) -> tuple[float, list[float]]:
    found = rows.agg(F.count("*"), *[F.coalesce(F.sum((F.col("labels")[k] >= 0).cast("int")), F.lit(0)) for k in range(len(net.tasks))]).first()
    return float(found[0]), [float(v) for v in found[1:]]


def _step(graph: _Graph, targets: DataFrame, inside: Column, kernels: _Kernels, plan: Schedule) -> Weights:
    """The gradient over the targets that are ``inside``; what the step writes goes with it."""
    with Stages(targets.sparkSession) as stages:
        return _gradients(graph, targets, inside, kernels, plan, stages)


def _gradients(graph: _Graph, targets: DataFrame, inside: Column, kernels: _Kernels, plan: Schedule, stages: Stages) -> Weights:
    net = graph.net
    chosen = targets.where(inside)
    n, valid = _sizes(chosen, net)
    if not n:
        return {name: np.zeros(s) for name, s in net.shapes().items()}
    entering = graph.forward(kernels, stages)
    last = net.layers - 1

    def top(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, Weights]:
        h, got, degree, keys = _layer_rows(b)
        d, grads = np.zeros((len(h), net.hidden)), {}
        known = np.flatnonzero(b.column("labels").is_valid().to_numpy(zero_copy_only=False))
        if len(known):
            part = b.take(pa.array(known))
            out = kernels.layer(last, h[known], got[known], degree[known], keys[known])
            d[known], grads = kernels.loss_back(out, keys[known], _target_matrix(part, net), _label_matrix(part, net), plan, n, valid)
        own, back, more = kernels.layer_back(last, h, got, degree, keys, d)
        return own, back, grads | more

    def below(k: int) -> Callable:
        def kernel(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, Weights]:
            return kernels.layer_back(k, *_layer_rows(b), _matrix(b, "d"))
        return kernel

    rows = entering[last].join(chosen.select("node_id", "target", "labels"), "node_id", "left")
    parts = [stages.written(_with_payload(rows, top))]
    for k in range(last - 1, -1, -1):
        given = graph.back(parts[-1].where("name is null"))
        parts.append(stages.written(_with_payload(entering[k].join(given, "node_id"), below(k))))
    given = graph.nodes.join(graph.back(parts[-1].where("name is null")), "node_id")
    parts.append(_with_payload(given, lambda b: (None, None, kernels.entry_back(_matrix(b, "x"), b.column("key").to_numpy(), _matrix(b, "d")))))
    return _summed(parts, net.shapes())


def _outputs(graph: _Graph, kernels: _Kernels, stages: Stages) -> DataFrame:
    """(node_id, key, h): the encoded nodes."""
    last = graph.net.layers - 1
    return graph._rows(graph.forward(kernels, stages)[last], lambda b: kernels.layer(last, *_layer_rows(b)))


def metrics(encoded: DataFrame, targets: DataFrame, net: Net, weights: Weights, plan: Schedule) -> dict[str, dict[str, float]]:
    """For each split its losses and each task's accuracy (none without labels)."""
    kernels = _Kernels(net, weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("split"), _lists(kernels.counted(_matrix(b, "h"), b.column("key").to_numpy(), _target_matrix(b, net), _label_matrix(b, net), plan.class_smoothing))], names=["split", "c"])

    rows = encoded.join(targets, "node_id").mapInArrow(run, "split string, c array<double>")
    width = 2 + 3 * len(net.tasks)
    sums = rows.groupBy("split").agg(*[F.sum(F.col("c")[i]) for i in range(width)]).collect()  # a row for each split
    out = {}
    for split, n, kl, *rest in sums:
        row, classes = {"mass_loss": kl / n}, 0.0
        for k, t in enumerate(net.tasks):
            valid, ce, right = rest[3 * k : 3 * k + 3]
            if valid:
                classes += plan.task_weights.get(t, 1.0) * ce / valid
            row[f"{t}_acc"] = right / valid if valid else math.nan
        out[split] = row | {"classification_loss": classes, "loss": row["mass_loss"] + plan.class_weight * classes}
    return out


class _AdamW:
    """Adam with decoupled decay over named arrays."""

    def __init__(self, plan: Schedule, shapes: Mapping[str, tuple[int, ...]]):
        self.rate, self.decay, self.max_norm, self.steps = plan.learning_rate, plan.weight_decay, plan.max_norm, 0
        self.first, self.second = ({n: np.zeros(s) for n, s in shapes.items()} for _ in range(2))

    def step(self, weights: Weights, grads: Weights) -> Weights:
        norm = math.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, self.max_norm / (norm + 1e-6)) if self.max_norm else 1.0
        self.steps += 1
        out = {}
        for n, w in weights.items():
            g = grads[n] * scale
            self.first[n] = 0.9 * self.first[n] + 0.1 * g
            self.second[n] = 0.999 * self.second[n] + 0.001 * g * g
            unbiased = self.first[n] / (1 - 0.9**self.steps)
            spread = np.sqrt(self.second[n] / (1 - 0.999**self.steps)) + 1e-8
            out[n] = w * (1 - self.rate * self.decay) - self.rate * unbiased / spread
        return out


def fit(nodes: DataFrame, edges: DataFrame, supervised: DataFrame, net: Net, plan: Schedule, path: str | None = None) -> Fit:
    """Trains on nodes (node_id, x), edges (src, dst, rel) and supervised rows (node_id, split, target, ``<task>_label``).

    ``split`` is train, test, val or null; ``target`` holds a mass for each set of the frame. The rate falls when the
    validation loss stays on a plateau, and training ends after ``patience`` epochs without a better one. With ``path``
    the best weights so far are written there. Edges must have no dropped relations or cross-split ends left.
    """
    graph = _Graph(nodes, edges, net)
    targets = _targets(supervised, net, plan.mass_smoothing).persist()
    try:
        return _fit(graph, targets, net, plan, path)
    finally:
        targets.unpersist()
        graph.close()


def _fit(graph: _Graph, targets: DataFrame, net: Net, plan: Schedule, path: str | None) -> Fit:
    spark = targets.sparkSession
    size = targets.where("split = 'train'").count()
    if not size:
        raise ValueError("there is no training row")
    weights, adam = net.initial(plan.seed), _AdamW(plan, net.shapes())
    batches = math.ceil(size / plan.batch_size) if plan.batch_size else 1
    slow = plan.plateau_patience if plan.plateau_patience is not None else max(1, plan.patience // 3)
    best, best_epoch, best_loss, bad, flat_best, flat = weights, 0, math.inf, 0, math.inf, 0
    history: list[dict[str, float]] = []
    for epoch in range(1, plan.epochs + 1):
        for k in range(batches):
            of_batch = F.pmod(F.xxhash64(F.lit(plan.seed + epoch), F.col("node_id").cast("string")), F.lit(batches)) == k
            inside = (F.col("split") == "train") & (of_batch if batches > 1 else F.lit(True))
            draw = Draw(net.dropout, (plan.seed * 1_000_003 + epoch) * 4099 + k)
            grads = _step(graph, targets, inside, _Kernels(net, weights, draw), plan)
            if plan.l1:
                grads = {n: g + plan.l1 / batches * np.sign(weights[n]) for n, g in grads.items()}
            weights = adam.step(weights, grads)
        with Stages(spark) as stages:
            found = metrics(_outputs(graph, _Kernels(net, weights), stages), targets, net, weights, plan)
        history.append({"epoch": epoch, "learning_rate": adam.rate, **{f"{s}_{k}": v for s, row in sorted(found.items()) for k, v in sorted(row.items())}})
        loss = found.get("val", {}).get("loss", math.nan)
        # A plateau is a loss that isn't lower by a ten-thousandth of the lowest.
        flat_best, flat = (loss, 0) if loss < flat_best * (1 - 1e-4) else (flat_best, flat + 1)
        if plan.plateau and flat > slow:
            adam.rate, flat = adam.rate * plan.plateau_factor, 0
        if loss < best_loss - plan.min_delta:
            best, best_epoch, best_loss, bad = weights, epoch, loss, 0
            if path:
                write_document(spark, f"{path}/best_model.json", {"epoch": epoch, "val_loss": loss, "weights": {n: w.tolist() for n, w in weights.items()}})
        else:
            bad += 1
        if bad >= plan.patience:
            break
    if not best_epoch:  # without a validation row the last epoch counts
        best, best_epoch = weights, len(history)
    return Fit(best, weights, history, best_epoch)


def score(nodes: DataFrame, edges: DataFrame, net: Net, weights: Weights) -> DataFrame:
    """node_id, masses, uncertainty and each task's scores, as ``network.predictions`` takes them (masses are null without their head). The layers' tables stay until the folder is cleared."""
    graph, kernels = _Graph(nodes, edges, net), _Kernels(net, weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                _, masses, unknown, tasks = kernels.scores(_matrix(b, "h"), b.column("key").to_numpy())
                known = pa.array(unknown, pa.float64()) if unknown is not None else pa.nulls(b.num_rows, pa.float64())
                sets = _lists(masses) if masses is not None else pa.nulls(b.num_rows, pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column("node_id"), sets, known, *map(_lists, tasks.values())], names=["node_id", "masses", "uncertainty", *tasks])

    encoded = _outputs(graph, kernels, Stages(nodes.sparkSession))
    graph.close()
    return encoded.mapInArrow(run, _schema(encoded, ("masses", _VECTOR), ("uncertainty", T.DoubleType()), *[(t, _VECTOR) for t in net.tasks]))


def schedule(section: Mapping[str, object]) -> Schedule:
    """A schedule out of the training section of a run's settings, checked."""
    one = lambda name: setting(section, name)
    return Schedule(
        epochs=int(one("epochs")), batch_size=int(one("batch_size")), learning_rate=one("learning_rate"), weight_decay=one("weight_decay"), mass_smoothing=one("mass_label_smoothing"),
        class_smoothing=one("classification_label_smoothing"), class_weight=one("classification_loss_weight"), task_weights=one("classification_task_loss_weights"),
        penalty=one("confidence_penalty_weight"), l1=one("l1_lambda"), max_norm=one("max_grad_norm"), plateau=bool(section.get("reduce_lr_on_plateau", True)),
        plateau_factor=one("lr_factor"), plateau_patience=None if section.get("lr_patience") is None else int(section["lr_patience"]), patience=int(one("patience")),
        min_delta=one("early_stopping_min_delta"), seed=int(one("seed")),
    )


def pooled(scored: DataFrame, series: DataFrame, tasks: Mapping[str, Sequence[str]]) -> DataFrame:
    """series_id, nodes, and for each task label, probability and probabilities: the mean over a series' nodes (node_id, series_id).

    Sums combine on the map side, so a series may be as long as it likes.
    """
    rows = scored.join(series.select("node_id", "series_id"), "node_id").withColumns({f"__{t}": M.softmax(F.col(t)) for t in tasks})
    sums = rows.groupBy("series_id").agg(F.count("*").alias("nodes"), *[F.avg(F.col(f"__{t}")[i]).alias(f"__{t}{i}") for t, names in tasks.items() for i in range(len(names))])
    means = sums.select("series_id", "nodes", *[F.array(*[F.col(f"__{t}{i}") for i in range(len(names))]).alias(t) for t, names in tasks.items()])
    cells = [
        F.struct(F.element_at(F.array(*[F.lit(c) for c in names]), M.argmax(F.col(t)) + 1).alias("label"), F.array_max(t).alias("probability"), F.col(t).alias("probabilities")).alias(t)
        for t, names in tasks.items()
    ]
    return means.select("series_id", "nodes", *cells)
