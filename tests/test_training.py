"""Training by joins against the same model in NumPy, gradients against differences."""

import json
import math

import numpy as np
import pytest

from credence.operators import network, training
from credence.operators.training import Net, Schedule

NAMES = ("b-1", "s-2")


def small(**more):
    given = dict(hypotheses=NAMES, inputs=3, hidden=4, relations=3, layers=2, bases=2, tasks={"kind": 3, "name": 2}, gates=True, dropout=0.0) | more
    return Net(**given)


def graph(n=24, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    edges = sorted({(int(a), int(b), int(r)) for a, b, r in zip(rng.integers(0, n - 2, 60), rng.integers(0, n - 2, 60), rng.integers(0, 3, 60), strict=True)})
    masses = rng.dirichlet([1, 1, 1], n)
    kind, name = rng.integers(-1, 3, n), rng.integers(-1, 2, n)
    split = np.array(["train", "train", "test", "val", None] * n)[:n]
    return x, edges, masses, kind, name, split


def frames(spark, g):
    x, edges, masses, kind, name, split = g
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node_id long, x array<double>").repartition(3)
    links = spark.createDataFrame(edges, "src long, dst long, rel int").repartition(3)
    rows = [(i, split[i], masses[i].tolist(), int(kind[i]) if kind[i] >= 0 else None, int(name[i])) for i in range(len(x))]
    return nodes, links, spark.createDataFrame(rows, "node_id long, split string, target array<double>, kind_label int, name_label int")


def erf(x):
    return np.vectorize(math.erf)(x)


def gelu(x):
    return x * 0.5 * (1 + erf(x / math.sqrt(2)))


def layer_norm(x):
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + 1e-5)


def loss_of(net, w, g, plan, chosen, penalty=True):
    """The loss, written plainly; gradients come by differences of it."""
    x, edges, masses, kind, name, _ = g
    scaled = lambda k, y: layer_norm(y) * w[f"{k}.gain"] + w[f"{k}.shift"] if net.normal else y
    h = gelu(scaled("entry", x @ w["entry.w"] + w["entry.b"]))
    for k in range(net.layers):
        matrix = np.einsum("rb,bio->rio", w[f"layer{k}.mix"], w[f"layer{k}.bases"])
        out = h @ w[f"layer{k}.own"] + w[f"layer{k}.bias"]
        for d in range(len(x)):
            inbound = [h[s] @ matrix[r] * (1 / (1 + np.exp(-w[f"layer{k}.gates"][r])) if net.gates else 1) for s, t, r in edges if t == d]
            if inbound:
                out[d] += np.sum(inbound, axis=0) / len(inbound)
        y = scaled(f"layer{k}", gelu(out))
        h = h + y if net.residual else y
    head = lambda k: gelu(h @ w[f"{k}.w"] + w[f"{k}.b"]) @ w[f"{k}.w2"] + w[f"{k}.b2"] if net.head_hidden else h @ w[f"{k}.w"] + w[f"{k}.b"]
    z = head("mass") if net.mass else np.zeros((len(x), 3))
    alpha = np.log1p(np.exp(z)) + 1
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True) if net.kind == "softmax" else alpha / alpha.sum(1, keepdims=True)
    target = masses * (1 - plan.mass_smoothing) + plan.mass_smoothing / 3
    kl = (target * (np.log(target) - np.log(p))).sum(1)[chosen].mean() if net.mass else 0.0
    scores = {"kind": head("task.kind"), "name": np.stack([p[:, 0] + p[:, 2] / 2, p[:, 1] + p[:, 2] / 2], 1) if net.mass else head("task.name")}
    classes, calm = 0.0, -(p * np.log(p)).sum(1)[chosen].mean() if net.mass else 0.0
    for t, label in (("kind", kind), ("name", name)):
        q = np.exp(scores[t]) / np.exp(scores[t]).sum(1, keepdims=True)
        known = chosen & (label >= 0)
        s, c = plan.class_smoothing, q.shape[1]
        ce = -((1 - s) * np.log(q[np.arange(len(q)), label]) + s / c * np.log(q).sum(1))
        classes += plan.task_weights.get(t, 1.0) * ce[known].mean()
        calm += -(q * np.log(q)).sum(1)[chosen].mean()
    out = kl + plan.class_weight * classes
    return out - plan.penalty * calm if penalty else out


def differences(f, w, step=1e-6):
    out = {}
    for name, value in w.items():
        flat = np.zeros(value.size)
        for i in range(value.size):
            both = []
            for s in (step, -step):
                moved = value.copy()
                moved.ravel()[i] += s
                both.append(f(w | {name: moved}))
            flat[i] = (both[0] - both[1]) / (2 * step)
        out[name] = flat.reshape(value.shape)
    return out


@pytest.mark.parametrize("more", [{}, {"kind": "dirichlet", "residual": False, "gates": False}, {"normal": False, "layers": 1}, {"head_hidden": 5}, {"mass": False, "head_hidden": 3, "layers": 1}])
def test_gradients_equal_differences(spark, more):
    net, g = small(**more), graph()
    plan = Schedule(penalty=0.1, class_weight=0.7, task_weights={"kind": 2.0}, mass_smoothing=0.05)
    w = net.initial(3)
    w = {n: v + np.random.default_rng(len(n)).normal(size=v.shape) * 0.1 for n, v in w.items()}
    nodes, links, rows = frames(spark, g)
    chosen = g[5] == "train"
    got = training.gradients(nodes, links, rows.where("split = 'train'"), net, w, plan)
    want = differences(lambda v: loss_of(net, v, g, plan, chosen), w)
    assert set(got) == set(net.shapes())
    for name in want:
        assert np.allclose(got[name], want[name], atol=2e-7), name


def test_losses_of_an_epoch_equal_numpy(spark):
    """Three epochs: the losses of each split, with AdamW, clipping and L1 done plainly."""
    net, g = small(layers=1), graph()
    plan = Schedule(epochs=3, learning_rate=0.02, max_norm=0.5, l1=1e-3, seed=5)
    nodes, links, rows = frames(spark, g)
    fit = training.fit(nodes, links, rows, net, plan)
    w, first, second = net.initial(5), {}, {}
    for epoch in range(1, 4):
        grads = differences(lambda v: loss_of(net, v, g, plan, g[5] == "train"), w)
        grads = {n: v + plan.l1 * np.sign(w[n]) for n, v in grads.items()}
        norm = math.sqrt(sum((v**2).sum() for v in grads.values()))
        for n in w:
            v = grads[n] * min(1.0, 0.5 / (norm + 1e-6))
            first[n] = 0.9 * first.get(n, 0) + 0.1 * v
            second[n] = 0.999 * second.get(n, 0) + 0.001 * v**2
            w[n] = w[n] * (1 - 0.02 * 1e-4) - 0.02 * (first[n] / (1 - 0.9**epoch)) / (np.sqrt(second[n] / (1 - 0.999**epoch)) + 1e-8)
        for split in ("train", "test", "val"):
            assert abs(fit.history[epoch - 1][f"{split}_loss"] - loss_of(net, w, g, plan, g[5] == split, penalty=False)) < 1e-6
    assert fit.history[2]["train_loss"] < fit.history[0]["train_loss"] and fit.history[0]["learning_rate"] == 0.02


def test_only_the_training_split_is_learnt(spark):
    net, g = small(layers=1), graph()
    nodes, links, rows = frames(spark, g)
    other = rows.selectExpr("node_id", "split", "if(split = 'train', target, array(1.0D, 0.0D, 0.0D)) as target", "if(split = 'train', kind_label, 0) as kind_label", "if(split = 'train', name_label, 1) as name_label")
    plan = Schedule(epochs=2, patience=9)
    one, two = (training.fit(nodes, links, r, net, plan) for r in (rows, other))
    assert all(np.allclose(one.last[n], two.last[n], atol=1e-12) for n in one.last)


def test_batches_dropout_plateau_and_stop(spark, tmp_path):
    net, g = small(layers=1, dropout=0.3), graph()
    nodes, links, rows = frames(spark, g)
    plan = Schedule(epochs=30, batch_size=4, learning_rate=0.5, patience=2, plateau_patience=0, min_delta=0.0)
    fit = training.fit(nodes, links, rows, net, plan, path=str(tmp_path))
    assert len(fit.history) < 30 and fit.best_epoch == len(fit.history) - 2
    assert fit.history[-1]["learning_rate"] < 0.5
    saved = json.loads((tmp_path / "best_model.json").read_text())
    assert saved["epoch"] == fit.best_epoch and np.allclose(saved["weights"]["mass.w"], fit.best["mass.w"])
    assert math.isclose(saved["val_loss"], min(r["val_loss"] for r in fit.history))
    again = training.fit(nodes.repartition(1), links, rows, net, Schedule(epochs=1, batch_size=4, learning_rate=0.5))
    assert math.isclose(again.history[0]["val_loss"], fit.history[0]["val_loss"], rel_tol=1e-9)


def test_scores_feed_predictions(spark):
    net, g = small(kind="dirichlet"), graph()
    nodes, links, _ = frames(spark, g)
    found = network.predictions(training.score(nodes, links, net, net.initial(1)), net, {"kind": ["x", "y", "z"], "name": list(NAMES)}).collect()
    assert len(found) == 24 and all(abs(sum(r.masses) - 1) < 1e-9 and 0 < r.uncertainty <= 1 for r in found)
    assert {r.classifications.name.label for r in found} <= set(NAMES)


def test_series_are_pooled(spark):
    net, g = small(mass=False, head_hidden=3), graph()
    nodes, links, _ = frames(spark, g)
    scored = training.score(nodes, links, net, net.initial(1)).cache()
    series = nodes.selectExpr("node_id", "node_id % 5 as series_id")
    got = {r.series_id: r for r in training.pooled(scored, series, {"kind": ["x", "y", "z"], "name": list(NAMES)}).collect()}
    by_node = {r.node_id: np.exp(r.kind) / np.exp(r.kind).sum() for r in scored.collect()}
    assert len(got) == 5 and scored.where("masses is not null").count() == 0
    for k, r in got.items():
        mean = np.mean([p for i, p in by_node.items() if i % 5 == k], axis=0)
        assert np.allclose(r.kind.probabilities, mean) and r.kind.label == "xyz"[int(mean.argmax())] and r.nodes == sum(i % 5 == k for i in by_node)


def test_no_edges_no_training_rows(spark):
    net, g = small(layers=1), graph(6)
    nodes, links, rows = frames(spark, g)
    assert len(training.fit(nodes, links.limit(0), rows, net, Schedule(epochs=1)).history) == 1
    with pytest.raises(ValueError, match="training row"):
        training.fit(nodes, links, rows.where("split = 'val'"), net, Schedule(epochs=1))


def test_forms_that_can_not_be():
    for more in (dict(kind="sum"), dict(tasks={"a": 1}), dict(tasks={"a.b": 2}), dict(hypotheses=()), dict(layers=0), dict(dropout=1.0), dict(bases=0), dict(mass=False, tasks={})):
        with pytest.raises(ValueError):
            small(**more)
    for bad in (dict(mass_smoothing=1.5), dict(penalty=-1.0), dict(task_weights={"a": -1.0})):
        with pytest.raises(ValueError):
            Schedule(**bad)


def test_schedule_out_of_settings():
    plan = training.schedule({"epochs": 3, "lr_patience": 2, "classification_task_loss_weights": {"kind": 4}})
    assert (plan.epochs, plan.plateau_patience, plan.task_weights, plan.l1) == (3, 2, {"kind": 4.0}, 1e-5)
    with pytest.raises(ValueError):
        training.schedule({"max_grad_norm": -1})
