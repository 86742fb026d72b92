import zlib

import numpy as np

from credence.llm import quality as Q
from tests.llm.conftest import prose


def corpus():
    docs, labels = [], []
    for i in range(500):
        good = i % 4 != 0
        t = prose(i, 40 + i % 50)
        if not good:
            t = (t.upper().replace(" ", "!! "), " | ".join(t.split()), "spam " * (40 + i % 50), t.replace(" ", "&&& "))[i // 4 % 4]
        docs.append((i, t))
        labels.append((i, int(good)))
    return docs, labels


def test_held_out_documents(spark, odd, empty):
    docs, labels = corpus()
    d = spark.createDataFrame([*docs, (900, None), (901, ""), (None, prose(1, 50)), (1, docs[1][1])], "doc_id long, text string")
    t = spark.createDataFrame([*labels, labels[0], (3, None), (None, 1)], "doc_id long, quality int")
    got = Q.classify(d, t).collect()
    truth = dict(labels)
    assert len(got) == 504
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.97
    kept = Q.keep_good(odd, t)
    assert kept.columns == odd.columns and 1 in {r.doc_id for r in kept.collect()}
    assert Q.classify(empty, t).count() == 0 and Q.keep_good(empty, t).count() == 0


def test_held_out_labels_are_never_read(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    a, b = (sorted((r.doc_id, r.score) for r in Q.classify(d, spark.createDataFrame(x, "doc_id long, quality int")).collect()) for x in (labels, turned))
    assert a == b


def test_preferences_order_scores():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] - 0.5 * x[:, 3] > -0.4).astype(int)
    model = Q.calibrate(Q.fit(x, y, pairs=4000, rounds=200), y, float((y == 0).mean()))
    assert np.mean((Q.apply(model, x) >= Q.THRESHOLD) == y) >= 0.95


def test_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in Q.classify(odd, none).collect()} == {1.0}
    one = spark.createDataFrame([(i, 0) for i in range(1, 9)], "doc_id long, quality int")
    assert {r.score for r in Q.classify(odd, one).collect()} == {0.0}


def test_features_equal_a_plain_count():
    text = "One two two THREE 44 | | | five.\n\nOne two ~ six\nOne two ~ six"
    letters = [c for c in text if c.isalpha()]
    symbols = [c for c in text if not c.isalnum() and not c.isspace() and c not in ".,;:'\"()-"]
    words, lines, n = text.split(), [x for x in text.split("\n") if x], len(text)
    pairs = list(zip(words, words[1:], strict=False))
    got = Q.features(text)
    want = {
        0: np.log1p(len(words)), 1: sum(c.isupper() for c in letters) / len(letters), 2: 2 / n, 3: sum(c.isspace() for c in text) / n, 4: 1 / n, 5: len(symbols) / n,
        6: symbols.count("|") / n, 10: len(set(words)) / len(words), 11: len(set(pairs)) / len(pairs), 12: sum(a == b for a, b in pairs) / len(pairs),
        14: np.mean([len(w) for w in words]) / 10, 17: sum(w.isalpha() for w in words) / len(words), 18: len(set(lines)) / len(lines), 20: 1 / len(lines),
    }
    for k, v in want.items():
        assert np.isclose(got[k], v), k


def test_weights_minimise_the_loss_of_all_pairs():
    """With few documents every pair is drawn often: the fit is near the least loss over all pairs, found by plain descent."""
    rng = np.random.default_rng(4)
    y = np.array([1] * 12 + [0] * 9)
    x = rng.normal(size=(21, 3)) + 0.8 * y[:, None]
    model = Q.fit(x, y, pairs=20_000)
    z = Q._widen(x, model["mean"], model["std"])
    diff = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, z.shape[1])

    def loss(w):
        return np.log1p(np.exp(-diff @ w)).mean() + 5e-4 * w @ w

    w = np.zeros(z.shape[1])
    for _ in range(20_000):
        w += 0.05 * ((1 / (1 + np.exp(diff @ w))) @ diff / len(diff) - 1e-3 * w)
    assert loss(model["w"]) < loss(w) + 0.02
    better = (model["raw"][y == 1][:, None] > model["raw"][y == 0][None]).mean()
    assert better >= ((z @ w)[y == 1][:, None] > (z @ w)[y == 0][None]).mean() - 0.03
