import math

import numpy as np

from credence.llm import hnsw


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, score double, dim string, shard string")


def brute(rows, k):
    ok = {}
    for i, v, *_ in rows:
        if i is not None and v and all(e is not None and math.isfinite(e) for e in v) and any(v):
            ok[i] = np.array(v)
    out = {}
    for q in ok:
        if q % 20 == 0:
            near = [(-float(ok[q] @ x), i) for i, x in ok.items() if i != q and len(x) == len(ok[q])]
            out[q] = [(i, -s) for s, i in sorted(near)[:k]]
    return out


def run(df, **more):
    got = {}
    for r in hnsw.search(df, df.where("vec_id % 20 = 0"), **more).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return got


def test_recall_on_clusters_and_lengths(spark):
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(12, 16))
    rows = [(i, (centers[i % 12] + 0.4 * rng.normal(size=16)).tolist(), 0, 0.0, "x", "y") for i in range(1600)]
    got, want = run(table(spark, rows), min_shards=3), brute(rows, 20)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.95
    assert all(math.isclose(s, float(np.dot(rows[i][1], rows[q][1])), rel_tol=1e-12) for q in got for i, s in got[q])


def test_odd_rows_and_ties(spark):
    same = [1.0, 2.0, 0.0]
    rows = [(i, same, 0, 0.0, "x", "y") for i in range(60)]
    rows += [(100, None, 0, 0.0, "x", "y"), (120, [0.0, 0.0, 0.0], 0, 0.0, "x", "y"), (140, [1.0, None, 2.0], 0, 0.0, "x", "y"), (160, [float("nan"), 1.0, 1.0], 0, 0.0, "x", "y")]
    rows += [(180, [float("inf"), 1.0, 1.0], 0, 0.0, "x", "y"), (200, [], 0, 0.0, "x", "y"), (None, same, 0, 0.0, "x", "y"), (220, [1.0, 1.0], 0, 0.0, "x", "y"), (221, [1.0, 2.0], 0, 0.0, "x", "y")]
    rows += [rows[0], (40, same, 0, 0.0, "x", "y")]
    got = run(table(spark, rows), min_shards=2)
    assert got == brute(rows, 20)
    assert [i for i, _ in got[0]] == list(range(1, 21)) and [i for i, _ in got[220]] == [221]


def test_empty(spark):
    assert hnsw.search(table(spark, []), table(spark, [])).count() == 0


def test_different_vectors_of_one_id(spark):
    rows = [(0, [1.0, 0.0], 0, 0.0, "x", "y"), (0, [0.0, 1.0], 0, 0.0, "x", "y"), (1, [2.0, 0.0], 0, 0.0, "x", "y"), (1, [0.0, 3.0], 0, 0.0, "x", "y")]
    assert run(table(spark, rows), min_shards=2) == run(table(spark, rows[::-1]), min_shards=2) == {0: [(1, 3.0), (1, 0.0)]}


def test_tight_clusters_are_all_reached():
    """Clusters wider apart than links reach, in one shard: no query finds nothing of its own cluster."""
    for clusters, size in ((12, 900), (50, 100), (110, 45), (3, 2000)):
        rng = np.random.default_rng(clusters)
        x = (rng.normal(size=(clusters, 16)) * 3)[np.repeat(np.arange(clusters), size)] + 0.01 * rng.normal(size=(clusters * size, 16))
        unit = hnsw._same_norm(x)
        graph = hnsw.Graph(unit)
        recalls = []
        for i in range(0, len(x), 97):
            q = np.append(x[i] / np.linalg.norm(x[i]), 0.0)
            want = set(np.argsort(-(x @ x[i]), kind="stable")[:20].tolist())
            found = graph.nearest(q, hnsw.EF_SEARCH)
            recalls.append(len(want & set(found[np.argsort(-(x[found] @ x[i]), kind="stable")][:20].tolist())) / 20)
        assert min(recalls) > 0 and np.mean(recalls) >= 0.95, (clusters, size, min(recalls), np.mean(recalls))
