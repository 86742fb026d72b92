"""Fusion by levels, votes by an interval index, frames as bit masks."""

import random

import pytest
from pyspark.sql import functions as F

from credence.functions import masses as M
from credence.operators import frames, fusion, ranges

NAMES = ["ab-12a", "ab-12b", "cd-1", "ef-7a", "ef-7b", "ef-7c", "gh-3", "ij-9", "kl-2", "mn-4", "op-5"]


def conjunctive(vectors, masks):
    """Products of all focal sets, one vector after the other: masses not scaled, without what conflicts."""
    now = dict(zip(masks, vectors[0], strict=True))
    for v in vectors[1:]:
        out = dict.fromkeys(masks, 0.0)
        for x, p in now.items():
            for y, q in zip(masks, v, strict=True):
                if x & y and p * q:
                    out[x & y] += p * q
        now = out
    return list(now.values())


def drawn(rng, masks, n, zeros):
    out = []
    for _ in range(n):
        v = [0.0 if rng.random() < zeros else rng.random() for _ in masks]
        v = v if sum(v) else [1.0] * len(masks)
        out.append([x / sum(v) for x in v])
    return out


@pytest.mark.parametrize("masks,zeros", [(M.subset_masks(2), 0.4), (M.subset_masks(5), 0.8), (M.subset_masks(6), 0.9), (M.frame(NAMES), 0.5)])
def test_levels_equal_stepwise_rule(spark, masks, zeros):
    rng = random.Random(len(masks))
    rows = [(r, s, g, v) for r in "ab" for s in range(3) for g in range(2) for v in drawn(rng, masks, rng.randint(1, 3), zeros)]
    df = spark.createDataFrame(rows, "radar string, series int, segment int, m array<double>").repartition(4)
    got = {(x.level, tuple(x.key)): x for x in fusion.levels(df, ["segment", "series", "radar"], "m", masks).collect()}
    assert len(got) == 12 + 6 + 2
    for depth, level in ((3, "segment"), (2, "series"), (1, "radar")):
        for key in {r[:3][:depth] for r in [(a, b, c) for a, b, c, _ in rows]}:
            inside = [r for r in rows if r[:depth] == key]
            left = conjunctive([r[3] for r in inside], masks)
            found = got[level, tuple(map(str, key))]
            assert found.n == len(inside)
            if sum(left) <= 1e-300:
                assert found.masses is None and found.conflict == 1.0
                continue
            assert max(abs(a - b / sum(left)) for a, b in zip(found.masses, left, strict=True)) < 1e-9
            apart = 1.0
            if depth < 3:
                for child in {r[: depth + 1] for r in inside}:
                    apart *= sum(conjunctive([r[3] for r in inside if r[: depth + 1] == child], masks))
            assert abs(found.conflict - (1 - sum(left) / apart)) < 1e-9


def test_total_conflict_has_no_masses(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("a", [0.0, 1.0, 0.0]), ("b", [1.0, 0.0, 0.0]), ("b", None), ("c", None)], "k string, m array<double>")
    got = {r.key[0]: r for r in fusion.levels(df, ["k"], "m", M.subset_masks(2)).collect()}
    assert got["a"].masses is None and got["a"].conflict == 1.0 and got["a"].n == 2
    assert list(got["b"].masses) == [1.0, 0.0, 0.0] and got["b"].conflict == 0.0 and "c" not in got
    with pytest.raises(ValueError):
        fusion.levels(df, [], "m", M.subset_masks(2))


def test_many_rows_do_not_vanish(spark):
    df = spark.range(20_000).select(F.lit(1).alias("k"), F.array(F.lit(0.3), F.lit(0.2), F.lit(0.5)).alias("m"))
    row = fusion.levels(df, ["k"], "m", M.subset_masks(2)).first()
    assert row.n == 20_000 and abs(row.masses[0] - 1) < 1e-9 and row.conflict == 1.0


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_agreements_equal_all_pairs(spark, least):
    rng = random.Random(least)

    def side(n, spread):
        out = []
        for i in range(n):
            cells = []
            for f in range(4):
                low = rng.uniform(-50, 50) * (f + 1)
                cells += [None, 1.0] if rng.random() < 0.1 else [low, low + rng.choice([0.0, rng.uniform(0, spread), rng.uniform(0, 40)])]
            out.append((i, *cells, rng.choice([1, 2, 3, None]), rng.choice(["x", "y", None])))
        return out

    obs, modes = side(120, 5), side(40, 20)
    bounds = ", ".join(f"{x}{f} double" for f in range(4) for x in ("@l", "@h"))
    left = spark.createDataFrame(obs, f"o int, {bounds.replace('@', 'o')}, oc int, od string")
    right = spark.createDataFrame(modes, f"m int, {bounds.replace('@', 'm')}, mc int, md string")
    fields = [(f"ol{f}", f"oh{f}", f"ml{f}", f"mh{f}") for f in range(4)]
    agreed = ranges.agreements(left, right, "o", "m", fields, [("oc", "mc"), ("od", "md")], least)

    def votes(a, b):
        n = sum(None not in (a[1 + 2 * f], b[1 + 2 * f]) and a[1 + 2 * f] <= b[2 + 2 * f] and b[1 + 2 * f] <= a[2 + 2 * f] for f in range(4))
        return n + sum(a[k] is not None and a[k] == b[k] for k in (9, 10))

    want = {(a[0], b[0]): votes(a, b) for a in obs for b in modes if votes(a, b) >= least}
    assert {(r.o, r.m): r.votes for r in agreed.collect()} == want
    full = ranges.compatible(agreed, left, right, "o", "m").collect()
    alone = {a[0] for a in obs} - {o for o, _ in want}
    assert len(full) == len(want) + len(alone) * len(modes) and {r.o for r in full if r.votes is None} == alone


def test_agreements_need_fields(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0)], "o int, l double, h double")
    for least in (0, 2):
        with pytest.raises(ValueError):
            ranges.agreements(df, df.withColumnRenamed("o", "m"), "o", "m", [("l", "h", "l", "h")], [], least)


def test_frames_are_sets(spark):
    rng = random.Random(3)
    names = [f"n{i:03d}" for i in range(150)]
    rows = [(g, rng.choice(names)) for g in range(5) for _ in range(rng.randint(1, 90))]
    df = spark.createDataFrame(rows, "g int, x string")
    known = spark.createDataFrame([(n,) for n in names], "x string")
    vocabulary = frames.vocabulary(known, "x")
    width = frames.words(150)
    one = df.join(F.broadcast(vocabulary), df.x == vocabulary.name).groupBy("g").agg(*frames.collect(F.col("index"), width)).select("g", frames.collected(width).alias("f"))
    listed = one.crossJoin(frames.listing(vocabulary))
    out = {r.g: r for r in listed.select("g", frames.size(F.col("f")).alias("n"), frames.members(F.col("f"), F.col("names")).alias("m"), frames.members(frames.without(frames.everything(F.lit(150), width), F.col("f")), F.col("names")).alias("rest")).collect()}
    for g in range(5):
        want = {x for k, x in rows if k == g}
        assert out[g].n == len(want) and out[g].m == sorted(want) and out[g].rest == sorted(set(names) - want)
    both = one.where("g < 2").agg(*frames.unite(F.col("f"), width)).select(frames.size(frames.collected(width))).first()[0]
    assert both == len({x for k, x in rows if k < 2})


def test_gate_falls_back(spark):
    modes = spark.createDataFrame([("r1", 0.0, 10.0), ("r2", 5.0, 20.0), ("r3", 30.0, 40.0)], "radar_id string, klo double, khi double")
    carriers = spark.createDataFrame([("r1", "a"), ("r2", "b"), ("r2", "c")], "radar_id string, carrier_id string")
    points = spark.createDataFrame([(1, 3.0), (2, 7.0), (3, 35.0), (4, 99.0), (5, None)], "id int, v double")
    gate = frames.gated(points, modes, carriers, "id", "v", 8.0)
    names = frames.listing(frames.vocabulary(carriers, "carrier_id")).select(F.col("names").alias("c")).crossJoin(frames.listing(frames.vocabulary(modes, "radar_id")).select(F.col("names").alias("r")))
    got = {x.id: (x.a, x.b, x.used_fallback) for x in gate.crossJoin(names).select("id", frames.members(F.col("radars"), F.col("r")).alias("a"), frames.members(F.col("carriers"), F.col("c")).alias("b"), "used_fallback").collect()}
    everything = (["r1", "r2", "r3"], ["a", "b", "c"], True)
    assert got == {1: (["r1"], ["a"], False), 2: (["r1", "r2"], ["a", "b", "c"], False), 3: everything, 4: everything, 5: everything}
