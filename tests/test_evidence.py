"""Evidence algebra: stated values and laws."""

import random

import pytest
from pyspark.sql import functions as F

from credence.functions import masses as M
from credence.functions import scores as S


def row(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def arr(*v):
    return F.array(*[F.lit(float(x)) for x in v])


def test_two_hypotheses(spark):
    masks, v = M.subset_masks(2), arr(0.2, 0.3, 0.5)
    r = row(spark, b0=M.belief(v, masks, 0), p0=M.plausibility(v, masks, 0), b1=M.belief(v, masks, 1), p1=M.plausibility(v, masks, 1))
    assert [round(x, 9) for x in r] == [0.2, 0.7, 0.3, 0.8]
    c, k = M.combine(arr(0.6, 0.1, 0.3), arr(0.2, 0.7, 0.1), masks)
    got = row(spark, c=c, k=k)
    assert [round(x, 5) for x in got.c] == [0.42857, 0.51786, 0.05357] and round(got.k, 9) == 0.44
    assert row(spark, c=M.combine(arr(1, 0, 0), arr(0, 1, 0), masks)[0]).c is None
    for wrong in (M.combine(arr(1, 0, 0), arr(0, 1, 0), masks, strict=True)[0], M.validate_masses(arr(0.5, -0.1), strict=True), M.validate_masses(arr(0, 0), strict=True)):
        with pytest.raises(Exception, match="total conflict|must not be negative"):
            row(spark, c=wrong)
    assert [round(x, 9) for x in row(spark, c=M.validate_masses(arr(1, 3), strict=True)).c] == [0.25, 0.75]


def brute_combine(a, b, masks):
    """Products of all pairs of focal sets."""
    out, conflict = dict.fromkeys(masks, 0.0), 0.0
    for x, p in zip(masks, a, strict=True):
        for y, q in zip(masks, b, strict=True):
            if x & y:
                out[x & y] += p * q
            else:
                conflict += p * q
    return [v / (1 - conflict) for v in out.values()], conflict


def test_combination_equals_all_pairs_of_focal_sets(spark):
    rng = random.Random(7)
    names = ["aircraft:ab-12 a", "aircraft:ab_12b", "ab-12c", "ab/12d", "cd-1", "ef-7a", "ef-7b", "gh 3", "gh 3x", "ij-9", "kl-2"]
    for masks in (M.subset_masks(3), M.subset_masks(6), M.subset_masks(10), M.frame(names), M.subset_masks(12)):
        a, b = ([rng.random() for _ in masks] for _ in range(2))
        a, b = [x / sum(a) for x in a], [x / sum(b) for x in b]
        want, conflict = brute_combine(a, b, masks)
        df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
        c, k = M.combine(F.col("a"), F.col("b"), masks)
        got = df.select(c.alias("c"), k.alias("k"), M.plausibility(F.col("a"), masks, 1).alias("pl")).first()
        assert max(abs(x - y) for x, y in zip(got.c, want, strict=True)) < 1e-9 and abs(got.k - conflict) < 1e-9
        assert abs(got.pl - sum(x for x, m in zip(a, masks, strict=True) if m & 2)) < 1e-9


def test_types_and_frames_of_names():
    keys = {"aircraft:Su-27/SK": "su-27", "su_27_ub": "su-27", "MiG-29": "mig-29", "F-16C": "f-16", "Rafale C": "rafale c", "B-2A_Spirit": "b-2", "Tornado-IDS": "tornado", "4x-1": "4x"}
    assert {k: M.type_key(k) for k in keys} == keys
    names = [f"su-27{x}" for x in "abcd"] + ["b-1", "f-16a", "f-16b", "j_10a", "j_10b", "x", "y"]
    masks = M.frame(names)
    assert len(masks) == 11 + 3 + 1 and masks[11:] == [0b1111, 0b1100000, 0b110000000, (1 << 11) - 1]


def test_fusion_keeps_the_conflict_of_each_step(spark):
    masks = M.subset_masks(3)
    rng = random.Random(9)
    vs = []
    for _ in range(4):
        raw = [rng.random() for _ in masks]
        vs.append([x / sum(raw) for x in raw])
    m, k = M.fuse(F.col("v"), masks)
    got = spark.createDataFrame([(vs,), (vs[:1],), ([],)], "v array<array<double>>").select(m.alias("m"), k.alias("k")).collect()
    state, steps = vs[0], []
    for v in vs[1:]:
        state, c = brute_combine(state, v, masks)
        steps.append(c)
    assert max(abs(x - y) for x, y in zip(got[0].m + got[0].k, state + steps, strict=True)) < 1e-9
    assert got[1].m == vs[0] and got[1].k == [] and got[2].m is None


def test_times(spark):
    r = row(spark, a=S.iso_utc(S.parse_utc(F.lit("2024-03-01T12:00:00.250+02:00"))), b=S.parse_utc(F.lit("")), c=S.parse_utc(F.lit("soon")), d=S.iso_utc(S.parse_utc(F.lit("2024-03-01T12:00:00Z"))))
    assert (r.a, r.b, r.c, r.d) == ("2024-03-01T10:00:00.250Z", None, None, "2024-03-01T12:00:00.000Z")
    lo, hi = S.numeric_range(F.lit(25), 0.1, whole=True)
    assert tuple(row(spark, a=lo, b=hi, t=M.singleton_target(F.lit(1), 2, powerset=True), d=M.dirichlet(arr(800, 0))[0])[:3]) == (22, 28, [0.0, 0.85, 0.15])


def test_frames():
    types = ["a", "a", "a", "a", "b", "c", "c", "d", "d", "e", "f"]
    assert M.grouped_type_masks(types) == [0b1111, 0b1100000, 0b110000000]
    assert len(M.subset_masks(11, types)) == 11 + 3 + 1 and M.subset_masks(3) == list(range(1, 8))
    assert M.masks_for_length(7) == list(range(1, 8)) and len(M.masks_for_length(15, 14)) == 15 and len(M.masks_for_length(12)) == 12
    assert M.subset_masks(12, ["x"] * 12)[-1] == (1 << 12) - 1 and len(M.subset_masks(12, ["x"] * 12)) == 13
    with pytest.raises(ValueError):
        M.subset_masks(0)
    with pytest.raises(ValueError):
        M.masks_for_length(9, 3)


def test_fusion_is_order_free_and_equals_combination(spark):
    rng = random.Random(1)
    masks = M.subset_masks(2)
    vs = []
    for _ in range(4):
        raw = [rng.random() for _ in masks]
        vs.append([x / sum(raw) for x in raw])
    folded = arr(*vs[0])
    for v in vs[1:]:
        folded, _ = M.combine(folded, arr(*v), masks)
    q = {m: F.lit(1.0) for m in masks}
    for v in random.Random(2).sample(vs, 4):
        q = {m: q[m] * M.commonality(arr(*v), masks, m) for m in masks}
    cells = M.from_commonality(q, masks)
    total = sum(cells, F.lit(0.0))
    r = row(spark, a=folded, b=F.array(*[c / total for c in cells]))
    assert all(abs(x - y) < 1e-9 for x, y in zip(r.a, r.b, strict=True)) and abs(sum(r.a) - 1) < 1e-9


def test_vectors(spark):
    r = row(
        spark, ok=M.validate_masses(arr(0.2, -1e-9, 0.2)), bad=M.validate_masses(arr(0.2, -0.1, 0.9)), none=M.validate_masses(arr(0, 0, 0)),
        smooth=M.smooth(arr(1, 0, 0, 0), 0.2), soft=M.softmax(arr(1000, 1000)), arg=M.argmax(arr(1, 3, 3)), kl=M.kl_divergence(arr(0.5, 0.5, 0), arr(0.5, 0.5, 0)),
        target=M.singleton_target(F.lit(1), 3), masses=S.masses_from_score(F.lit(0.8), F.lit(0.25)),
    )
    assert [round(x, 9) for x in r.ok] == [0.5, 0.0, 0.5] and r.bad is None and r.none is None
    assert [round(x, 9) for x in r.smooth] == [0.85, 0.05, 0.05, 0.05] and r.soft == [0.5, 0.5] and r.arg == 1 and r.kl == 0
    assert r.target == [0.0, 0.85, 0.0, 0.15] and r.masses == [0.15, 0.6, 0.25]
    d = row(spark, d=M.dirichlet(arr(0, 0))[0], u=M.dirichlet(arr(0, 0))[1])
    assert d.d == [0.5, 0.5] and 0 < d.u < 1


def test_scores(spark):
    lit = lambda *v: [F.lit(None if x is None else float(x)).cast("double") for x in v]
    r = row(
        spark, inside=S.interval_overlap(*lit(2, 3, 1, 4)), half=S.interval_overlap(*lit(2, 4, 3, 9)), point=S.interval_overlap(*lit(2, 2, 1, 4)),
        far=S.interval_overlap(*lit(1000, 1001, 1, 2)), none=S.interval_overlap(*lit(None, 1, 1, 2)), turned=S.interval_overlap(*lit(3, 2, 4, 1)),
        mean=S.mean_known([F.lit(0.5), F.lit(None).cast("double"), F.lit(1.0)]), nothing=S.mean_known([F.lit(None).cast("double")]),
        limits=F.array(*[S.limit_consistency(F.lit(t), F.lit(v), F.lit(l)) for t, v, l in ((False, 5.0, 1.0), (True, 5.0, 0.0), (True, 1.04, 1.0), (True, 4.0, 1.0))]),
        rec=S.recency(F.lit(30.0), 30.0, 0.0), old=S.recency(F.lit(None).cast("double"), 30.0, 0.25), ahead=S.recency(F.lit(-5.0), 30.0, 0.0),
        slug=S.slug(F.lit("--Vx/27 Falcon É!")), key=S.type_key(F.lit("aircraft:vx-27 falcon")),
    )
    assert (r.inside, r.half, r.none, r.turned) == (1.0, 0.5, None, 1.0) and r.point == pytest.approx(1 - 0.5 / 3) and r.far == pytest.approx(1 - 998.5 / 1000.5)
    assert (r["mean"], r.nothing) == (0.75, 0.0) and r.limits == [0.5, 1.0, 1.0, 0.25]
    assert (round(r.rec, 9), r.old, r.ahead) == (0.5, 0.25, 1.0) and r.slug == "vx_27_falcon_é" and r.key == "vx-27"
