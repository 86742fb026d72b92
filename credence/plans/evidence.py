"""Queries of evidence algebra over mass vectors from the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.functions import masses as M
from credence.functions.scores import r6
from credence.operators import fusion
from credence.plans import twins as T
from credence.plans.registry import query
from credence.sources import views as V

SEVEN = M.subset_masks(3)
THREE = M.subset_masks(2)


def _raw(i: int) -> str:
    return f"round(abs(x[{i}]) + 1e-9, 6)"


def _masses_sql(n: int, name: str) -> str:
    cells = ", ".join(f"{_raw(i)} AS r{i}" for i in range(1, n + 1))
    total = "(" + " + ".join(f"r{i}" for i in range(1, n + 1)) + ")"
    scaled = ", ".join(f"r{i} / {total} AS {name}{i}" for i in range(1, n + 1))
    return f"{name}s AS (SELECT node_id, label, {scaled} FROM (SELECT node_id, label, {cells} FROM vecs) WHERE {total} > 1e-6)"


def masses(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    return V.vectors(spark, sf_dir).select("node_id", "label", M.validate_masses(V.raw_masses(n)).alias("m")).where("m is not null")


def _cells(column, n: int, name: str) -> list:
    return [r6(F.element_at(column, i)).alias(f"{name}{i}") for i in range(1, n + 1)]


def _cells_sql(n: int, name: str) -> str:
    return ", ".join(f"round({name}{i} + 1e-9, 6) AS {name}{i}" for i in range(1, n + 1))


@query(f"WITH {T.VECS}, {_masses_sql(7, 'm')} SELECT node_id, {_cells_sql(7, 'm')} FROM ms")
def mass_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masses(spark, sf_dir, 7).select("node_id", *_cells(F.col("m"), 7, "m"))


def _pl_sql(h: int, masks: list[int]) -> str:
    return " + ".join(f"m{i + 1}" for i, m in enumerate(masks) if m >> h & 1)


_BP = ", ".join(
    f"round(m{SEVEN.index(1 << h) + 1} + 1e-9, 6) AS bel{h}, round({_pl_sql(h, SEVEN)} + 1e-9, 6) AS pl{h}, round((m{SEVEN.index(1 << h) + 1} + {_pl_sql(h, SEVEN)}) / 2 + 1e-9, 6) AS mid{h}"
    for h in range(3)
)


@query(f"WITH {T.VECS}, {_masses_sql(7, 'm')} SELECT node_id, {_BP} FROM ms")
def belief_plausibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Belief, plausibility and their mean of each of three hypotheses."""
    m, cols = F.col("m"), []
    for h in range(3):
        bel, pl = M.belief(m, SEVEN, h), M.plausibility(m, SEVEN, h)
        cols += [r6(bel).alias(f"bel{h}"), r6(pl).alias(f"pl{h}"), r6((bel + pl) / 2).alias(f"mid{h}")]
    return masses(spark, sf_dir, 7).select("node_id", *cols)


@query(f"""WITH {T.VECS}, {_masses_sql(7, 'm')}, iv AS (SELECT node_id, unnest([{{'bel': round(m1 + 1e-9, 6), 'h': 0, 'pl': round(m1 + m7 + 1e-9, 6)}},
  {{'bel': round(m2 + 1e-9, 6), 'h': 1, 'pl': round(m2 + m7 + 1e-9, 6)}}, {{'bel': round(m4 + 1e-9, 6), 'h': 2, 'pl': round(m4 + m7 + 1e-9, 6)}}]) AS s FROM ms),
  rk AS (SELECT node_id, s.h AS h, s.bel AS bel, s.pl AS pl, row_number() OVER (PARTITION BY node_id ORDER BY s.bel DESC, s.h) AS place FROM iv) SELECT node_id, place, h, bel, pl FROM rk WHERE place <= 2""")
def interval_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Singletons with the whole frame as uncertainty, the two of highest belief first."""
    m = F.col("m")
    cells = [(0, 1), (1, 2), (2, 4)]
    parts = F.array(*[F.struct((-r6(F.element_at(m, c))).alias("neg"), F.lit(h).alias("h"), r6(F.element_at(m, c) + F.element_at(m, 7)).alias("pl")) for h, c in cells])
    top = F.slice(F.array_sort(parts), 1, 2)
    rows = masses(spark, sf_dir, 7).select("node_id", F.posexplode(top).alias("pos", "s"))
    return rows.select("node_id", (F.col("pos") + 1).cast("long").alias("place"), F.col("s.h").alias("h"), (-F.col("s.neg")).alias("bel"), F.col("s.pl").alias("pl"))


def _combine_sql(masks: list[int]) -> tuple[list[str], str]:
    cells, conflict = {m: ["0"] for m in masks}, ["0"]
    for i, x in enumerate(masks):
        for j, y in enumerate(masks):
            term = f"a.m{i + 1} * b.m{j + 1}"
            (cells[x & y] if x & y else conflict).append(term)
    return [" + ".join(cells[m]) for m in masks], " + ".join(conflict)


_CELLS, _CONFLICT = _combine_sql(SEVEN)


@query(f"""WITH {T.VECS}, {_masses_sql(7, 'm')}, pr AS (SELECT a.node_id, {_CONFLICT} AS conflict, {", ".join(f"{c} AS c{i + 1}" for i, c in enumerate(_CELLS))}
  FROM ms a JOIN ms b ON b.node_id = a.node_id + 1)
  SELECT node_id, round(conflict + 1e-9, 6) AS conflict, {", ".join(f"round(c{i} / (1 - conflict) + 1e-9, 6) AS c{i}" for i in range(1, 8))} FROM pr WHERE 1 - conflict > 1e-12""")
def dempster_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dempster's rule on each vector and the next one."""
    ms = masses(spark, sf_dir, 7).select("node_id", "m")
    nxt = ms.select((F.col("node_id") - 1).alias("node_id"), F.col("m").alias("n"))
    c, conflict = M.combine(F.col("m"), F.col("n"), SEVEN)
    return ms.join(nxt, "node_id").select("node_id", conflict.alias("k"), c.alias("c")).where("c is not null").select(
        "node_id", r6(F.col("k")).alias("conflict"), *_cells(F.col("c"), 7, "c")
    )


#: Eleven names of six types, three of which several share: a compact frame of 15 focal sets.
NAMES = ("ab-12a", "ab-12b", "ab-12c", "ab-12d", "cd-1", "ef-7a", "ef-7b", "gh-3a", "gh-3b", "ij-9", "kl-2")
COMPACT = M.frame(NAMES)
THIRTY_ONE = M.subset_masks(5)


def _pair_sql(masks: list[int]) -> str:
    cells, conflict = _combine_sql(masks)
    n = len(masks)
    return f"""WITH {T.VECS}, {_masses_sql(n, 'm')}, pr AS (SELECT a.node_id, {conflict} AS conflict, {", ".join(f"{c} AS c{i + 1}" for i, c in enumerate(cells))} FROM ms a JOIN ms b ON b.node_id = a.node_id + 1)
  SELECT node_id, round(conflict + 1e-9, 6) AS conflict, {", ".join(f"round(c{i} / (1 - conflict) + 1e-9, 6) AS c{i}" for i in range(1, n + 1))} FROM pr WHERE 1 - conflict > 1e-12"""


def _with_next(spark: SparkSession, sf_dir: str, masks: list[int]) -> DataFrame:
    ms = masses(spark, sf_dir, len(masks)).select("node_id", "m")
    nxt = ms.select((F.col("node_id") - 1).alias("node_id"), F.col("m").alias("n"))
    c, conflict = M.combine(F.col("m"), F.col("n"), masks)
    met = ms.join(nxt, "node_id").select("node_id", conflict.alias("k"), c.alias("c")).where("c is not null")
    return met.select("node_id", r6(F.col("k")).alias("conflict"), *_cells(F.col("c"), len(masks), "c"))


@query(_pair_sql(COMPACT))
def dempster_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dempster's rule in a frame of eleven hypotheses, three groups of one type and the whole."""
    return _with_next(spark, sf_dir, COMPACT)


@query(_pair_sql(THIRTY_ONE))
def dempster_powerset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dempster's rule over all 31 subsets of five hypotheses."""
    return _with_next(spark, sf_dir, THIRTY_ONE)


def _q_sql(masks: list[int], x: int) -> str:
    return " + ".join(f"m{i + 1}" for i, y in enumerate(masks) if y & x == x)


def _fused_sql(masks: list[int]) -> tuple[str, str, str]:
    """Sums of a group, commonalities over their largest, and masses not scaled, in SQL; zeros are counted, not clamped."""
    sums = ", ".join(f"sum(CASE WHEN q{x} > 0 THEN ln(q{x}) ELSE 0 END) AS l{x}, sum((q{x} <= 0)::INT) AS z{x}" for x in masks)
    top = "greatest(" + ", ".join(f"CASE WHEN z{x} = 0 THEN l{x} END" for x in masks) + ")"
    scaled = ", ".join(f"CASE WHEN z{x} = 0 THEN exp(l{x} - top) ELSE 0 END AS s{x}" for x in masks)
    cells = ", ".join("greatest(0.0::DOUBLE, " + " ".join(f"{'-' if (y.bit_count() - x.bit_count()) % 2 else '+'} s{y}" for y in masks if y & x == x) + f") AS u{x}" for x in masks)
    return sums, f"{top} AS top", f"{scaled}|{cells}"


def _levels_sql(masks: list[int], base: str, levels: list[tuple[str, list[str]]]) -> str:
    sums, top, rest = _fused_sql(masks)
    scaled, cells = rest.split("|")
    total = "(" + " + ".join(f"u{x}" for x in masks) + ")"
    parts = [base, "q AS (SELECT *, " + ", ".join(f"{_q_sql(masks, x)} AS q{x}" for x in masks) + " FROM evidence)"]
    for k, (name, keys) in enumerate(levels):
        by = ", ".join(keys)
        parts.append(f"g{k} AS (SELECT {by}, count(*) AS n, {sums} FROM q GROUP BY {by})")
        parts.append(f"f{k} AS (SELECT *, top + ln({total}) AS kept FROM (SELECT *, {cells} FROM (SELECT *, {scaled} FROM (SELECT *, {top} FROM g{k}))))")
        apart = "SELECT *, 0.0::DOUBLE AS apart FROM f0" if not k else f"SELECT f.*, a.apart FROM f{k} f JOIN (SELECT {by}, CASE WHEN count(*) = count(kept) THEN sum(kept) END AS apart FROM f{k - 1} GROUP BY {by}) a USING ({by})"
        parts.append(f"r{k} AS ({apart})")
    out = []
    for k, (name, keys) in enumerate(levels):
        key = " || '/' || ".join(f"{c}::VARCHAR" for c in reversed(keys))
        masses_ = ", ".join(f"round(CASE WHEN top IS NOT NULL THEN u{x} / {total} END + 1e-9, 6) AS c{i + 1}" for i, x in enumerate(masks))
        out.append(f"SELECT '{name}' AS level, {key} AS key, n, round(CASE WHEN kept IS NULL THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - exp(kept - apart)) END + 1e-9, 6) AS conflict, {masses_} FROM r{k}")
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(out)


@query(_levels_sql(THREE, f"{T.VECS}, {_masses_sql(3, 'm')}, evidence AS (SELECT * FROM ms)", [("label", ["label"])]))
def dempster_series_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of a label fused at once, in any order and partially aggregated; total conflict has no masses."""
    found = fusion.levels(masses(spark, sf_dir, 3), ["label"], "m", THREE)
    return found.select("level", F.array_join("key", "/").alias("key"), "n", r6(F.col("conflict")).alias("conflict"), *_cells(F.col("masses"), 3, "c"))


_FIRM = 0.16


@query(_levels_sql(
    THIRTY_ONE,
    f"""{T.VECS}, firm AS (SELECT node_id, label, list_transform(x[1:31], lambda v: CASE WHEN abs(v) >= {_FIRM}::DOUBLE THEN round(abs(v) + 1e-9, 6) ELSE 0 END) AS r FROM vecs),
  evidence AS (SELECT label AS radar, node_id % 7 AS series, (node_id // 7) % 5 AS segment, {", ".join(f"r[{i + 1}] / list_sum(r) AS m{i + 1}" for i in range(31))} FROM firm WHERE list_sum(r) > 1e-6)""",
    [("segment", ["segment", "series", "radar"]), ("series", ["series", "radar"]), ("radar", ["radar"])],
))
def fusion_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence over all subsets of five hypotheses fused by segment, then series, then radar, with the conflict that each level brings."""
    firm = F.transform(F.slice("x", 1, 31), lambda v: F.when(F.abs(v) >= _FIRM, r6(F.abs(v))).otherwise(0.0))
    rows = V.vectors(spark, sf_dir).select(
        F.col("label").alias("radar"), (F.col("node_id") % 7).alias("series"), (F.floor(F.col("node_id") / 7) % 5).alias("segment"), M.validate_masses(firm).alias("m")
    )
    found = fusion.levels(rows, ["segment", "series", "radar"], "m", THIRTY_ONE)
    return found.select("level", F.array_join("key", "/").alias("key"), "n", r6(F.col("conflict")).alias("conflict"), *_cells(F.col("masses"), 31, "c"))


_AL = ", ".join(f"ln(1 + exp(x[{i}])) + 1 AS a{i}" for i in range(1, 6))
_ALS = "(a1 + a2 + a3 + a4 + a5)"


@query(f"WITH {T.VECS}, a AS (SELECT node_id, {_AL} FROM vecs) SELECT node_id, {', '.join(f'round(a{i} / {_ALS} + 1e-9, 6) AS e{i}' for i in range(1, 6))}, round(5 / {_ALS} + 1e-9, 6) AS uncertainty FROM a")
def dirichlet_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean, unknown = M.dirichlet(F.slice("x", 1, 5))
    return V.vectors(spark, sf_dir).select("node_id", mean.alias("e"), unknown.alias("u")).select("node_id", *_cells(F.col("e"), 5, "e"), r6(F.col("u")).alias("uncertainty"))


_TGT = ", ".join(f"CASE WHEN label = {i} THEN 0.85 ELSE 0.0 END::DOUBLE AS t{i + 1}" for i in range(10))


@query(f"SELECT vec_id AS node_id, {_TGT}, 0.15::DOUBLE AS t11 FROM embeddings")
def target_masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most mass on the true hypothesis, the rest on the whole frame."""
    t = M.singleton_target(F.col("label"), 10)
    return V.vectors(spark, sf_dir).select("node_id", t.alias("t")).select("node_id", *[F.element_at("t", i).alias(f"t{i}") for i in range(1, 12)])


@query(f"WITH {T.VECS}, {_masses_sql(3, 'm')} SELECT node_id, {', '.join(f'round(0.8::DOUBLE * m{i} + 0.2::DOUBLE / 3 + 1e-9, 6) AS m{i}' for i in (1, 2, 3))} FROM ms")
def smooth_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masses(spark, sf_dir, 3).select("node_id", M.smooth(F.col("m"), 0.2).alias("s")).select("node_id", *_cells(F.col("s"), 3, "m"))
