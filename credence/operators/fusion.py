"""Evidence of many rows fused at once, level by level.

Dempster's rule multiplies commonalities, so a group's evidence is three sums that merge in any order: for each focal
set the logarithms of its positive commonalities, how many were exactly zero, and the number of rows. A commonality of
zero stays zero whatever else is fused. The largest commonality belongs to a single hypothesis and is no more than the
mass that is left beside the conflict, so nothing cancels: a group is in total conflict just where every hypothesis has
a zero, and its masses are null there.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.functions import masses as M

#: Sums stand side by side up to so many focal sets, as rows beyond: generated code holds a hundred columns.
WIDE = 31


def _hypotheses(masks: Sequence[int]) -> int:
    return max(masks).bit_length()


def commonalities(masses: Column, masks: Sequence[int]) -> Column:
    """For each focal set the sum of the masses of the sets that contain it."""
    if M.is_powerset(masks):
        return F.slice(M._zeta(F.concat(F.array(F.lit(0.0)), masses), _hypotheses(masks), 1.0), 2, len(masks))
    return F.array(*[M.commonality(masses, masks, x) for x in masks])


def from_commonalities(q: Column, masks: Sequence[int]) -> Column:
    """The masses, not scaled, that have these commonalities."""
    if M.is_powerset(masks):
        return F.slice(M._zeta(F.concat(F.array(F.lit(0.0)), q), _hypotheses(masks), -1.0), 2, len(masks))
    # In a compact frame a set lies in its group, if it has one, and in the whole; groups do not overlap.
    def above(k: int) -> Column:
        over = [j for j, m in enumerate(masks) if m != masks[k] and m & masks[k] == masks[k]]
        return F.element_at(q, min(over, key=lambda j: masks[j].bit_count()) + 1) if over else F.lit(0.0)

    return F.array(*[F.element_at(q, k + 1) - above(k) for k in range(len(masks))])


def _summed(rows: DataFrame, keys: Sequence[str], width: int, logs: Column, zeros: Column, n: Column) -> DataFrame:
    """keys, logs, zeros and n of the rows' arrays and numbers, added up."""
    own = rows.select(*keys, logs.alias("__l"), zeros.alias("__z"), n.alias("__n"))
    if width <= WIDE:
        cells = [F.sum(F.col(a)[i]).alias(f"{a}{i}") for a in ("__l", "__z") for i in range(width)]
        out = own.groupBy(*keys).agg(*cells, F.sum("__n").alias("n"))
        return out.select(*keys, *[F.array(*[F.col(f"{a}{i}") for i in range(width)]).alias(name) for a, name in (("__l", "logs"), ("__z", "zeros"))], "n")
    each = own.select(*keys, "__n", F.posexplode(F.arrays_zip("__l", "__z")).alias("at", "c"))
    sums = each.groupBy(*keys, "at").agg(F.sum("c.__l").alias("l"), F.sum("c.__z").alias("z"), F.sum("__n").alias("n"))
    # As many entries as the frame has focal sets.
    cell = F.array_sort(F.collect_list(F.struct("at", "l", "z")))
    lists = sums.groupBy(*keys).agg(cell.alias("c"), F.max("n").alias("n"))
    return lists.select(*keys, F.transform("c", lambda x: x["l"]).alias("logs"), F.transform("c", lambda x: x["z"]).alias("zeros"), "n")


def gather(rows: DataFrame, keys: Sequence[str], masses: str, masks: Sequence[int]) -> DataFrame:
    """keys, logs, zeros, n: what the rows of each group say together. Rows whose masses are null add nothing."""
    q = rows.where(F.col(masses).isNotNull()).withColumn("__q", commonalities(F.col(masses), masks))
    logs = F.transform("__q", lambda x: F.when(x > 0, F.log(x)).otherwise(F.lit(0.0)))
    zeros = F.transform("__q", lambda x: (x <= 0).cast("long"))
    return _summed(q, keys, len(masks), logs, zeros, F.lit(1).cast("long"))


def merge(states: DataFrame, keys: Sequence[str], masks: Sequence[int]) -> DataFrame:
    """States of finer groups added up to those of coarser ones."""
    return _summed(states, keys, len(masks), F.col("logs"), F.col("zeros"), F.col("n"))


def _scaled(masks: Sequence[int]) -> tuple[Column, Column]:
    """Commonalities over the largest of them, and that one's logarithm; null under total conflict."""
    both = F.arrays_zip("logs", "zeros")
    top = F.array_max(F.transform(F.filter(both, lambda x: x["zeros"] == 0), lambda x: x["logs"]))
    return F.transform(both, lambda x: F.when(x["zeros"] > 0, F.lit(0.0)).otherwise(F.exp(x["logs"] - top))), top


def settled(states: DataFrame, masks: Sequence[int]) -> DataFrame:
    """``states`` with their fused ``masses`` and ``left``, the logarithm of the mass beside the conflict; both null under total conflict."""
    q, top = _scaled(masks)
    rows = states.withColumn("__top", top).withColumn("__q", q)
    rows = rows.withColumn("__m", F.when(F.col("__top").isNotNull(), F.transform(from_commonalities(F.col("__q"), masks), lambda x: F.greatest(x, F.lit(0.0)))))
    rows = rows.withColumn("__t", M.vec_sum(F.col("__m")))
    return rows.select(*states.columns, F.transform("__m", lambda x: x / F.col("__t")).alias("masses"), (F.col("__top") + F.log("__t")).alias("left"))


def levels(rows: DataFrame, names: Sequence[str], masses: str, masks: Sequence[int]) -> DataFrame:
    """level, key, n, conflict and masses of each group of each level, from the finest of ``names`` to the coarsest.

    A group of a level is named by its column and those of all coarser ones; ``key`` holds them, coarsest first.
    ``conflict`` is what the parts of the group, fused each by itself, contradict one another: rows at the finest level,
    groups of the level before at the others. It is 1, and the masses null, under total conflict.
    """
    if not names:
        raise ValueError("fusion needs one level at least")
    parts, out = None, None
    for k, name in enumerate(names):
        keys = list(names[k:])
        states = gather(rows, keys, masses, masks) if parts is None else merge(parts, keys, masks)
        found = settled(states, masks)
        if parts is None:
            # The mass of a row is 1, so its logarithm is 0.
            apart = found.withColumn("__apart", F.lit(0.0))
        else:
            known = parts.groupBy(*keys).agg(F.sum("left").alias("__apart"), F.max(F.col("left").isNull()).alias("__none"))
            same = reduce(lambda a, b: a & b, [found[c].eqNullSafe(known[c]) for c in keys])
            apart = found.join(known, same).select(*[found[c] for c in found.columns], F.when(~F.col("__none"), F.col("__apart")).alias("__apart"))
        conflict = F.when(F.col("left").isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.exp(F.col("left") - F.col("__apart"))))
        key = F.array(*[F.col(c).cast("string") for c in reversed(keys)])
        row = apart.select(F.lit(name).alias("level"), key.alias("key"), "n", conflict.alias("conflict"), "masses")
        out = row if out is None else out.unionByName(row)
        parts = found
    return out
