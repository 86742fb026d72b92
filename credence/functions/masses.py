"""Mass vectors on a frame of discernment, and vector arithmetic, as column expressions.

A frame of n hypotheses lists its focal sets as bit masks: all subsets up to ten hypotheses, beyond that
singletons, groups of hypotheses of one type, and the whole frame. Expressions stay small whatever the frame:
sums over focal sets are products with literal arrays, and Dempster's rule runs over commonalities.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

POWERSET_LIMIT = 10


def type_key(name: str) -> str:
    """The type of a variant's name: letters and the number after them ("ab-12"), else what stands before its first mark."""
    tokens = [t for t in re.split(r"[/_-]+", name.removeprefix("aircraft:").lower()) if t]
    if not tokens:
        return name.removeprefix("aircraft:").lower()
    digits = re.sub(r"\D", "", tokens[1]) if len(tokens) > 1 and tokens[0].isalpha() and tokens[1].isalnum() else ""
    return f"{tokens[0]}-{digits}" if digits else tokens[0]


def frame(hypotheses: Sequence[str]) -> list[int]:
    """The focal sets of named hypotheses; beyond the limit, groups are those of one type."""
    return subset_masks(len(hypotheses), [type_key(h) for h in hypotheses])


def grouped_type_masks(types: Sequence[str]) -> list[int]:
    """Masks of the types that two or more hypotheses share, in order of their first members."""
    members: dict[str, int] = {}
    for i, t in enumerate(types):
        members[t] = members.get(t, 0) | (1 << i)
    return [m for m in members.values() if m.bit_count() >= 2]


def subset_masks(n: int, types: Sequence[str] | None = None) -> list[int]:
    if n < 1:
        raise ValueError("a frame needs one hypothesis at least")
    if n <= POWERSET_LIMIT:
        return list(range(1, 1 << n))
    full = (1 << n) - 1
    groups = [m for m in grouped_type_masks(types or []) if m != full]
    return [1 << i for i in range(n)] + groups + [full]


def masks_for_length(length: int, hypotheses: int | None = None) -> list[int]:
    """The frame of a vector; a length that is a powerset's is read as one unless the hypotheses are given."""
    n = hypotheses or (length + 1).bit_length() - 1
    if hypotheses is None and (1 << n) - 1 != length:
        n = length - 1
    masks = subset_masks(n)
    if len(masks) != length:
        raise ValueError(f"no frame of {n} hypotheses has {length} focal sets")
    return masks


def vec_sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def validate_masses(v: Column, strict: bool = False) -> Column:
    """Clipped at zero and scaled to one; null, or an error if ``strict``, where an entry is below -1e-6 or nothing is left."""
    clipped = F.transform(v, lambda x: F.greatest(x, F.lit(0.0)))
    total = vec_sum(clipped)
    bad = F.exists(v, lambda x: x < -1e-6) | (total <= 1e-6)
    fine = F.transform(clipped, lambda x: F.try_divide(x, total))
    return F.when(bad, F.raise_error(F.lit("masses must not be negative, and one must be positive"))).otherwise(fine) if strict else F.when(~bad, fine)


def belief(v: Column, masks: Sequence[int], hypothesis: int) -> Column:
    return F.element_at(v, masks.index(1 << hypothesis) + 1)


def _sum_where(v: Column, flags: Sequence[bool]) -> Column:
    return dot(v, F.array(*[F.lit(float(f)) for f in flags]))


def plausibility(v: Column, masks: Sequence[int], hypothesis: int) -> Column:
    """Sum of the masses of all focal sets that the hypothesis is in."""
    return _sum_where(v, [bool(m >> hypothesis & 1) for m in masks])


def is_powerset(masks: Sequence[int]) -> bool:
    return list(masks) == list(range(1, len(masks) + 1)) and (len(masks) + 1).bit_count() == 1


def _let(x: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _zeta(v: Column, n: int, sign: float) -> Column:
    """Sums over supersets (sign 1) of a vector over all subsets, the empty one included, or their inverse (sign -1)."""
    def one_bit(acc: Column, step: Column) -> Column:
        return F.transform(acc, lambda x, i: F.when(i.bitwiseAND(step) == 0, x + sign * F.element_at(acc, i + 1 + step)).otherwise(x))

    return F.aggregate(F.array(*[F.lit(1 << bit) for bit in range(n)]), v, one_bit)


#: Frames up to so many hypotheses have their sums over supersets written out: 3^n terms.
WRITTEN_OUT = 6


def _supersets(cell, masks: Sequence[int], inverse: bool = False) -> list[Column]:
    """For each mask the sum of cells over its supersets, or with ``inverse`` the sum that undoes it."""
    sign = lambda x, y: -1 if inverse and (y.bit_count() - x.bit_count()) % 2 else 1
    return [reduce(lambda s, c: s + c, [cell(y) if sign(x, y) > 0 else -cell(y) for y in masks if y & x == x]) for x in masks]


def _combine_written(a: Column, b: Column, masks: Sequence[int]) -> Column:
    """Products of commonalities, turned back into masses, without passes over arrays."""
    left, right = (_supersets(lambda y, v=v: F.element_at(v, y), masks) for v in (a, b))
    q = F.array(*[x * y for x, y in zip(left, right, strict=True)])
    return _let(q, lambda v: F.array(*[F.greatest(c, F.lit(0.0)) for c in _supersets(lambda y: F.element_at(v, y), masks, inverse=True)]))


def combine(a: Column, b: Column, masks: Sequence[int], strict: bool = False) -> tuple[Column, Column]:
    """Dempster's rule: (combined masses, conflict). Null masses, or an error if ``strict``, under total conflict.

    Over all subsets commonalities multiply, and n passes each way turn masses into them and back. In a
    compact frame a singleton meets itself, its group and the whole frame, a group itself and the whole.
    """
    if is_powerset(masks) and len(masks) < 1 << WRITTEN_OUT:
        cells = _combine_written(a, b, masks)
    elif is_powerset(masks):
        n = (len(masks) + 1).bit_length() - 1
        q = F.zip_with(_zeta(F.concat(F.array(F.lit(0.0)), a), n, 1.0), _zeta(F.concat(F.array(F.lit(0.0)), b), n, 1.0), lambda x, y: x * y)
        # Differences of sums of products may fall short of zero by rounding.
        cells = F.transform(F.slice(_zeta(q, n, -1.0), 2, len(masks)), lambda x: F.greatest(x, F.lit(0.0)))
    else:
        full = masks[-1]
        group = {i: k for k, m in enumerate(masks) if m != full and m.bit_count() > 1 for i in range(m.bit_length()) if m >> i & 1}
        if any(m != full and m.bit_count() > 1 and x != m and x & m and x.bit_count() > 1 and x != full for m in masks for x in masks):
            raise ValueError("groups of a compact frame must not overlap")
        out = []
        whole_a, whole_b = F.element_at(a, len(masks)), F.element_at(b, len(masks))
        for k, m in enumerate(masks):
            x, y = F.element_at(a, k + 1), F.element_at(b, k + 1)
            if m == full:
                out.append(x * y)
                continue
            over = group.get(m.bit_length() - 1) if m.bit_count() == 1 else None
            more_a = whole_a + F.element_at(a, over + 1) if over is not None else whole_a
            more_b = whole_b + F.element_at(b, over + 1) if over is not None else whole_b
            out.append(x * y + x * more_b + y * more_a)
        cells = F.array(*out)
    none = F.raise_error(F.lit("total conflict: the masses have nothing in common")).cast("array<double>") if strict else F.lit(None).cast("array<double>")
    total = vec_sum(a) * vec_sum(b)

    def scaled(c: Column) -> Column:
        kept = vec_sum(c)
        out = F.when(kept > 1e-12, F.transform(c, lambda x: F.try_divide(x, kept))).otherwise(none)
        return F.struct(out.alias("m"), F.greatest(F.lit(0.0), total - kept).alias("k"))

    both = _let(cells, scaled)
    return both["m"], both["k"]


def commonality(v: Column, masks: Sequence[int], mask: int) -> Column:
    """Sum of the masses of all focal sets that contain ``mask``; products of these fuse evidence in any order."""
    return _sum_where(v, [m & mask == mask for m in masks])


def fuse(vectors: Column, masks: Sequence[int]) -> tuple[Column, Column]:
    """Dempster's rule over an array of vectors: (fused masses, conflict of each step). Null masses under total conflict."""
    def step(state: Column, v: Column) -> Column:
        def next_state(both: Column) -> Column:
            return F.struct(both["m"].alias("m"), F.concat(state["k"], F.array(both["k"])).alias("k"))

        out, conflict = combine(state["m"], v, masks)
        return _let(F.struct(out.alias("m"), conflict.alias("k")), next_state)

    first = F.struct(F.element_at(vectors, 1).alias("m"), F.array().cast("array<double>").alias("k"))
    rest = F.slice(vectors, F.lit(2), F.greatest(F.size(vectors) - 1, F.lit(0)))
    fused = F.when(F.size(vectors) > 0, F.aggregate(rest, first, step))
    return fused["m"], fused["k"]


def from_commonality(q: dict[int, Column], masks: Sequence[int]) -> list[Column]:
    """Unnormalised masses from commonalities by Moebius inversion."""
    out = []
    for m in masks:
        cell = F.lit(0.0)
        for x in masks:
            if x & m == m:
                cell = cell + (-1) ** (x.bit_count() - m.bit_count()) * q[x]
        out.append(cell)
    return out


def softmax(v: Column) -> Column:
    top = F.array_max(v)
    powers = F.transform(v, lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / vec_sum(powers))


def dirichlet(v: Column) -> tuple[Column, Column]:
    """(expected masses, uncertainty) of evidence logits: alpha = softplus + 1."""
    # log(1 + e^x) without overflow.
    alpha = F.transform(v, lambda x: F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))) + 1)
    total = vec_sum(alpha)
    return F.transform(alpha, lambda a: a / total), F.size(v) / total


def smooth(v: Column, amount: float) -> Column:
    return F.transform(v, lambda x: (1 - amount) * x + F.lit(amount) / F.size(v))


def entropy(p: Column) -> Column:
    return vec_sum(F.transform(p, lambda x: -x * F.log(F.greatest(x, F.lit(1e-9)))))


def kl_divergence(target: Column, p: Column) -> Column:
    """Row's sum of t * (log t - log p); zero targets add nothing."""
    return vec_sum(F.zip_with(target, p, lambda t, q: F.when(t > 0, t * (F.log(t) - F.log(F.greatest(q, F.lit(1e-9))))).otherwise(0.0)))


def argmax(v: Column) -> Column:
    """Place of the first largest entry, from 0."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def singleton_target(index: Column, n: int, unknown: float = 0.15, powerset: bool = False) -> Column:
    """1 - unknown on one hypothesis, unknown on the whole, of a compact frame or of all subsets."""
    if powerset:
        one = F.pow(F.lit(2), index).cast("long")
        return F.transform(F.sequence(F.lit(1), F.lit((1 << n) - 1)), lambda m: F.when(m == one, 1 - unknown).when(m == (1 << n) - 1, unknown).otherwise(0.0))
    return F.transform(
        F.sequence(F.lit(0), F.lit(n)), lambda i: F.when(i == index, 1 - unknown).when(i == n, unknown).otherwise(0.0)
    )
