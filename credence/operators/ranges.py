"""Interval joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.operators.etl import spread


def point_in_interval(points: DataFrame, intervals: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs of a point and an interval around it, both ends included, as an equi join.

    An interval stands in each bin of ``width`` that it touches, a point in one; the bounds are checked
    after. So neither side needs to be small, and no pair is tried twice.
    """
    bins = F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))
    spread = intervals.where(F.col(low) <= F.col(high)).withColumn("__bin", F.explode(bins))
    return (
        points.withColumn("__bin", F.floor(F.col(point) / width))
        .join(spread, "__bin")
        .where((F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high)))
        .drop("__bin")
    )


def vote(
    observations: DataFrame, modes: DataFrame, intervals: Sequence[tuple[str, str, str, str]], equal: Sequence[tuple[str, str]], least: int
) -> DataFrame:
    """How many modes agree with an observation in ``least`` fields, the first of them, or all modes if none does.

    The modes are bounded by their templates and broadcast; votes are counted before anything is shuffled.
    """
    obs = spread(observations.withColumns({"k_lo": F.col("k") * 0.95, "k_hi": F.col("k") * 1.05}), "observation_id")
    votes = [
        F.coalesce((F.least(F.col(oh), F.col(kh)) >= F.greatest(F.col(ol), F.col(kl))).cast("int"), F.lit(0))
        for ol, oh, kl, kh in intervals
    ] + [(F.col(a) == F.col(b)).cast("int") for a, b in equal]
    agreed = reduce(lambda a, b: a + b, votes)
    hits = (
        obs.crossJoin(F.broadcast(modes)).where(agreed >= least)
        .groupBy("observation_id").agg(F.count("*").alias("n"), F.min("mode_id").alias("first_hit"))
    )
    everything = F.broadcast(modes.agg(F.count("*").alias("all"), F.min("mode_id").alias("first_of_all")))
    return (
        observations.select("observation_id").join(hits, "observation_id", "left").crossJoin(everything)
        .select(
            "observation_id", F.coalesce("n", "all").alias("compatible"), F.coalesce("first_hit", "first_of_all").alias("first_mode"), F.col("n").isNull().alias("fell_back")
        )
    )


def agreements(
    observations: DataFrame, modes: DataFrame, observation: str, mode: str, intervals: Sequence[tuple[str, str, str, str]], equal: Sequence[tuple[str, str]], least: int
) -> DataFrame:
    """(observation, mode, votes): pairs that agree in ``least`` fields or more, by an index of the interval fields.

    ``intervals`` names the bounds (low, high, low, high) of either side in each field, ``equal`` the columns of fields
    that must be the same; a null bound or value never agrees. A pair that agrees in more fields than there are equal
    ones meets in some interval, so intervals alone are indexed: each stands in the bins of its field that it touches, and
    a pair counts in the last bin of the two first ones, once a field. What pairs say is added up on the map side. With
    ``least`` no more than the equal fields, those are bins too. Bins are as wide as the mean interval of their field.
    """
    if not 1 <= least <= len(intervals) + len(equal):
        raise ValueError("the number of agreements must lie between 1 and the number of fields")
    wide = [F.avg(F.col(kh) - F.col(kl)) for *_, kl, kh in intervals]
    # One number for each field.
    widths = [max(float(w or 0.0), 1e-9) for w in modes.agg(*wide).first()] if intervals else []
    by_value = least <= len(equal)

    def interval(f: int, lo: Column, hi: Column, w: float) -> Column:
        first = F.floor(lo / w)
        return F.transform(F.sequence(first, F.floor(hi / w)), lambda b: F.struct(F.lit(f).alias("f"), b.alias("b"), lo.alias("lo"), hi.alias("hi"), first.alias("first")))

    def cells(low_high: Sequence[tuple[str, str]], values: Sequence[str]) -> Column:
        out = []
        for f, ((lo, hi), w) in enumerate(zip(low_high, widths, strict=True)):
            out.append(F.when(F.col(lo) <= F.col(hi), interval(f, F.col(lo).cast("double"), F.col(hi).cast("double"), w)))
        for f, v in enumerate(values, len(intervals)) if by_value else ():
            h = F.xxhash64(F.col(v))
            out.append(F.when(F.col(v).isNotNull(), F.array(F.struct(F.lit(f).alias("f"), h.alias("b"), F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"), h.alias("first")))))
        kind = "array<struct<f:int,b:bigint,lo:double,hi:double,first:bigint>>"
        return F.flatten(F.array(*[F.coalesce(c, F.array().cast(kind)) for c in out]))

    left = observations.select(observation, *[F.col(a).alias(f"__a{i}") for i, (a, _) in enumerate(equal)], F.explode(cells([x[:2] for x in intervals], [a for a, _ in equal])).alias("__o"))
    right = modes.select(mode, *[F.col(b).alias(f"__b{i}") for i, (_, b) in enumerate(equal)], F.explode(cells([x[2:] for x in intervals], [b for _, b in equal])).alias("__m"))
    met = left.join(right, (F.col("__o.f") == F.col("__m.f")) & (F.col("__o.b") == F.col("__m.b")))
    once = F.col("__o.b") == F.greatest(F.col("__o.first"), F.col("__m.first"))
    met = met.where(once & (F.col("__o.lo") <= F.col("__m.hi")) & (F.col("__m.lo") <= F.col("__o.hi")))
    same = [F.coalesce((F.col(f"__a{i}") == F.col(f"__b{i}")).cast("int"), F.lit(0)) for i in range(len(equal))]
    # Equal hashes alone are no agreement.
    hit = F.when(F.col("__o.f") < len(intervals), 1).otherwise(0)
    votes = F.sum(hit) + F.max(reduce(lambda a, b: a + b, same, F.lit(0)))
    return met.groupBy(observation, mode).agg(votes.alias("votes")).where(F.col("votes") >= least)


def compatible(agreed: DataFrame, observations: DataFrame, modes: DataFrame, observation: str, mode: str) -> DataFrame:
    """``agreed`` pairs, and for each observation without one all modes, with null votes. Modes are the catalogue's and broadcast."""
    alone = observations.select(observation).join(agreed.select(observation), observation, "left_anti")
    return agreed.unionByName(alone.crossJoin(F.broadcast(modes.select(mode))).select(observation, mode, F.lit(None).cast("bigint").alias("votes")))
