"""Scores of intervals, categories, limits, ages and claims as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(x: Column) -> Column:
    """Six decimals; the small shift keeps ties of both engines on one side."""
    return F.round(x + F.lit(1e-9), 6)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Held between bounds; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


#: Spreads of a mode's properties other than a tenth.
SPREADS = {"centre_frequency": 0.02, "detection_range": 0.25, "instrumented_range": 0.25, "false_alarm_rate": 0.5}


def numeric_range(value: Column, spread: float = 0.10, floor: float | None = None, ceiling: float | None = None, whole: bool = False) -> tuple[Column, Column]:
    """A nominal value to a clamped interval around it; bounds of a ``whole`` number are rounded to whole ones."""
    low, high = value * (1 - spread), value * (1 + spread)
    if floor is not None:
        low = F.greatest(low, F.lit(floor))
    if ceiling is not None:
        high = F.least(high, F.lit(ceiling))
    return (F.bround(low).cast("long"), F.bround(high).cast("long")) if whole else (low, high)


def measurement_interval(value: Column, error: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """The stated bounds if both are there, else value and error (0 if null), else null."""
    both = low.isNotNull() & high.isNotNull()
    spread = F.coalesce(error, F.lit(0.0))
    return F.when(both, low).otherwise(value - spread), F.when(both, high).otherwise(value + spread)


def interval_overlap(olow: Column, ohigh: Column, klow: Column, khigh: Column, ordered: bool = False) -> Column:
    """Overlap over the observed width; without overlap 1 less the relative distance, 0 at least. Null if any bound is.

    Bounds that are known to be in order make a much smaller expression.
    """
    ol, oh, kl, kh = olow, ohigh, klow, khigh
    if not ordered:
        ol, oh, kl, kh = F.least(olow, ohigh), F.greatest(olow, ohigh), F.least(klow, khigh), F.greatest(klow, khigh)
    overlap = F.least(oh, kh) - F.greatest(ol, kl)
    oc, kc = (ol + oh) / 2, (kl + kh) / 2
    distance = F.least(F.abs(oc - kl), F.abs(oc - kh), F.abs(oc - kc))
    scale = F.greatest(F.abs(kc), F.abs(oc), kh - kl, F.lit(1.0))
    far = F.greatest(F.lit(0.0), 1 - distance / scale)
    known = olow.isNotNull() & ohigh.isNotNull() & klow.isNotNull() & khigh.isNotNull()
    return F.when(known, F.when(overlap > 0, F.least(F.lit(1.0), F.try_divide(overlap, oh - ol))).otherwise(far))


def residual(olow: Column, ohigh: Column, klow: Column, khigh: Column) -> Column:
    oc, kc = (olow + ohigh) / 2, (klow + khigh) / 2
    return r6(F.abs(oc - kc) / F.greatest(khigh - klow, F.abs(kc), F.lit(1.0)))


def mean_known(scores: list[Column]) -> Column:
    """Mean of the scores that are not null; 0 if none is."""
    total = reduce(lambda a, b: a + b, [F.coalesce(s, F.lit(0.0)) for s in scores])
    n = reduce(lambda a, b: a + b, [s.isNotNull().cast("int") for s in scores])
    return F.coalesce(F.try_divide(total, n), F.lit(0.0))


def count_at_least(scores: list[Column], least: float) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce((s >= least).cast("int"), F.lit(0)) for s in scores])


def limit_consistency(present: Column, observed: Column, limit: Column, slack: float = 1.05) -> Column:
    """0.5 without a carrier; 1 without a limit or within it; else how far the limit reaches."""
    fine = limit.isNull() | (limit <= 0) | observed.isNull() | (observed <= slack * limit)
    return F.when(~present, 0.5).when(fine, 1.0).otherwise(F.try_divide(limit, observed))


def carrier_link(present: Column, linked: Column) -> Column:
    return F.when(~present, 0.5).when(linked, 1.0).otherwise(0.0)


def carrier_score(kinematic: Column, link: Column) -> Column:
    return 0.8 * kinematic + 0.2 * link


def external_prior(name: Column, priors: Column, more: Column, named: Column) -> Column:
    """First of two prior maps that has the name, clamped; else 1 or 0 by a list of names; else 0.5."""
    return F.coalesce(
        clamp(F.try_element_at(priors, name)),
        clamp(F.try_element_at(more, name)),
        F.when(named.isNotNull() & name.isNotNull(), F.array_contains(named, name).cast("double")),
        F.lit(0.5),
    )


def recency(age_days: Column, half_life: float, missing: float) -> Column:
    """Halves with each half-life; ages below zero count as zero."""
    halves = F.exp(-F.lit(0.6931471805599453) * F.greatest(age_days, F.lit(0.0)) / half_life)
    return F.when(age_days.isNotNull(), halves).otherwise(F.lit(missing))


def first_time(collected: Column, published: Column) -> Column:
    """When a report was true: its collection, else its publication."""
    return F.coalesce(collected, published)


def claim_score(confidence: Column, credibility: Column, age: Column, extraction: Column, prior: Column, consistency: Column, specificity: Column) -> Column:
    parts = [
        (0.25, confidence, 0.5), (0.20, credibility, 0.5), (0.15, age, 0.25), (0.15, extraction, 0.5),
        (0.10, prior, 0.5), (0.10, consistency, 0.7), (0.05, specificity, 0.7),
    ]
    return r6(reduce(lambda a, b: a + b, [w * clamp(F.coalesce(c, F.lit(d))) for w, c, d in parts]))


def masses_from_score(score: Column, ambiguity: Column) -> Column:
    """[against, for, unknown] of a score under an ambiguity held between 0.05 and 0.6."""
    u = clamp(ambiguity, 0.05, 0.6)
    match = (1 - u) * clamp(score)
    return F.array(r6(1 - u - match), r6(match), r6(u))


def days_between(later: Column, earlier: Column) -> Column:
    """Age in days of time stamps without a zone."""
    def micros(c: Column) -> Column:
        return F.unix_micros(c.cast("timestamp"))

    return (micros(later) - micros(earlier)) / F.lit(86_400_000_000.0)


def slug(x: Column) -> Column:
    """Lower case; all but letters and digits to underscores, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]", "_"), "^_+|_+$", "")


def type_key(x: Column) -> Column:
    """Type of a variant's name without a namespace: letters and the number after them ("ab-12"), else what stands before its first mark."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(x), "^[a-z_]+:", ""), "[/ _-]+", "_")
    first, second = F.regexp_extract(plain, "^_?([^_]+)", 1), F.regexp_extract(plain, "^_?[^_]+_([^_]+)", 1)
    digits = F.regexp_replace(second, "[^0-9]", "")
    return F.when(first.rlike("^[a-z]+$") & second.rlike("^[a-z0-9]+$") & (digits != ""), F.concat(first, F.lit("-"), digits)).otherwise(first)


def parse_utc(text: Column) -> Column:
    """Time of an ISO text with a zone ("Z" or an offset), in UTC; null for null, empty or other texts."""
    return F.try_to_timestamp(F.nullif(text, F.lit("")))


def iso_utc(time: Column) -> Column:
    """ISO text of a time to milliseconds, in UTC with a Z."""
    return F.date_format(F.to_utc_timestamp(time, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def dead_reckoning(lat: Column, lon: Column, heading: Column, kph: Column, seconds: Column) -> tuple[Column, Column]:
    """Position after a straight run, 111 km to a degree."""
    km = kph * seconds / 3600
    return (
        lat + km * F.cos(F.radians(heading)) / 111,
        lon + km * F.sin(F.radians(heading)) / (111 * F.greatest(F.lit(0.1), F.cos(F.radians(lat)))),
    )
