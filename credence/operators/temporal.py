"""Operators over ordered observations of a series, and over nested records."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credence.sources.views import in_series


def temporal_edges(observations: DataFrame, segment: str) -> DataFrame:
    """source, target, type: next and previous, two apart, and whether the segment goes on.

    One window over the series; each row then gives its links, so the observations are read and shuffled once.
    """
    w = in_series()
    rows = observations.select(
        F.col("observation_id").alias("a"), F.lead("observation_id").over(w).alias("b"), F.lead("observation_id", 2).over(w).alias("c"),
        F.when(F.col(segment) == F.lead(segment).over(w), "SAME_MODE_SEGMENT").otherwise("POSSIBLE_MODE_SHIFT").alias("kind"),
    )
    link = lambda s, t, name: F.struct(F.col(s).alias("source"), F.col(t).alias("target"), name.alias("type"))
    links = F.array(
        link("a", "b", F.lit("NEXT_OBSERVATION")), link("b", "a", F.lit("PREV_OBSERVATION")), link("a", "c", F.lit("SAME_EMITTER")),
        link("c", "a", F.lit("SAME_EMITTER")), link("a", "b", F.col("kind")),
    )
    return rows.select(F.explode(links).alias("e")).select("e.*").where("source is not null and target is not null")


def segments(series: DataFrame, value: str, jump: float) -> DataFrame:
    """Running count of steps of more than ``jump``; nulls never jump."""
    w = Window.partitionBy("series_id").orderBy("sequence_index")
    step = F.abs(F.col(value) - F.lag(value).over(w)) > jump
    marked = series.withColumn("__jump", F.when(step, 1).otherwise(0))
    return marked.withColumn("segment", F.sum("__jump").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__jump")


def shifts(series: DataFrame, mode: str) -> DataFrame:
    """Observations whose mode is not the one before."""
    before = F.lag(mode).over(Window.partitionBy("series_id").orderBy("sequence_index"))
    return series.withColumn("__before", before).where(F.col("__before") != F.col(mode)).drop("__before")


def _without(col: Column, kind: T.DataType, names: Collection[str]) -> Column:
    if isinstance(kind, T.StructType):
        kept = [f for f in kind.fields if f.name not in names]
        return F.when(col.isNotNull(), F.struct(*[_without(col[f.name], f.dataType, names).alias(f.name) for f in kept]))
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: _without(x, kind.elementType, names))
    return col


def strip_fields(rows: DataFrame, names: Collection[str]) -> DataFrame:
    """``rows`` without the named fields at any depth; the schema says where they are, the data are not looked at."""
    kept = [f for f in rows.schema.fields if f.name not in names]
    return rows.select(*[_without(F.col(f.name), f.dataType, names).alias(f.name) for f in kept])


def numeric_leaves(kind: T.StructType, prefix: str = "") -> list[str]:
    """Dotted names of the numeric fields at any depth, booleans excluded."""
    out = []
    for f in kind.fields:
        if isinstance(f.dataType, T.StructType):
            out += numeric_leaves(f.dataType, f"{prefix}{f.name}.")
        elif isinstance(f.dataType, T.NumericType):
            out.append(prefix + f.name)
    return out


def flatten_numeric(rows: DataFrame) -> DataFrame:
    """The numeric fields at any depth as doubles, under their dotted names; null reads as 0."""
    return rows.select(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in numeric_leaves(rows.schema)])
