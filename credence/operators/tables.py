"""Keyed unions, upserts, and checks of keys and links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the first in order. Aggregates on the map side, so no key is gathered."""
    rest = [c for c in rows.columns if c != key]
    least = F.min(F.struct(order, *[c for c in rest if c != order])).alias("row")
    return rows.groupBy(key).agg(least).select(key, *[F.col(f"row.{c}").alias(c) for c in rest])


def upsert(base: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Full outer merge: a key's new row sets each column it has, a null in it removes the old value; other columns stay."""
    shared = [c for c in base.columns if c in rows.columns and c != key]
    merged = base.alias("b").join(rows.withColumn("__new", F.lit(True)).alias("r"), key, "full")
    given = F.col("r.__new").isNotNull()
    cols = [F.when(given, F.col(f"r.{c}")).otherwise(F.col(f"b.{c}")).alias(c) if c in shared else F.col(f"b.{c}") for c in base.columns if c != key]
    new = [F.col(f"r.{c}") for c in rows.columns if c not in base.columns]
    return merged.select(key, *cols, *new)


def upsert_edges(edges: DataFrame, sources: DataFrame, targets: DataFrame, order: Sequence[str]) -> DataFrame:
    """Edges with both ends known; of several (source, type, target) the last one's properties."""
    known = edges.join(sources, "source", "left_semi").join(targets, "target", "left_semi")
    props = [c for c in edges.columns if c not in ("source", "type", "target")]
    last = F.max(F.struct(*order, *[c for c in props if c not in order])).alias("row")
    return known.groupBy("source", "type", "target").agg(last).select("source", "type", "target", *[F.col(f"row.{c}").alias(c) for c in props])


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Keys that break uniqueness, with their counts."""
    return rows.groupBy(key).count().where("count > 1")


def missing_links(rows: DataFrame, column: str, known: DataFrame, key: str) -> DataFrame:
    """Distinct values of a column that are no key of the other table."""
    return rows.select(F.col(column).alias("id")).where("id is not null").distinct().join(known.select(F.col(key).alias("id")), "id", "left_anti")
