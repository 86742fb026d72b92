"""Splits of whole groups by counts, and dense numbers in the order of ids, without one task that sees all rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credence.operators import graph as G

Shares = Mapping[str, float]
SLICES = 256


def allot(strata: Sequence[int], shares: Shares) -> list[dict[str, int]]:
    """How many groups of each stratum, given their numbers in turn, go to each split.

    It is what dealing groups one by one comes to, each to the split that lacks most of its share of the stratum, among
    equals to the one that lacks most of its share of all: every split gets the whole part of its quota, and what
    remains goes to the largest fractions.
    """
    if abs(sum(shares.values()) - 1) > 1e-9 or min(shares.values()) < 0:
        raise ValueError("shares must not be negative and add up to 1")
    wanted = {name: share * sum(strata) for name, share in shares.items()}
    given, out = dict.fromkeys(shares, 0), []
    for n in strata:
        quota = {name: share * n for name, share in shares.items()}
        own = {name: math.floor(q) for name, q in quota.items()}
        for name in shares:
            given[name] += own[name]
        # sorted() keeps the order of the splits among equals.
        for name in sorted(shares, key=lambda s: (own[s] - quota[s], given[s] - wanted[s]))[: n - sum(own.values())]:
            own[name] += 1
            given[name] += 1
        out.append(own)
    return out


def quota_split(rows: DataFrame, group: str, strata: Sequence[str], shares: Shares, lead: Callable[[Column], Column], slice_width: int) -> DataFrame:
    """``rows`` with a ``split`` that all rows of a group share, in each stratum by quota; larger strata are dealt first.

    Groups of a stratum are taken in the order of ``lead``, a number of the group. A group in two strata is an error.
    Strata come to the driver as counts: as many rows as there are combinations of labels.
    """
    label = F.struct(*strata)
    groups = rows.groupBy(group).agg(F.min(label).alias("__label"), F.max(label).alias("__label2"))
    groups = groups.select(group, F.when(F.col("__label").eqNullSafe(F.col("__label2")), F.col("__label")).otherwise(F.raise_error(F.concat(F.lit("a group is in two strata: "), F.col(group).cast("string")))).alias("__label"))
    named = groups.withColumn("__stratum", F.to_json("__label", {"ignoreNullFields": "false"}))
    sizes = sorted(((r[0], r[1]) for r in named.groupBy("__stratum").count().collect()), key=lambda r: (-r[1], r[0]))
    dealt = allot([n for _, n in sizes], shares)
    rowwise = [(s, *[sum(own[x] for x in list(shares)[: k + 1]) for k in range(len(shares))]) for (s, _), own in zip(sizes, dealt, strict=True)]
    schema = "s string, " + ", ".join(f"n{k} long" for k in range(len(shares)))
    ends = F.broadcast(rows.sparkSession.createDataFrame(rowwise, schema))  # a row for each stratum
    placed = G.places(named, "__stratum", lead(F.col(group)), [F.col(group)], slice_width).join(ends, F.col("__stratum") == F.col("s"))
    split = F.lit(None).cast("string")
    for k, name in reversed(list(enumerate(shares))):
        split = F.when(F.col("__p") <= F.col(f"n{k}"), name).otherwise(split)
    return rows.join(placed.select(F.col(group).alias("__g"), split.alias("split")), F.col(group).eqNullSafe(F.col("__g"))).drop("__g")


def rounded_split(rows: DataFrame, group: str, own: str, train: float, test: float, lead: Callable[[Column], Column], slice_width: int) -> DataFrame:
    """``rows`` with a ``split`` that all rows of a group share; the numbers of groups are the rounded shares of all groups.

    A row whose group is null stands alone, under its ``own`` id. Groups are taken in the order of ``lead``, a number of
    the name.
    """
    kind = rows.schema[group].dataType
    alone = F.col(group).isNull()
    name = F.when(alone, F.col(own).cast("string")).otherwise(F.col(group).cast("string"))
    held = rows.withColumn("__alone", alone).withColumn("__name", name)
    groups = held.select("__alone", "__name").distinct().withColumn("__all", F.lit(1))
    number = F.col("__name").cast("long") if isinstance(kind, T.IntegralType) else F.col("__name")
    placed = G.places(groups, "__all", lead(number), [F.col("__alone"), F.col("__name")], slice_width)
    found = placed.select(F.col("__alone").alias("__a"), F.col("__name").alias("__n2"), G.split_of(F.col("__p"), F.col("__n"), train, test).alias("split"))
    met = held.join(found, (F.col("__alone") == F.col("__a")) & (F.col("__name") == F.col("__n2")))
    return met.select(*rows.columns, "split")


def _cuts(rows: DataFrame, key: str) -> list:
    """Ids that cut ``rows`` into about SLICES ranges of one size, whatever ids begin with: every so-many-th of those that a digest picks.

    Some 64 ids a range come to the driver.
    """
    every = max(1, rows.count() // (SLICES * 64))
    picked = rows.where(F.pmod(F.xxhash64(key), F.lit(every)) == 0).select(key).orderBy(key).collect()
    return [r[0] for r in picked][64::64]


def _slice_of(key: str, cuts: list, kind: T.DataType, step: int = 16) -> Column:
    """How many cuts lie below the key: among every ``step``-th first, then among those between."""
    below = lambda part: F.size(F.filter(part, lambda b: b < F.col(key)))
    ids = lambda part: F.array(*[F.lit(b).cast(kind) for b in part])
    first = below(ids(cuts[step - 1 :: step])) if len(cuts) >= step else F.lit(0)
    return first * step + below(F.slice(ids(cuts), first * step + 1, F.lit(step)))


def dense_index(rows: DataFrame, key: str, name: str = "index") -> DataFrame:
    """``rows``, one for each ``key``, with their place in its order from 0.

    Ids are cut into ranges of about one size, each numbered by itself, on from the numbers of rows before it; windows
    over everything see a row for each range. Rows without a key go.
    """
    known = rows.where(F.col(key).isNotNull())
    cuts = _cuts(known, key)
    if not cuts:  # no more rows than a range has
        return known.select(*rows.columns, (F.row_number().over(Window.orderBy(key)) - 1).cast("long").alias(name))
    kind = rows.schema[key].dataType
    cut = known.withColumn("__s", _slice_of(key, cuts, kind))
    sizes = known.select(F.col(key).alias("__k")).select(_slice_of("__k", cuts, kind).alias("__t")).groupBy("__t").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__t").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__n")
    # A null-safe join: from a plain one Spark infers a filter of offsets by the key, which they lack.
    offsets = F.broadcast(sizes.select("__t", before.alias("__before")))
    own = F.row_number().over(Window.partitionBy("__s").orderBy(key)) - 1
    return cut.withColumn("__own", own).join(offsets, F.col("__s").eqNullSafe(F.col("__t"))).select(*rows.columns, (F.col("__own") + F.col("__before")).alias(name))


def resolve(edges: DataFrame, nodes: DataFrame, relation: str = "relation") -> DataFrame:
    """(src, dst, rel) of edges (source, relation, target) by the ``index`` of nodes (id, index), without those with an end that is no node.

    Relations are numbered in their order, over all edges, as many as there are kinds.
    """
    kinds = G.vocabulary(edges, relation).withColumnRenamed("class", "__kind").withColumnRenamed("index", "rel")
    side = lambda c, out: nodes.select(F.col("id").alias(f"__{c}"), F.col("index").alias(out))
    met = edges.join(side("source", "src"), F.col("source") == F.col("__source")).join(side("target", "dst"), F.col("target") == F.col("__target"))
    return met.join(F.broadcast(kinds), F.col(relation) == F.col("__kind")).select("src", "dst", "rel")


def feature_names(properties: Sequence[DataFrame], column: str = "properties") -> list[str]:
    """The names of all numeric properties of some kinds of nodes, sorted; ``column`` is a map of names to numbers."""
    names = None
    for rows in properties:
        own = rows.select(F.explode(F.map_keys(F.map_filter(column, lambda _, v: v.isNotNull()))).alias("name"))
        names = own if names is None else names.unionByName(own)
    # As many rows as there are names of properties.
    return sorted(r[0] for r in names.distinct().collect())


def feature_matrix(properties: Sequence[DataFrame], names: Sequence[str], column: str = "properties") -> DataFrame:
    """(id, x) of all kinds of nodes: their numbers under ``names``, in that order; 0 where a node has none."""
    wanted = F.array(*[F.lit(n) for n in names])
    out = None
    for rows in properties:
        own = rows.select("id", F.transform(wanted, lambda n: F.coalesce(F.try_element_at(F.col(column), n), F.lit(0.0))).alias("x"))
        out = own if out is None else out.unionByName(own)
    return out


def numeric_properties(text: Column) -> Column:
    """A map of names to numbers out of a JSON object; what is no number is null."""
    return F.transform_values(F.from_json(text, "map<string,string>"), lambda _, v: v.try_cast("double"))
