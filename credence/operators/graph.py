"""Message passing and splits as joins and grouped sums.

Vectors are summed by one generated column for each entry, so a layer stays in generated code and the sums
combine on the map side; nothing is exploded. A node's degree is over all relations.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credence.functions import masses as M


def entries(x: str, n: int) -> list[Column]:
    return [F.element_at(x, i + 1) for i in range(n)]


def vector_mean(rows: DataFrame, key: str, cells: Sequence[Column]) -> DataFrame:
    """(key, m, degree): the mean of vectors given by their entries."""
    sums = [F.sum(c).alias(f"__s{i}") for i, c in enumerate(cells)]
    out = rows.groupBy(key).agg(*sums, F.count("*").alias("degree"))
    return out.select(key, F.array(*[F.col(f"__s{i}") / F.col("degree") for i in range(len(cells))]).alias("m"), "degree")


def fan_out(edges: DataFrame, most: int) -> DataFrame:
    """The first ``most`` inbound edges of each node, by relation and source."""
    place = F.row_number().over(Window.partitionBy("dst").orderBy("rel", "src"))
    return edges.withColumn("__n", place).where(F.col("__n") <= most).drop("__n")


def with_source(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("node_id").alias("src"), "x"), "src")


def matrices(bases: Sequence[Sequence[Sequence[float]]], mix: Sequence[Sequence[float]]) -> list[list[list[float]]]:
    """A matrix for each relation from shared bases."""
    rows, cols = len(bases[0]), len(bases[0][0])
    return [[[sum(a * b[i][j] for a, b in zip(m, bases, strict=True)) for j in range(cols)] for i in range(rows)] for m in mix]


def by_relation(rel: Column, values: Sequence[float]) -> Column:
    out = F.lit(None).cast("double")
    for r, v in enumerate(values):
        out = F.when(rel == r, F.lit(float(v))).otherwise(out)
    return out


#: Products with up to so many literals are written out, larger ones run over literal arrays.
WRITTEN_OUT = 96


def products(x: str, columns: Sequence[Sequence[float]]) -> list[Column]:
    """The product of a vector with each of some columns of weights."""
    if sum(map(len, columns)) > WRITTEN_OUT:
        return [M.dot(F.col(x), F.array(*[F.lit(float(w)) for w in c])) for c in columns]
    return [sum((F.element_at(x, i + 1) * float(w) for i, w in enumerate(c)), F.lit(0.0)) for c in columns]


def columns_of(matrix: Sequence[Sequence[float]], scale: float = 1.0) -> list[list[float]]:
    return [[row[j] * scale for row in matrix] for j in range(len(matrix[0]))]


def relational_layer(
    nodes: DataFrame, edges: DataFrame, weights: Sequence, own: Sequence[Sequence[float]], gates: Sequence[float], bias: Sequence[float]
) -> DataFrame:
    """(node_id, x): own part plus the degree-normalised sum of gated relation messages.

    A node is multiplied with every relation's matrix once, before its edges are met, and only the products travel.
    """
    width = len(own[0])
    sent = nodes.select(F.col("node_id").alias("src"), F.array(*products("x", [c for w, g in zip(weights, gates, strict=True) for c in columns_of(w, g)])).alias("y"))
    cells = [F.element_at("y", F.col("rel") * width + j + 1) for j in range(width)]
    inbound = vector_mean(edges.join(sent, "src"), "dst", cells).select(F.col("dst").alias("node_id"), "m")
    kept = nodes.select("node_id", F.array(*products("x", columns_of(own))).alias("s"))
    out = [F.lit(float(bias[j])) + F.coalesce(F.element_at("m", j + 1), F.lit(0.0)) + F.element_at("s", j + 1) for j in range(width)]
    return kept.join(inbound, "node_id", "left").select("node_id", F.array(*out).alias("x"))


def gated_mean(nodes: DataFrame, edges: DataFrame, q: Sequence, k: Sequence, v: Sequence, prior: Sequence[float]) -> DataFrame:
    """(dst, m, degree): mean of values under a sigmoid gate of query, key and the relation's prior, one head.

    Queries, keys and values are made once a node, before edges are met.
    """
    width = len(q[0])
    seen = lambda end, out, w: nodes.select(F.col("node_id").alias(end), F.array(*products("x", columns_of(w))).alias(out))
    sent = nodes.select(F.col("node_id").alias("src"), F.array(*products("x", columns_of(k))).alias("k"), F.array(*products("x", columns_of(v))).alias("v"))
    ends = edges.join(sent, "src").join(seen("dst", "q", q), "dst")
    score = sum((F.element_at("q", j + 1) * F.element_at("k", j + 1) for j in range(width)), F.lit(0.0))
    gate = 1 / (1 + F.exp(-(score * by_relation(F.col("rel"), prior) / width**0.5)))
    return vector_mean(ends.withColumn("g", gate), "dst", [F.col("g") * F.element_at("v", j + 1) for j in range(width)])


def split_of(place: Column, n: Column, train: float, test: float) -> Column:
    """train, test or val by a place (from 1) among n, in that order; fractions are rounded half up."""
    a, b = F.floor(n * train + 0.5), F.floor(n * test + 0.5)
    return F.when(place <= a, "train").when(place <= a + b, "test").otherwise("val")


def grouped_split(rows: DataFrame, group: str, train: float, test: float, shuffled: Callable[[Column], Column], buckets: int = 1000) -> DataFrame:
    """Rows with a split that all rows of a group share; a group's hash bucket decides, so nothing is ordered or counted."""
    bucket = F.pmod(shuffled(F.col(group)), F.lit(buckets))
    return rows.withColumn(
        "split", F.when(bucket < int(buckets * train), "train").when(bucket < int(buckets * (train + test)), "test").otherwise("val")
    )


def places(rows: DataFrame, group: str, lead: Column, rest: Sequence[Column], slice_width: int) -> DataFrame:
    """Rows with their place (__p, from 1) among the rows of their group (__n) by ``lead``, then ``rest``.

    A group is cut into slices of its range of ``lead``, a number, each ``slice_width`` wide, and a slice is numbered
    on from the rows of those before it; so a group is as many tasks as it has slices. Windows over whole groups
    see a row for each slice. Rows whose ``lead`` is null are one slice, the first.
    """
    cut = rows.withColumn("__lead", lead).withColumn("__slice", F.floor(F.col("__lead") / slice_width))
    sizes = cut.groupBy(F.col(group).alias("__g"), F.col("__slice").alias("__s")).agg(F.count("*").alias("__in"))
    whole = Window.partitionBy("__g")
    upto = F.sum("__in").over(whole.orderBy(F.asc_nulls_first("__s")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = sizes.select("__g", "__s", (upto - F.col("__in")).alias("__before"), F.sum("__in").over(whole).alias("__n"))
    own = F.row_number().over(Window.partitionBy(group, "__slice").orderBy(F.asc_nulls_first("__lead"), *rest))
    met = cut.withColumn("__own", own).join(before, F.col(group).eqNullSafe(F.col("__g")) & F.col("__slice").eqNullSafe(F.col("__s")))
    return met.select(*rows.columns, (F.col("__own") + F.col("__before")).alias("__p"), "__n")


def stratified_split(rows: DataFrame, stratum: str, train: float, test: float, lead: Column, rest: Sequence[Column], slice_width: int) -> DataFrame:
    """Within each stratum the first share in a shuffled order trains, the next tests, the rest validates."""
    placed = places(rows, stratum, lead, rest, slice_width)
    return placed.withColumn("split", split_of(F.col("__p"), F.col("__n"), train, test)).drop("__p", "__n")


def filter_edges(edges: DataFrame, splits: DataFrame, dropped: Sequence[int]) -> DataFrame:
    """Edges of the relations kept, within one split or with an end in none; relations are numbered anew without gaps."""
    side = lambda c: splits.select(F.col("node_id").alias(c), F.col("split").alias(f"{c}_split"))
    kept = (
        edges.where(~F.col("rel").isin(*dropped)).join(side("src"), "src", "left").join(side("dst"), "dst", "left")
        .where(F.col("src_split").isNull() | F.col("dst_split").isNull() | (F.col("src_split") == F.col("dst_split")))
    )
    # As many rows as relations.
    used = kept.select("rel").distinct().withColumn("new_rel", F.row_number().over(Window.orderBy("rel")) - 1)
    return kept.join(F.broadcast(used), "rel").select("src", "dst", "new_rel")


def vocabulary(rows: DataFrame, label: str) -> DataFrame:
    """(class, index): the distinct labels, sorted. As many rows as classes."""
    classes = rows.select(F.col(label).alias("class")).where("class is not null").distinct()
    return classes.withColumn("index", F.row_number().over(Window.orderBy(F.col("class").cast("string"))) - 1)
