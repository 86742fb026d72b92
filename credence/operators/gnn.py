"""Layers of graph networks and a classifier over propagated features.

Layers are DataFrame operations; only the exact GELU needs Python, as the engine has no error function.
Training is decoupled: features are propagated over the relations for some hops, each relation's mean kept
apart, and a multinomial logistic regression is fitted on the training split. That is another model than a
network trained end to end, with the same inputs and outputs, and it scales with the edges.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credence.operators import graph as G

_erf = np.frompyfunc(math.erf, 1, 1)


def gelu(x: np.ndarray) -> np.ndarray:
    return x * 0.5 * (1 + _erf(x / math.sqrt(2)).astype(np.float64))


def layer_norm(x: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    return (x - x.mean(axis=-1, keepdims=True)) / np.sqrt(x.var(axis=-1, keepdims=True) + eps)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _activate(h: pd.Series, x: pd.Series) -> pd.Series:
    if not len(h):
        return pd.Series([], dtype=object)
    out = layer_norm(gelu(np.stack(h.to_list())))
    before = np.stack(x.to_list())
    return pd.Series(list(out + before if before.shape == out.shape else out))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def normal_then_active(h: pd.Series) -> pd.Series:
    """GELU of the normalised vector."""
    return pd.Series(list(gelu(layer_norm(np.stack(h.to_list()))))) if len(h) else pd.Series([], dtype=object)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def add_then_normal(h: pd.Series, x: pd.Series) -> pd.Series:
    """The normalised sum of x and GELU of h."""
    return pd.Series(list(layer_norm(np.stack(x.to_list()) + gelu(np.stack(h.to_list()))))) if len(h) else pd.Series([], dtype=object)


def block(nodes: DataFrame, edges: DataFrame, weights, own, gates, bias) -> DataFrame:
    """Relational layer, exact GELU, layer norm, and the input added where the widths agree."""
    h = G.relational_layer(nodes, edges, weights, own, gates, bias).withColumnRenamed("x", "h")
    return h.join(nodes, "node_id").select("node_id", _activate("h", "x").alias("x"))


def mean_block(nodes: DataFrame, edges: DataFrame, own, neighbour, most: int) -> DataFrame:
    """LN(x + GELU(x W + mean U)) over at most ``most`` neighbours."""
    n, width = len(own), len(own[0])
    agg = G.vector_mean(G.with_source(G.fan_out(edges, most), nodes), "dst", G.entries("x", n)).select(F.col("dst").alias("node_id"), "m")
    cells = [
        sum((F.element_at("x", i + 1) * float(own[i][j]) + F.coalesce(F.element_at("m", i + 1), F.lit(0.0)) * float(neighbour[i][j]) for i in range(n)), F.lit(0.0))
        for j in range(width)
    ]
    return nodes.join(agg, "node_id", "left").select("node_id", "x", F.array(*cells).alias("h")).select("node_id", add_then_normal("h", "x").alias("x"))


def propagate(nodes: DataFrame, edges: DataFrame, relations: list[int], hops: int, width: int) -> DataFrame:
    """(node_id, x): the node's vector, and for each hop and relation the mean of what its neighbours had."""
    out, now = nodes.select("node_id", "x"), nodes.select("node_id", "x")
    for _ in range(hops):
        means = None
        for r in relations:
            m = G.vector_mean(G.with_source(edges.where(F.col("rel") == r), now), "dst", G.entries("x", width))
            m = m.select(F.col("dst").alias("node_id"), F.col("m").alias(f"m{r}"))
            means = m if means is None else means.join(m, "node_id", "full")
        zero = F.array_repeat(F.lit(0.0), width)
        cells = [F.coalesce(F.col(f"m{r}"), zero) for r in relations]
        # Read by the next hop's relations and by the result; lost parts are computed again.
        hop = nodes.select("node_id").join(means, "node_id", "left").select("node_id", *[c.alias(f"m{r}") for c, r in zip(cells, relations, strict=True)]).persist()
        now = hop.select("node_id", F.transform(F.arrays_zip(*[f"m{r}" for r in relations]), lambda z: sum((z[f"m{r}"] for r in relations), F.lit(0.0)) / len(relations)).alias("x"))
        joined = F.concat("x", *[F.col(f"m{r}") for r in relations])
        out = out.join(hop, "node_id").select("node_id", joined.alias("x"))
    return out


def propagate_and_classify(nodes: DataFrame, edges: DataFrame, split: DataFrame, hops: int, width: int, relations: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """node_id, split, label, predicted and confidence; the fit reads the rows of the training split only."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    spread = propagate(nodes, edges, list(relations), hops, width)
    rows = spread.join(nodes.select("node_id", "label"), "node_id").join(split, "node_id").withColumn("features", array_to_vector("x"))
    rows = rows.withColumn("label", F.col("label").cast("double")).persist()
    model = LogisticRegression(maxIter=30, regParam=0.05, featuresCol="features", labelCol="label").fit(rows.where("split = 'train'"))
    scored = model.transform(rows)
    return scored.select(
        "node_id", "split", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("predicted"),
        F.array_max(vector_to_array("probability")).alias("confidence"),
    )
