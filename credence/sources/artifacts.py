"""What a run leaves: predictions, history, metrics, the model, and graphs, as JSON."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.sources.documents import write_documents

VERSION = 1


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """One file, by the file system that the path names; folders above it are made."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def write_document(spark: SparkSession, path: str, data: Any) -> None:
    """A small document with sorted keys, two blanks a level and a line's end: settings, metrics, a model's weights."""
    _write_text(spark, path, json.dumps(data, indent=2, sort_keys=True) + "\n")


def read_document(spark: SparkSession, path: str) -> Any:
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def write_graph(spark: SparkSession, nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph as folders of nodes and edges, one record a line, and a document that counts them."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")
    write_document(spark, f"{path}/metadata.json", {"schema_version": "1.0", "version": VERSION, "node_count": nodes.count(), "edge_count": edges.count()})


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that ``write_graph`` wrote; another version is refused."""
    found = read_document(spark, f"{path}/metadata.json").get("version")
    if found != VERSION:
        raise ValueError(f"the graph has version {found}, not {VERSION}")
    return spark.read.json(f"{path}/nodes"), spark.read.json(f"{path}/edges")


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, properties by name as JSON text) and edges of one document with both lists."""
    schema = "nodes array<struct<id:string,label:string,properties:variant>>, edges array<struct<source:string,relation:string,target:string>>"
    doc = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    nodes = doc.select(F.explode("nodes").alias("n")).select("n.id", "n.label", F.to_json("n.properties").alias("properties"))
    return nodes, doc.select(F.explode("edges").alias("e")).select("e.*")


def write_run(
    spark: SparkSession, path: str, predictions: DataFrame, history: Sequence[Mapping[str, float]], metrics: Mapping[str, Any], model: Mapping[str, Any], best: Mapping[str, Any] | None = None
) -> None:
    """Predictions as records, history and metrics as documents, the last model and, if given, the best one by validation."""
    predictions.write.mode("overwrite").json(f"{path}/node_evidence")
    write_document(spark, f"{path}/history.json", list(history))
    write_document(spark, f"{path}/metrics.json", dict(metrics))
    write_document(spark, f"{path}/model.json", dict(model))
    if best is not None:
        write_document(spark, f"{path}/best_model.json", dict(best))


def top_intervals(predictions: DataFrame, k: int = 3) -> DataFrame:
    """node_id and its ``k`` hypotheses of highest belief, ties in their order."""
    neg = F.transform("intervals", lambda x, i: F.struct((-x["belief"]).alias("neg"), i.alias("at"), x["hypothesis"].alias("hypothesis"), x["plausibility"].alias("plausibility")))
    top = F.transform(F.slice(F.array_sort(neg), 1, k), lambda x: F.struct(x["hypothesis"].alias("hypothesis"), (-x["neg"]).alias("belief"), x["plausibility"].alias("plausibility")))
    return predictions.select("node_id", top.alias("identifications"))


def write_observations(rows: DataFrame, path: str, metadata: Mapping[str, Any] | None = None) -> None:
    """Observations as documents that ``load_observations`` reads."""
    write_documents(rows, path, "observations", metadata)


def write_series(documents: DataFrame, path: str, metadata: Mapping[str, Any] | None = None) -> None:
    """Series with nested observations, and reports if they have them, as documents that ``load_series``, ``load_observations`` and ``load_reports`` read."""
    write_documents(documents, path, "observation_series", metadata)
