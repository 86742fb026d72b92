"""Readers and writers of observation, series, report and graph documents."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEASURE = "struct<value:double,error:double,min:double,max:double>"
CLAIM = (
    "struct<claim_id:string,claim_type:string,stance:string,subject_id:string,predicate:string,object_id:string,object_value:string,object_kind:string,"
    "claim_text:string,claim_confidence:double,extraction_confidence:double,specificity_score:double,kg_consistency_score:double,synthetic_truth_value:string>"
)
REPORT = (
    "struct<report_id:string,observation_id:string,series_id:string,source_id:string,source_type:string,published_at:string,collected_at:string,ingested_at:string,"
    f"credibility_score:double,external_context:struct<operator_priors:map<string,double>,priors:map<string,map<string,double>>>,claims:array<{CLAIM}>>"
)
LABEL = "struct<aircraft_family:string,aircraft_variant:string,aircraft_id:string,operator:string,radar:string,radar_id:string,mode:string,mode_id:string>"
OBSERVATION = (
    "struct<observation_id:string,series_id:string,sequence_index:int,elapsed_time_s:double,timestamp_unix:double,timestamp_iso8601:string,"
    "sensor:struct<type:string,platform:string>,estimated_emitter_location:struct<area:string,estimated_latitude_deg:double,estimated_longitude_deg:double,"
    "error_box:struct<min_latitude_deg:double,max_latitude_deg:double,min_longitude_deg:double,max_longitude_deg:double>>,"
    "approximate_kinematics:struct<ground_speed_kph:double,ground_speed_error_kph:double,ground_speed_min_kph:double,ground_speed_max_kph:double,"
    "altitude_m:double,altitude_error_m:double,altitude_min_m:double,altitude_max_m:double,heading_deg:double,heading_error_deg:double>,"
    f"esm_radar_parameters:struct<observed_waveform:string,observed_scan_type:string,measured_centre_frequency_ghz:{MEASURE},measured_bandwidth_mhz:{MEASURE},measured_prf_hz:{MEASURE},"
    f"measured_pulse_width_us:{MEASURE},measured_duty_cycle:{MEASURE},measured_coherent_processing_interval_ms:{MEASURE},measured_dwell_time_ms:{MEASURE},measured_pulse_repetition_interval_us:{MEASURE}>,"
    f"ground_truth_label:{LABEL},external_context:struct<operator_priors:map<string,double>,priors:map<string,map<string,double>>,operator:variant>,intelligence_reports:array<{REPORT}>>"
)
SERIES = f"struct<series_id:string,emitter_type:string,sample_interval_s:double,duration_s:double,observation_count:int,observations:array<{OBSERVATION}>>"
DOCUMENT = f"observations array<{OBSERVATION}>, observation_series array<{SERIES}>, reports array<{REPORT}>"


class DocumentError(ValueError):
    """A document that is no JSON, or has none of the expected lists."""


def explain_json_error(text: str, around: int = 1) -> str:
    """Line, column, excerpt with a caret, and a hint for text that is no JSON; empty if it is."""
    try:
        json.loads(text)
    except json.JSONDecodeError as e:
        lines = text.splitlines() or [""]
        first = max(0, e.lineno - 1 - around)
        out = [f"invalid JSON at line {e.lineno}, column {e.colno}: {e.msg}"]
        for n in range(first, min(len(lines), e.lineno + around)):
            out.append(f"{n + 1:>5} | {lines[n]}")
            if n == e.lineno - 1:
                out.append(" " * (7 + e.colno) + "^")
        if "delimiter" in e.msg:
            out.append("hint: a comma or colon may be missing just before the marked place")
        return "\n".join(out)
    return ""


def _check(spark: SparkSession, path: str, keys: tuple[str, ...]) -> None:
    """Parses every document where it lies; the first broken one by path raises with its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for at, text in zip(b.column("at").to_pylist(), b.column("value").to_pylist(), strict=True):
                message = explain_json_error(text)
                if not message:
                    data = json.loads(text)
                    if not isinstance(data, list) and not (isinstance(data, dict) and any(isinstance(data.get(k), list) for k in keys)):
                        message = f"the document needs a list under {' or '.join(map(repr, keys))}"
                if message:
                    found.append((at, message))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in (0, 1)], names=["at", "message"])

    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("at"), "value")
    bad = texts.mapInArrow(run, "at string, message string").agg(F.min(F.struct("at", "message")).alias("first")).first()["first"]
    if bad:
        raise DocumentError(f"{bad['at']}: {bad['message']}")


def _documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "FAILFAST").json(path)


def load_observations(spark: SparkSession, path: str) -> DataFrame:
    """Observations of all shapes: flat, in series (whose id they get if they lack one)."""
    docs = _documents(spark, path)
    flat = docs.select(F.explode("observations").alias("o")).select("o.*")
    track = docs.select(F.explode("observation_series").alias("s")).select(F.col("s.series_id").alias("sid"), F.explode("s.observations").alias("o"))
    nested = track.select(F.coalesce("o.series_id", "sid").alias("sid"), "o.*").drop("series_id").withColumnRenamed("sid", "series_id")
    return flat.unionByName(nested)


def load_series(spark: SparkSession, path: str) -> DataFrame:
    """One row for each series; a broken document raises with its place."""
    _check(spark, path, ("observation_series",))
    return _documents(spark, path).select(F.explode("observation_series").alias("s")).select("s.*")


def load_reports(spark: SparkSession, path: str) -> DataFrame:
    """Reports of both shapes: listed, or nested in the observations of series; null lists have none."""
    docs = _documents(spark, path)
    listed = docs.select(F.explode("reports").alias("r"))
    nested = docs.select(F.explode("observation_series").alias("s")).select(F.explode("s.observations").alias("o")).select(F.explode("o.intelligence_reports").alias("r"))
    return listed.unionByName(nested).select("r.*")


def write_json(rows: DataFrame, path: str) -> None:
    """A record a line, keys in order, nulls left out."""
    rows.select(*sorted(rows.columns)).write.mode("overwrite").json(path)


def write_documents(rows: DataFrame, path: str, key: str, metadata: Mapping[str, Any] | None = None, chunk: int = 1000) -> None:
    """Rows as whole JSON documents, ``{"metadata": ..., key: [...]}``, ``chunk`` rows in each, in the order the rows have.

    Every file is one document that the loaders (and any JSON parser) read; no task or driver holds more than a chunk.
    """
    if chunk < 1:
        raise ValueError("a document holds one row at least")
    head = json.dumps(dict(metadata or {}), sort_keys=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def document(lines: list[str]) -> pa.RecordBatch:
            body = ",\n    ".join(lines)
            return pa.RecordBatch.from_pydict({"value": [f'{{\n  "metadata": {head},\n  {json.dumps(key)}: [\n    {body}\n  ]\n}}']})

        held: list[str] = []
        for b in batches:
            for line in b.column("line").to_pylist():
                held.append(line)
                if len(held) == chunk:
                    yield document(held)
                    held = []
        if held:
            yield document(held)

    lines = rows.select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("line"))
    # A record that is a document, a file that is a record.
    lines.mapInArrow(run, "value string").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def write_triples(triples: DataFrame, path: str) -> None:
    triples.select("source", "relation", "target").write.mode("overwrite").option("header", True).csv(path)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("source string, relation string, target string").option("header", True).csv(path)
