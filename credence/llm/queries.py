"""The queries of this subpackage, by name, and DuckDB twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.llm import decontam, divergence, fingerprints, hnsw, html_extract, line_dedup, packing, quality, runs, simhash, suffix_dedup, token_counts, toxicity
from credence.llm import twins
from credence.llm._common import read


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(read(spark, sf_dir, "pages"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.with_offsets(read(spark, sf_dir, "documents"))
    offsets = F.transform("removed", lambda x: F.concat(x["start"], F.lit("-"), x["end"]))
    return found.withColumn("removed", F.array_join(offsets, ","))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op5_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return hnsw.search(rows, rows.where(F.col("vec_id") % 20 == 0))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op7_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_report(read(spark, sf_dir, "documents"))


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edits(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_extraction, op2_token_counts, op3_line_dedup, op4_best_fit_packing, op5_hnsw,
        op6_simhash, op7_suffix_arrays, op8_toxicity, op9_decontamination, op10_quality,
        op11_source_divergence, op12_periodic_runs, op13_document_fingerprints,
    )
}

#: The others can't be written in SQL at a bearable cost; tests/llm holds them against brute force.
ORACLE: dict[str, str] = {"op3_line_dedup": twins.LINE_DEDUP, "op11_source_divergence": twins.DIVERGENCE}
