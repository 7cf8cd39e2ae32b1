"""One query for each training-data operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import input_table
from .decontam import find_contamination
from .divergence import audit_divergence, divergence_sql
from .fingerprint import fingerprint_documents
from .html_extract import extract_pages
from .langid import identify_language, train_language_id
from .line_dedup import drop_repeated_lines
from .mixing import mix_sources, mix_sql
from .ngram_join import similarity_classes
from .perplexity import judge_quality
from .pii import find_personal_data
from .toxicity import score_toxicity, train_toxicity
from .url_rules import judge_urls


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = input_table(spark, sf_dir, "documents")
    return score_toxicity(docs, train_toxicity(docs, input_table(spark, sf_dir, "labels")))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(input_table(spark, sf_dir, "pages"))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(input_table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(input_table(spark, sf_dir, "documents"), input_table(spark, sf_dir, "benchmark"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(input_table(spark, sf_dir, "pages"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(input_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_kept", "text")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(input_table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(input_table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(input_table(spark, sf_dir, "documents")).select("doc_id", "domain", "lang", "source", "n_tokens", "copies")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = input_table(spark, sf_dir, "documents")
    return identify_language(docs, train_language_id(docs))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(input_table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_divergence(input_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_url_filters, op3_document_fingerprints, op4_benchmark_decontamination, op5_html_extraction, op6_line_dedup, op7_ngram_jaccard_join, op8_pii, op9_source_mixing, op10_language_id, op11_quality_rules, op12_source_divergence)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL expresses."""
    return {"op9_source_mixing": mix_sql(), "op12_source_divergence": divergence_sql()}
