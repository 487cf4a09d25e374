"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import oracles
from .decontamination import contained_items
from .frames import table
from .languages import detect_languages
from .licenses import license_scan
from .mixing import mixed_words
from .phrases import phrase_fingerprints
from .quality import quality_scores
from .repeated_lines import removed_lines
from .secret_ledger import secret_report
from .shingle_join import similar_components
from .token_counts import token_counts
from .token_files import token_files
from .treap_search import search
from .vector_codes import vector_codes

Query = Callable[[SparkSession, str], DataFrame]


def op1_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = removed_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "removed_words", F.array_join("removed", ",").alias("removed"))


def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_languages(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files ``source/lang/doc_id``."""
    docs = table(spark, sf_dir, "documents")
    files = docs.select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text")
    found = license_scan(files)
    return found.select(F.regexp_extract("path", "([^/]*)$", 1).cast("long").alias("doc_id"), "path", "licence", F.round("cosine", 6).alias("cosine"), "found")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_words(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"), width=3, percent=90)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_fingerprints(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def op12_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    numbered = (
        op1_repeated_lines, op2_language_mixture, op3_quality, op4_licenses, op5_token_files,
        op6_mixing, op7_decontamination, op8_shingle_join, op9_token_counts, op10_phrase_fingerprints,
        op11_vector_codes, op12_treap_search, op13_secret_ledger,
    )
    return {q.__name__: q for q in numbered} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """SQL for those that it can express; the others are tested against plain versions in tests/llm."""
    return oracles.oracle_sql()
