"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandweave.llm.attribution import tokens_by_line
from strandweave.llm.decontamination import contamination
from strandweave.llm.embedding_dedup import near_duplicate_vectors
from strandweave.llm.html_extract import main_text
from strandweave.llm.language import identify_language
from strandweave.llm.license_scan import scan_licenses
from strandweave.llm.minhash_dedup import duplicate_classes
from strandweave.llm.packing import pack
from strandweave.llm.quality import score_quality
from strandweave.llm.token_files import token_file_index
from strandweave.runtime import table


def op1_itq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("longest")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("detections")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_index(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_classes(table(spark, sf_dir, "documents"), k=2)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_by_line(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_itq_dedup": op1_itq_dedup,
        "op2_quality": op2_quality,
        "op3_decontamination": op3_decontamination,
        "op4_language": op4_language,
        "op5_html_extraction": op5_html_extraction,
        "op6_license_scan": op6_license_scan,
        "op7_token_files": op7_token_files,
        "op8_packing": op8_packing,
        "op9_minhash_dedup": op9_minhash_dedup,
        "op10_token_counts": op10_token_counts,
    }
