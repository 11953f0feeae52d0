"""From raw documents to packed training sequences: quality, language, near-duplicates, benchmark text, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandweave.llm.decontamination import decontaminate
from strandweave.llm.language import keep_language
from strandweave.llm.minhash_dedup import keep_one_of_each
from strandweave.llm.packing import pack
from strandweave.llm.quality import keep_quality
from strandweave.runtime import cut, prepare, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches 0.7.

    Null text is scored as empty; repeated rows and rows of null id are judged one by one by their texts.
    """
    prepare(spark)
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, in a language whose posterior is 0.5 or more.

    Null, empty and letterless texts go; repeated rows and rows of null id are judged one by one by their texts.
    """
    prepare(spark)
    return keep_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group that five-word shingles link at 0.8 or more.

    Rows of null id and texts without words stay, of rows that repeat an id those that no kept one is near; see
    keep_one_of_each.
    """
    prepare(spark)
    return keep_one_of_each(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than 1 in 20 stand in 13-word windows of the benchmark.

    Null and empty texts stay; rows are judged one by one.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of 1,024 tokens; null text is empty, repeated rows are rows as any."""
    prepare(spark)
    return pack(docs)


STAGES = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: No stage's model, hashing or linear program can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written to the shared folder and read again as the next one's."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
