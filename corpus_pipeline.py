"""A training corpus from raw documents, in five stages; each reads what the one before wrote.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, whatever their
names, and no stage crashes on, or gives other than no rows for, an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import bpe, common, decontaminate, near_dedup, repetition, resample


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the suffix-array limits on repeats. Null, empty, blank and short texts fail; repeated rows share their fate; very long texts are read whole."""
    return repetition.keep_documents(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by importance resampling towards the good labelled ones. Null and empty texts compete with weight 0; ties with the last one drawn stay; repeated rows share their fate; without labels of both kinds all stay."""
    return resample.keep_documents(docs, common.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies. Null and empty texts are no copies of anything; all rows of a kept id stay; a null id goes."""
    return near_dedup.keep_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover less than a twentieth, without the spans of 13 or more words. Null texts stay null, and texts without words stay."""
    cleaned = decontaminate.clean_documents(docs, common.table(spark, sf_dir, "benchmark"))
    return cleaned.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cleaned


def tokenization(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256 of each row; null and empty texts have no ids."""
    return bpe.encode(docs, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN).drop("round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokenization", tokenization),
]

#: The suffix array, the sampled models and the merges have no SQL form; tests/llm holds each operator against brute force, and each stage against its operator's own scores.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each result is written as Parquet and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
