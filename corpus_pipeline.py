"""From raw documents to packed training sequences, in five stages.

Each stage takes all that the one before kept and acts on it: quality rules drop
documents, the Jaccard join leaves one document of each group, suffix-array
deduplication cuts repeated passages out of texts, personal data is replaced by
its kind, and the last stage packs the tokens of what is left into sequences.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fellgate.llm import jaccard, packing, pii, quality, suffix_dedup
from fellgate.llm.scratch import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _with_text(docs: DataFrame, text: str) -> DataFrame:
    """docs with another text, and n_chars to match where there is such a column."""
    out = docs.withColumn("text", F.col(text).cast("string"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.representatives(docs, n=5, num=8, den=10)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages; a character cut in two goes; a text that is all repeated is left empty."""
    left = suffix_dedup.cut_texts(docs)
    return _with_text(left, "text").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(pii.redact(docs), "text").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("PII", personal_data),
    ("best-fit packing", packed),
]

#: The middle stages cannot be put in SQL; tests/llm/test_pipeline.py holds the rows against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in a row over documents, each written and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        written = scratch.keep(stage(spark, docs, sf_dir))
        if k:
            scratch.drop(docs)
        docs = written
    return STAGES[-1][1](spark, docs, sf_dir)
