"""One query for each operator of this subpackage, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fellgate.llm import ann, bpe, html_extract, jaccard, packing, pii, ppm, quality, rlz_dedup, suffix_dedup


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(_read(spark, sf_dir, "documents"))


def op4_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(_read(spark, sf_dir, "documents")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(_read(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.dedup(_read(spark, sf_dir, "documents")))


def op9_rlz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz_dedup.digest(rlz_dedup.dedup(_read(spark, sf_dir, "documents")))


def op10_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_read(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_prefix_forest, op2_bpe, op3_ppm, op4_best_fit, op5_jaccard, op6_pii, op7_quality, op8_suffix_dedup, op9_rlz_dedup, op10_tag_paths)}

#: The others cannot be put in SQL, or not over whole tables in useful time; tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {"op7_quality": quality.oracle()}
