"""The registered query of each operator: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm.caps import embedding_groups
from reviewloom.llm.common import table
from reviewloom.llm.language import identify
from reviewloom.llm.lines import repeated_lines
from reviewloom.llm.negatives import hard_negatives
from reviewloom.llm.neighbors import nearest_neighbors
from reviewloom.llm.oracles import ORACLES as ORACLES
from reviewloom.llm.packing import pack
from reviewloom.llm.phrases import collocations
from reviewloom.llm.pieces import round_trip
from reviewloom.llm.pii import span_digest
from reviewloom.llm.quality import quality_scores
from reviewloom.llm.simhash import simhash_groups
from reviewloom.llm.suffix import repeated_bytes
from reviewloom.llm.urls import judge_urls

BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_nearest_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents", "doc_id", "text"), PIECE_MODEL)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(
        table(spark, sf_dir, "pages", "page_id", "url"),
        table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"),
    )


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents", "doc_id", "text")).drop("spans")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents", "doc_id", "text"), BYTE_TOKENIZER)


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents", "text", "lang"))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(
        table(spark, sf_dir, "documents", "doc_id", "text"),
        table(spark, sf_dir, "labels", "doc_id", "quality"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh vector gets the next label first, so that near rows differ in label."""
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_personal_data": op1_personal_data,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_nearest_neighbors": op3_nearest_neighbors,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_url_filter": op5_url_filter,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_language_id": op8_language_id,
    "op9_packing": op9_packing,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
    "op11_collocations": op11_collocations,
    "op12_quality_classifier": op12_quality_classifier,
    "op13_hard_negatives": op13_hard_negatives,
}
