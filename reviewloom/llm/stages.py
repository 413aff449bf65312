"""The stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame.

All but the last return the columns of ``documents``. ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm.language import in_known_language
from reviewloom.llm.lines import without_repeated_lines
from reviewloom.llm.packing import pack
from reviewloom.llm.pii import masked
from reviewloom.llm.queries import BYTE_TOKENIZER
from reviewloom.llm.simhash import simhash_groups

# Of a document's n-grams so many must be known in its language; documents in two
# languages have about half, and stay.
LEAST_SCORE = 0.3


def _recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    if "n_chars" not in columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind)).select(*columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; others go."""
    return in_known_language(docs, LEAST_SCORE)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs go from the texts; no document goes."""
    return _recounted(without_repeated_lines(docs), docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id, once if it is repeated.

    Groups are those of the operator: fingerprints of four-word shingles that differ in
    at most four bits, links followed to the end. A document without id cannot stand
    for a group and goes.
    """
    groups = simhash_groups(docs)
    ids = groups.filter("doc_id = component_id").select("doc_id").distinct()
    return docs.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data becomes its kind in angle brackets."""
    return _recounted(masked(docs), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the sequences."""
    return pack(docs, BYTE_TOKENIZER)
