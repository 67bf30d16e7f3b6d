"""From raw documents to encoded training rows: each stage's result is written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import bpe, catalog, exact_dedup, mixing, near_dedup, quality_classifier
from larder.llm.common import stored, table

#: Columns of the documents table that all stages but the last return.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards good ones doesn't draw go."""
    return quality_classifier.drop_rejected(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest id stays."""
    return exact_dedup.drop_exact_duplicates(docs).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents (five-word shingles, similarity 0.8 or more), the one with the smallest id stays."""
    return near_dedup.drop_near_duplicates(docs).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat at their source's rate (sources weigh the root of their rows), in shuffled order."""
    return mixing.mixed(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``ids`` of each text, and the text that decoding them gives."""
    tokens = bpe.encoded(docs.select(*COLUMNS), catalog.byte_vocabulary(), decode=True)
    return tokens.withColumn("text", F.col("decoded").cast("string")).drop("decoded")


#: Name and function of each stage, in order.
STAGES = [("quality_classifier", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("bpe", encode)]

#: The classifier, near-duplicate search and byte-level BPE have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage gives for the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
