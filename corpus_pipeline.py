"""From raw documents to training sequences: each stage takes what the one before it kept.

Stages are functions of (session, documents, folder of the tables). Every result is written as
Parquet to the shared folder and read again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlens.llm import langid, line_dedup, mixing, ngram_join, packing
from chatlens.llm.common import read, table


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars again as long as the text."""
    if "n_chars" not in docs.columns:
        return docs
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return docs.withColumn("n_chars", length)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the accepted languages, by all evidence of operator 7."""
    return langid.keep_identified(docs, more=langid.pages_evidence(read(spark, sf_dir, "pages")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each group of similar lines."""
    return _counted(line_dedup.dedup_lines(docs))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as the mix takes it."""
    return _counted(mixing.mixed_documents(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences, as the places of the documents' pieces."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", dedup_documents),
    ("mixing", mix_sources),
    ("best_fit_packing", pack),
]

# Similarity joins with union-find and a tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), name)
    return docs
