"""The operators as queries over the sample tables, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlens.llm import (
    divergence, epsgrid, hilbert, langid, line_dedup, lm, mixing, negatives, ngram_join, packing, secrets, topk, urls
)
from chatlens.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(read(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.filter(f"vec_id % {topk.EVERY} = 0"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.pseudo_likelihood(read(spark, sf_dir, "documents"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epsgrid.embedding_components(read(spark, sf_dir, "embeddings"))


def op5_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.document_shards(read(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.curriculum(read(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = langid.documents_evidence(read(spark, sf_dir, "documents"))
    return langid.identify(rows, more=langid.pages_evidence(read(spark, sf_dir, "pages")))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(read(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_classes(read(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(read(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = negatives.labelled_vectors(read(spark, sf_dir, "embeddings"))
    return negatives.hard_negatives(vectors, vectors.filter(f"vec_id % {negatives.EVERY} = 0"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = [make for name, make in globals().items() if name.startswith("op") and callable(make)]
    return {make.__name__: make for make in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_top_k": topk.ORACLE_SQL,
        "op2_url_filter": urls.ORACLE_SQL,
        "op4_embedding_near_dedup": epsgrid.ORACLE_SQL,
        "op6_source_mixing": mixing.ORACLE_SQL,
        "op8_ngram_jaccard_join": ngram_join.ORACLE_SQL,
        "op12_hard_negatives": negatives.ORACLE_SQL,
        "op13_source_divergence": divergence.ORACLE_SQL,
    }
