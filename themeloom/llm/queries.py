"""Queries of this subpackage's operators over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from themeloom.llm import bpe, chat, exact, fingerprint, langid, lattice, minhash, mixing, pii, quality


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_groups(_docs(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_docs(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return quality.score(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_docs(spark, sf_dir))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_docs(spark, sf_dir))


def op6_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return lattice.score(docs, lattice.fit(docs))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_docs(spark, sf_dir))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(_docs(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return langid.identify(docs, langid.fit(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_fingerprints, op2_exact_dedup, op3_quality, op4_near_dedup, op5_byte_bpe, op6_lattice_likelihood, op7_chat_format, op8_pii_surrogates, op9_mix_sources, op10_language_id)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": """
            SELECT doc_id, CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER w END AS keep_id,
                   CASE WHEN text IS NULL THEN 1 ELSE count(*) OVER w END AS n_copies,
                   text IS NULL OR doc_id = min(doc_id) OVER w AS kept
            FROM documents WINDOW w AS (PARTITION BY text)"""
    }
