"""Corpus pipeline: five stages over ``documents``, each written and read again.

Language ID drops texts of unknown language, near-duplicate detection keeps one document
of each class, decontamination drops documents that hold benchmark passages, the secret
scan replaces secrets in the texts, and SentencePiece encoding gives the final rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from topicloom.llm import decontaminate, language, pieces, prob_minhash, secret_scan
from topicloom.llm import queries as Q
from topicloom.runtime import materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified, learning from the stage's own labelled rows."""
    return language.keep_identified(docs, docs.filter(~Q.held(Q.LABEL_FOLD, 0)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return prob_minhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by ``benchmark``."""
    return decontaminate.drop_contaminated(docs, Q.table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced."""
    return secret_scan.redact(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document."""
    return pieces.encode_decode(docs, Q.piece_model()).select("doc_id", *Q.piece_digests())


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
    ("secrets", secrets), ("encoding", encoding),
]

#: Not expressible in SQL: tests/llm compare the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = Q.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
