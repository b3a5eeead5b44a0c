"""Registered queries of the operators: thin, on whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import run_path
from . import blocks as B
from . import bpe_count, context_tree, decontaminate, filter_audit, host_rules, language, pieces, prob_minhash, quality_gam
from . import secret_scan, token_binary, vector_codes, warc_writer

#: Folds: crc32 of the id as text, modulo.
LABEL_FOLD, TEXT_FOLD, TEXT_HELD = 5, 7, 2


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def piece_model() -> str:
    return str(public_tokenizers.path("piece_bpe_32k.model"))


def held(modulus: int, remainder: int) -> Column:
    """Held out from learning; so is a row without an id."""
    return F.coalesce(B.id_crc(modulus) == remainder, F.lit(True))


def with_fold(result: DataFrame, modulus: int, remainder: int) -> DataFrame:
    return result.withColumn("held_out", held(modulus, remainder))


def op1_quality(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents").select("doc_id", "text")
    labels = table(spark, directory, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality_gam.learn(docs, labels.filter(~held(LABEL_FOLD, 0)))
    return with_fold(quality_gam.score(docs, model), LABEL_FOLD, 0).select("doc_id", "held_out", "score", "predicted")


def op2_host_rules(spark: SparkSession, directory: str) -> DataFrame:
    found = host_rules.judge_hosts(table(spark, directory, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        "base_failed", "kept", "host_docs", "host_failed")


def op3_token_counts(spark: SparkSession, directory: str) -> DataFrame:
    return bpe_count.count_tokens(table(spark, directory, "documents"), piece_model())


def op4_decontamination(spark: SparkSession, directory: str) -> DataFrame:
    found = decontaminate.judge(table(spark, directory, "documents"), table(spark, directory, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated")


def op5_context_tree(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents").select("doc_id", "text")
    found = context_tree.score(docs, docs.filter(~held(TEXT_FOLD, TEXT_HELD)))
    return with_fold(found, TEXT_FOLD, TEXT_HELD).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes")


def op6_warc(spark: SparkSession, directory: str) -> DataFrame:
    path = run_path(spark, "warc")
    warc_writer.write_archives(table(spark, directory, "pages"), path)
    return warc_writer.read_archives(spark, path, payload=False).drop("url")


def op7_near_duplicates(spark: SparkSession, directory: str) -> DataFrame:
    return prob_minhash.classes(table(spark, directory, "documents"))


def op8_pieces(spark: SparkSession, directory: str) -> DataFrame:
    made = pieces.encode_decode(table(spark, directory, "documents"), piece_model())
    return made.select("doc_id", *piece_digests())


def piece_digests() -> list[Column]:
    return [F.size("ids").cast("long").alias("n_tokens"),
            F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
            F.sha2("decoded", 256).alias("decoded_sha256")]


def op9_secrets(spark: SparkSession, directory: str) -> DataFrame:
    found = secret_scan.scan(table(spark, directory, "documents"))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])

    def counted(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [counted(kind) for kind in secret_scan.KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"))


def op10_language(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents")
    found = language.identify(docs, docs.filter(~held(LABEL_FOLD, 0)))
    return with_fold(found, LABEL_FOLD, 0).select("doc_id", "held_out", "lang_pred", "score")


def op11_filter_audit(spark: SparkSession, directory: str) -> DataFrame:
    return filter_audit.audit(table(spark, directory, "documents"), table(spark, directory, "labels"))


def op12_token_binary(spark: SparkSession, directory: str) -> DataFrame:
    model = str(public_tokenizers.path("word_bpe_49k.json"))
    return token_binary.write_and_read(table(spark, directory, "documents"), model, run_path(spark, "token-shards"))


def op13_vector_codes(spark: SparkSession, directory: str) -> DataFrame:
    coded, codebooks = vector_codes.encode(table(spark, directory, "embeddings"))
    return vector_codes.with_label_error(coded).select(
        "vec_id", "code", "error", "label_error", F.lit(vector_codes.codebook_digest(codebooks)).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_host_rules": op2_host_rules,
    "op3_token_counts": op3_token_counts,
    "op4_decontamination": op4_decontamination,
    "op5_context_tree": op5_context_tree,
    "op6_warc": op6_warc,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_pieces": op8_pieces,
    "op9_secrets": op9_secrets,
    "op10_language": op10_language,
    "op11_filter_audit": op11_filter_audit,
    "op12_token_binary": op12_token_binary,
    "op13_vector_codes": op13_vector_codes,
}
