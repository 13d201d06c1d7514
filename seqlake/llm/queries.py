"""Queries of this subpackage, each over its whole table with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_binary import token_binary

    return token_binary(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"), 1)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_ids import sentencepiece_ids

    return sentencepiece_ids(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op3_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import fingerprint_edits

    return fingerprint_edits(documents(spark, sf_dir))


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .katz import lm_scores

    return lm_scores(documents(spark, sf_dir))


def op6_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with query_id: classes that match; rows with row_id: the class (match_id) of every recording."""
    from .chroma import fingerprints, matches, members, render
    from .common import stage

    prints = stage(fingerprints(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", render), "prints")
    rows = members(prints).selectExpr("key AS row_id", "class_id AS match_id", "copies")
    return matches(prints, lambda key: key % 50 == 0).unionByName(rows, allowMissingColumns=True)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), 2)


def op8_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove_repeats

    return remove_repeats(documents(spark, sf_dir), digest=True)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(documents(spark, sf_dir), k=4)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_pii

    return find_pii(documents(spark, sf_dir))


def op11_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_conversations

    return format_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import source_divergence

    return source_divergence(documents(spark, sf_dir))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .whitening import whiten

    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from . import chat, divergence

    return {"op11_reply_trees": chat.ORACLE, "op12_source_divergence": divergence.ORACLE}
