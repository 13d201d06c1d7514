"""Stages of the corpus pipeline: each takes and returns documents, and calls one operator of this subpackage.

Defined results of all stages: null texts are empty ones and stay null; texts of any length are worked on whole; an empty table
gives an empty one; columns of any name beside those of documents pass unchanged through all but the last. Repeated rows
and equal texts are copies of one another for the second stage, which keeps one row; elsewhere each is worked on alone. Of rows
with equal doc_id and different texts every text that is not a copy stays. Rows with a null doc_id are kept unless their text
is a copy of one with a doc_id, or of another such row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import near_dup, packing, pii, quality, repeats
from .common import stage
from .queries import tokenizer

#: Scores from here up are kept.
THRESHOLD = 0.3


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """Names like these that docs has no column of."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
        taken.add(n.lower())
    return out


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from labelled documents of the input, does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = quality.fit(docs, labels.where(~quality.held_out()).select("doc_id", "quality"))
    (name,) = free_names(docs, "score")
    return quality.score(docs, weights, name=name).where(F.col(name) >= THRESHOLD).drop(name)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component (five words, similarity 0.8): the one with the smallest doc_id.

    Further rows with the same doc_id, and rows without one, come after all others. Texts without words are copies of nothing."""
    columns = docs.columns
    row, key, many, own, digest = free_names(docs, "row", "key", "many", "own", "digest")
    # a key that no other row has: doc_id, and for further rows with the same one, or without, a number above all in use
    docs = stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    again = docs.groupBy("doc_id").agg(F.count("*").alias(many)).where((F.col(many) > 1) | F.col("doc_id").isNull()).select(F.col("doc_id").alias(many))
    texts = docs.select("doc_id", row, F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias(digest))
    texts = texts.join(again, texts.doc_id.eqNullSafe(again[many]), "left_semi")
    first = texts.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(digest, row)).alias(own)).select(F.col(f"{own}.{row}").alias(row))
    further = texts.join(first, row, "left_anti").select(row, F.lit(True).alias(own))
    docs = docs.join(further, row, "left").withColumn(key, F.when(F.col(own), F.lit(1 << 62) + F.col(row)).otherwise(F.col("doc_id")))
    found = near_dup.near_duplicates(docs, key=key, k=5, percent=80).where("not kept").select(key)
    return docs.join(found, key, "left_anti").select(columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that recur (a text may end up empty); only text and n_chars change."""
    return repeats.remove_repeats(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), 2)
