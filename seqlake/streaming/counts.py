"""Running k-mer counts of reads that arrive as files; the counts feed the index probe like those of a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import MOST_K, kmer_codes, kmers, only_acgt


def streamed_counts(reads: DataFrame, k: int) -> DataFrame:
    """(kmer, cnt) over a stream of reads(seq), for complete or update mode. State is one row a canonical k-mer."""
    x = reads.select(F.upper("seq").alias("seq"))
    x = kmer_codes(x, k, strand="canonical") if k <= MOST_K else kmers(x, k, strand="canonical").where(only_acgt(F.col("kmer")))
    return x.groupBy("kmer").agg(F.count("*").alias("cnt"))


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """Parquet reads (seq) as a stream of files."""
    return spark.readStream.schema("seq string").parquet(path)
