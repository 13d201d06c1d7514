"""K-mers of colinear blocks, for the strains of a cluster."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import block_sequence
from .kmer_sets import block_kinds, confined


def block_kmers(genomes: DataFrame, cluster: DataFrame, blocks: DataFrame, own: DataFrame, share: float, occurrences: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(cluster, kmer) that blocks of a cluster's strains offer: of a block of all strains the k-mers of some but not all (A8), of
    the partial blocks in use (A9) those that no strain outside the block has (A7). blocks: block, strain, strand, start, end;
    a block id belongs to one cluster."""
    at = blocks.join(cluster, "strain")
    n = cluster.groupBy("cluster").agg(F.count("*").alias("size"))
    kinds = block_kinds(at.join(n, "cluster").select("block", "strain", "size", "cluster"), F.col("size"), share, by="cluster").where("used")
    parts = at.join(kinds.select("block", "kind"), "block").join(genomes.select("strain", "seq"), "strain")
    parts = parts.select("block", "kind", "cluster", F.col("strain").alias("of"), block_sequence(F.col("seq"), F.col("start").cast("int"), F.col("end").cast("int"), F.col("strand")).alias("seq"))
    key = F.struct("block", "kind", "cluster", "of").alias("strain")
    inside = occurrences(parts.select(key, "seq")).select("strain.block", "strain.kind", "strain.cluster", F.col("strain.of").alias("strain"), "kmer").distinct()
    have = own.groupBy("cluster", "kmer").agg(F.count("*").alias("m")).join(n, "cluster")
    whole = inside.where("kind = 'global'").select("cluster", "kmer").distinct().join(have.where("m > 1 and m < size"), ["cluster", "kmer"]).select("cluster", "kmer")
    partial = inside.where("kind = 'partial'").select("cluster", "block", "strain", F.struct("cluster", "kmer").alias("kmer"))
    some = confined(own.select("strain", F.struct("cluster", "kmer").alias("kmer")), partial).select("kmer.cluster", "kmer.kmer")
    return whole.unionByName(some).distinct()
