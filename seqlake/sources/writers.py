"""Writers (K1-K9). Tables go to Parquet partitioned by what readers prune on; reports and exchange formats to text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import block_sequence


def fasta_text(df: DataFrame, name: str = "name", seq: str = "seq") -> DataFrame:
    """K5."""
    return df.select(F.concat(F.lit(">"), F.col(name).cast("string"), F.lit("\n"), F.col(seq)).alias("value"))


def write_fasta(df: DataFrame, path: str, name: str = "name", seq: str = "seq") -> None:
    fasta_text(df, name, seq).write.text(path)


def write_report(df: DataFrame, path: str) -> None:
    """One tab-separated file with a header (K1-K4): reports have a row for each strain found. Nulls are empty."""
    df.coalesce(1).write.csv(path, sep="\t", header=True)


def write_table(df: DataFrame, path: str, *by: str) -> None:
    """K6: a long table in place of a sparse matrix and its id list."""
    df.write.partitionBy(*by).parquet(path)


def block_text(blocks: DataFrame, genomes: DataFrame) -> DataFrame:
    """MAF-like lines of blocks (K7): one `a` line a block, an `s` line for each of its sequences."""
    x = blocks.join(genomes, "strain").withColumn("part", block_sequence(F.col("seq"), F.col("start").cast("int"), F.col("end").cast("int"), F.col("strand")))
    s = F.concat_ws(" ", F.lit("s"), F.col("strain").cast("string"), F.col("start").cast("string"), (F.col("end") - F.col("start")).cast("string"), "strand", F.length("seq").cast("string"), "part")
    x = x.select("block", F.struct(F.col("strain"), F.col("start"), s.alias("s")).alias("r")).groupBy("block").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    return x.select(F.concat(F.lit("a\n"), F.array_join(F.transform("rs", lambda r: r["s"]), "\n"), F.lit("\n")).alias("value"))


def representatives(genomes: DataFrame, reps: DataFrame) -> DataFrame:
    """Genomes of the representatives (K8)."""
    return genomes.join(reps.select(F.col("rep").alias("strain")), "strain", "left_semi")


def long_form(wide: DataFrame, row: str) -> DataFrame:
    """(row, column, value) of the cells other than 0 of a wide table (K9)."""
    cols = [c for c in wide.columns if c != row]
    return wide.unpivot(row, cols, "column", "value").where(F.col("value") != 0)
