"""Command line: build an index of genomes, identify a sample, choose representatives.

    python -m seqlake.cli build     -i genomes/ -o db/ [-c clusters.tsv] [-k 31] [-n 1000] [-x 30000] [-u 100000] [-r 3000]
                                    [-g 1.0] [--blocks blocks.gff] [--strand canonical] [--memory]
    python -m seqlake.cli identify  -i reads.fq [-j mates.fq] -d db/ -o out/ [-l 0] [-b] [-e] [-s 40] [-p 1 -q genomes/ | -p 2 -q plasmids/]
    python -m seqlake.cli subsample -i genomes/ -o out/ [-d 0.99]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.dominance import ScanConfig
from .plans import index as ix
from .runtime import ship
from .sources import readers, writers


def named_genomes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return named(spark, readers.read_genomes(spark, path))


def named(spark: SparkSession, genomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(genomes with long ids, names: strain, name). Ids count the names in order; there is one small row a strain."""
    g = genomes.withColumnRenamed("strain", "name")
    names = spark.createDataFrame([(i, r.name) for i, r in enumerate(g.select("name").distinct().orderBy("name").collect(), 1)], "strain long, name string")
    return g.join(F.broadcast(names), "name"), names


def build(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.blocks:  # which are places of whole sequences
        genomes, names = named_genomes(spark, a.input)
    else:  # only k-mers are asked for: files of any size
        genomes, names = named(spark, readers.read_genome_slices(spark, a.input, a.k))
    cfg = ix.BuildConfig(k=a.k, mink=a.mink, maxk=a.maxk, maxn=a.maxn, unique_cap=a.unique, strand=a.strand, share=a.share, memory=a.memory)
    custom = None
    if a.clusters:
        custom = readers.read_clusters(spark, a.clusters).withColumnRenamed("strain", "name").join(names, "name").select("strain", "cluster")
    blocks = readers.read_blocks(spark, a.blocks).withColumnRenamed("strain", "name").join(names, "name").drop("name") if a.blocks else None
    ix.build_index(genomes.select("strain", "seq"), cfg, custom, blocks).write(a.output)
    names.write.parquet(f"{a.output}/names")


def identify(spark: SparkSession, a: argparse.Namespace) -> None:
    index, names = ix.Index.load(spark, a.database), spark.read.parquet(f"{a.database}/names")
    reads = readers.read_reads(spark, "sample", *filter(None, (a.input, a.mates)))
    if a.probabilities:
        writers.write_report(ix.cluster_probabilities(index, ix.counts_of(reads, index.config)).orderBy(F.desc("probability"), "cluster"), f"{a.output}/probabilities")
    scan = ScanConfig.extra() if a.extra else ScanConfig(least_new=a.least * index.config.k)
    write_reports(ix.report(index, reads.select("seq"), a.level, scan), names, a.output)
    if a.plasmids == 1:  # short contigs of the genomes that the index was built of
        contigs = readers.read_genomes(spark, a.genomes).withColumnRenamed("strain", "name").join(names, "name").select("strain", "seq")
        second, named = ix.plasmids(index, reads.select("seq"), contigs, level=a.level, scan=scan), names
    elif a.plasmids == 2:  # sequences of the user's own
        own, named = named_genomes(spark, a.genomes)
        second = ix.plasmids(index, reads.select("seq"), genomes=own.select("strain", "seq"), level=a.level, scan=scan)
    else:
        second = None
    if second:
        write_reports(second, named, f"{a.output}/plasmids")


def write_reports(r: ix.Report, names: DataFrame, path: str) -> None:
    """report: all strains by their share; clusters: those of clusters of several, with all columns; singles: the other clusters."""
    kmers = F.concat_ws("/", F.col("covered").cast("string"), F.col("total").cast("string")).alias("covered_total")
    note = ["note"] if "note" in r.strains.columns else []
    writers.write_report(r.merged.join(names, "strain").select("id", "name", "cluster", "relative_abundance", "depth", "cov", kmers).orderBy("id"), f"{path}/report")
    of = r.strains.join(names, "strain").select("cluster", "strain_rank", "name", "abundance", "model_depth", "final_depth", "cov", kmers, "valid", "remain", "exist_evidence", *note)
    writers.write_report(of.orderBy("cluster", "strain_rank"), f"{path}/clusters")
    writers.write_report(r.singles.join(names, "strain").select("strain_rank", "name", "cluster", "depth", "cov", kmers).orderBy("strain_rank"), f"{path}/singles")


def subsample(spark: SparkSession, a: argparse.Namespace) -> None:
    genomes, names = named_genomes(spark, a.input)
    reps = ix.subsample(genomes.select("strain", "seq"), ix.BuildConfig(k=a.k), a.similarity)
    kept = writers.representatives(genomes, reps)
    writers.write_fasta(kept.select(F.concat_ws(" ", "name", "contig").alias("name"), "seq"), f"{a.output}/genomes")
    writers.write_report(reps.join(names, reps.rep == names.strain).select("cluster", "name"), f"{a.output}/representatives")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="seqlake", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(required=True)
    b = sub.add_parser("build")
    b.set_defaults(run=build)
    b.add_argument("-i", "--input", required=True)
    b.add_argument("-o", "--output", required=True)
    b.add_argument("-c", "--clusters")
    b.add_argument("-k", type=int, default=31)
    b.add_argument("-n", "--mink", type=int, default=1000)
    b.add_argument("-x", "--maxk", type=int, default=30_000)
    b.add_argument("-u", "--unique", type=int, default=100_000)
    b.add_argument("-r", "--maxn", type=int, default=3000)
    b.add_argument("-g", "--share", type=float, default=1.0)
    b.add_argument("--blocks")
    b.add_argument("--memory", action="store_true")
    b.add_argument("--strand", choices=("canonical", "both"), default="canonical")
    i = sub.add_parser("identify")
    i.set_defaults(run=identify)
    i.add_argument("-i", "--input", required=True)
    i.add_argument("-j", "--mates")
    i.add_argument("-d", "--database", required=True)
    i.add_argument("-o", "--output", required=True)
    i.add_argument("-l", "--level", type=int, choices=(0, 1, 2), default=0)
    i.add_argument("-b", "--probabilities", action="store_true")
    i.add_argument("-e", "--extra", action="store_true")
    i.add_argument("-s", "--least", type=int, default=40)
    i.add_argument("-p", "--plasmids", type=int, choices=(0, 1, 2), default=0)
    i.add_argument("-q", "--genomes")
    s = sub.add_parser("subsample")
    s.set_defaults(run=subsample)
    s.add_argument("-i", "--input", required=True)
    s.add_argument("-o", "--output", required=True)
    s.add_argument("-k", type=int, default=31)
    s.add_argument("-d", "--similarity", type=float, default=0.99)
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("seqlake").getOrCreate()
    ship(spark)
    a.run(spark, a)


if __name__ == "__main__":
    main()
