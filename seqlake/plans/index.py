"""Whole runs: build an index of genomes, identify what a sample holds, choose representatives."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import MOST_K, kmer_codes, kmers, only_acgt
from ..functions.stats import category
from ..operators import blocks as bl
from ..operators import dominance, kmer_sets, profiles, reports, similarity, tree_search
from ..operators.corrections import corrected_nodes
from ..operators.kmer_filter import kmer_filter
from ..runtime import discard, stage, staged


@dataclass(frozen=True)
class BuildConfig:
    """Settings of a build. strand: both keeps a k-mer and its reverse complement, canonical the smaller of them.

    unique_cap: most k-mers that only one strain of a cluster has, a strain (A6). share: part of the partial blocks that is
    used (A9). recluster: distance up to which strains of a cluster count as one (C3). memory: thresholds of the memory mode
    (F18), which overlap matrices with canonical k-mers go with (J8)."""

    k: int = 31
    alpha: float = 0.8
    mink: int = 1000
    maxk: int = 30_000
    maxn: int = 3000
    unique_cap: int = 100_000
    similarity: float = 0.95
    strand: str = "canonical"
    drop_last: bool = False
    share: float = 1.0
    recluster: float = 0.01
    memory: bool = False

    @property
    def least(self) -> int:
        """K-mers below which a node is weak, and from which on a corrected node stands for itself (M3)."""
        return self.mink // 2 if self.memory else self.mink


#: Tables of an index; any of them may be empty. K-mers of up to 31 letters are two-bit codes (longs).
SCHEMAS = {
    "cluster": "cluster long, strain long",
    "node": "id long, parent long, is_leaf boolean, length long, rebuilt boolean",
    "node_kmer": "kmer string, node long",
    "l2": "strain long, kmer string, cluster long",
    "cluster_kmer": "cluster long, kmer string",
    "twin": "cluster long, strain long, rep long",
}


@dataclass
class Index:
    cluster: DataFrame  # cluster, strain
    node: DataFrame  # id, parent, is_leaf, length, rebuilt
    node_kmer: DataFrame  # node, kmer
    l2: DataFrame  # cluster, strain, kmer: of one strain for each group of twins
    cluster_kmer: DataFrame  # cluster, kmer
    config: BuildConfig
    twin: DataFrame | None = None  # cluster, strain, rep: strains that l2 does not tell apart

    def write(self, path: str) -> None:
        spark = self.cluster.sparkSession
        self.cluster.write.parquet(f"{path}/cluster")
        self.node.write.parquet(f"{path}/node")
        # a node has maxk k-mers at most: one file; a cluster has any number
        self.node_kmer.repartition("node").write.partitionBy("node").parquet(f"{path}/node_kmer")
        self.l2.repartition(F.col("cluster"), F.pmod(F.xxhash64("kmer"), F.lit(8))).write.partitionBy("cluster").parquet(f"{path}/l2")
        self.cluster_kmer.write.parquet(f"{path}/cluster_kmer")
        (self.twin if self.twin is not None else spark.createDataFrame([], SCHEMAS["twin"])).write.parquet(f"{path}/twin")
        spark.createDataFrame([asdict(self.config)]).write.parquet(f"{path}/manifest")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        cfg = BuildConfig(**spark.read.parquet(f"{path}/manifest").first().asDict())
        read = lambda t: spark.read.schema(SCHEMAS[t].replace("kmer string", "kmer long" if cfg.k <= MOST_K else "kmer string")).parquet(f"{path}/{t}")
        return cls(*map(read, list(SCHEMAS)[:5]), cfg, read("twin"))


def occurrences(genomes: DataFrame, cfg: BuildConfig, by: str = "strain", keep: Callable | None = None) -> DataFrame:
    """(strain, kmer) of every position, upper-cased and ACGT only: two-bit codes where they fit a long. keep: see kmer_codes."""
    x = genomes.select(by, F.upper("seq").alias("seq"))
    if cfg.k <= MOST_K:
        return kmer_codes(x, cfg.k, drop_last=cfg.drop_last, strand=cfg.strand, keep=keep)
    return kmers(x, cfg.k, drop_last=cfg.drop_last, strand=cfg.strand).where(only_acgt(F.col("kmer"))).select(by, "kmer")


def cluster_genomes(inc: DataFrame, similarity_: float) -> DataFrame:
    pairs = similarity.jaccard(inc, least=similarity_).select("a", "b", F.col("jaccard").alias("similarity"))
    return similarity.single_linkage(inc.select("strain").distinct(), pairs, similarity_)


def repaired(mult: DataFrame, cluster: DataFrame, sims: DataFrame, cfg: BuildConfig) -> DataFrame:
    """Clusters, merged until every leaf has mink core k-mers of its own, each weak one with the most similar.

    Multiplicities of merged clusters add up, so genomes are not read again. Rounds work on the number of exclusive k-mers of
    each cluster, a small table, and merge all weak clusters of a round at once."""
    while True:
        sizes = cluster.groupBy("cluster").agg(F.count("*").alias("n"))
        by = mult.join(cluster, "strain").groupBy("cluster", "kmer").agg(F.sum("mult").alias("mult"))
        marked = kmer_sets.core(by, sizes, cfg.alpha)
        own = marked.groupBy("kmer").agg(F.min("cluster").alias("cluster"), F.max("cluster").alias("last"), F.min("is_core").alias("c")).where("cluster = last and c")
        weak = sizes.join(own.groupBy("cluster").agg(F.count("*").alias("m")), "cluster", "left").where(F.coalesce("m", F.lit(0)) < cfg.mink)
        near = sims.join(cluster.select(F.col("strain").alias("a"), F.col("cluster").alias("ca")), "a").join(cluster.select(F.col("strain").alias("b"), F.col("cluster").alias("cb")), "b").where("ca <> cb")
        near = near.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.max("similarity").alias("similarity"))
        best = similarity.nearest_neighbour(near).join(weak.select(F.col("cluster").alias("a")), "a", "left_semi").select("a", "b", F.lit(1.0).alias("similarity"))
        if best.isEmpty():
            return cluster
        merged = similarity.single_linkage(sizes.select(F.col("cluster").alias("strain")), best, 1.0).withColumnRenamed("cluster", "to")
        cluster = stage(cluster.join(merged.withColumnRenamed("strain", "cluster"), "cluster").select("strain", F.col("to").alias("cluster")), "clusters")


def build_index(genomes: DataFrame, cfg: BuildConfig = BuildConfig(), custom: DataFrame | None = None, blocks: DataFrame | None = None) -> Index:
    """Index of genomes(strain long, seq). custom: cluster, strain in place of single linkage. blocks: block, strain, strand,
    start, end of colinear blocks; without them every genome is a block of its own."""
    spark = genomes.sparkSession
    mult, at_mult = staged(occurrences(genomes, cfg).groupBy("strain", "kmer").agg(F.count("*").alias("mult")), "mult")
    inc = mult.select("strain", "kmer")
    # of all pairs only those of a maximum spanning forest: single linkage, the best edge out of a cluster and the tree need no others
    sims, at_sims = staged(similarity.spanning_edges(inc), "similarity")
    cluster = custom if custom is not None else similarity.single_linkage(inc.select("strain").distinct(), sims, cfg.similarity)
    cluster = stage(repaired(mult, cluster, sims, cfg), "clusters")
    ids = sorted(r.cluster for r in cluster.select("cluster").distinct().collect())  # clusters: a small table
    near = sims.join(cluster.select(F.col("strain").alias("a"), F.col("cluster").alias("ca")), "a").join(cluster.select(F.col("strain").alias("b"), F.col("cluster").alias("cb")), "b").where("ca <> cb")
    near = near.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.max("similarity").alias("similarity"))
    tree = similarity.dendrogram(ids, [(r.a, r.b, r.similarity) for r in similarity.spanning_forest(near).collect()])
    nodes = spark.createDataFrame([(i, p, i in set(ids)) for i, p in tree], "id long, parent long, is_leaf boolean")
    sizes = cluster.groupBy("cluster").agg(F.count("*").alias("n"))
    by = mult.join(cluster, "strain").groupBy("cluster", "kmer").agg(F.sum("mult").alias("mult"))
    cluster_kmer = kmer_sets.core(by, sizes, cfg.alpha if len(ids) > 1 else 1.0)
    up = kmer_sets.closure(nodes.select("id", "parent"))
    leaves = up.join(nodes.where("is_leaf").select(F.col("id").alias("node")), "node", "left_semi").select(F.col("ancestor").alias("node"), F.col("node").alias("leaf"))
    node_kmer = kmer_sets.hash_capped(kmer_sets.node_sets(cluster_kmer, leaves), "node", cfg.maxk)
    length = node_kmer.groupBy("node").agg(F.count("*").alias("length"))
    n_leaves = leaves.groupBy("node").agg(F.count("*").alias("leaves"))
    short = n_leaves.join(length, "node", "left").where((F.coalesce("length", F.lit(0)) < cfg.mink) & (F.col("leaves") <= cfg.maxn)).select("node")
    depth = up.groupBy(F.col("node").alias("id")).agg(F.max("up").alias("depth"))
    leaf_sets = cluster_kmer.select(F.col("cluster").alias("leaf"), "kmer")
    new = kmer_sets.rebuilt_sets(leaf_sets, cluster_kmer.where("is_core").select(F.col("cluster").alias("leaf"), "kmer"), leaves, depth, short, cfg.maxk)
    node_kmer = node_kmer.join(short, "node", "left_anti").unionByName(new.select("node", "kmer"))
    length = node_kmer.groupBy(F.col("node").alias("id")).agg(F.count("*").alias("length"))
    node = nodes.join(length, "id", "left").join(short.select(F.col("node").alias("id"), F.lit(True).alias("rebuilt")), "id", "left").select("id", "parent", "is_leaf", F.coalesce("length", F.lit(0).cast("long")).alias("length"), F.coalesce("rebuilt", F.lit(False)).alias("rebuilt"))
    l2, twin = strain_kmers(genomes, inc.join(cluster, "strain"), cluster, cfg, blocks)
    out = Index(cluster, stage(node, "nodes"), stage(node_kmer, "node-kmers"), stage(l2, "strain-kmers"), stage(cluster_kmer.select("cluster", "kmer"), "cluster-kmers"), cfg, twin)
    discard(spark, at_mult, at_sims)
    return out


def strain_kmers(genomes: DataFrame, own: DataFrame, cluster: DataFrame, cfg: BuildConfig, blocks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(l2: cluster, strain, kmer; twin: cluster, strain, rep): the k-mers that tell the strains of a cluster apart.

    They are those of one strain alone, up to a cap (A5, A6), and those of some but not all strains (A8), which with blocks
    must lie in one block of all strains, or in a partial block and in no strain outside it (A7, A9). Strains that these
    k-mers hardly tell apart are one, and the one with the most stays (A23, C3, T4)."""
    n = cluster.groupBy("cluster").agg(F.count("*").alias("size"))
    own = own.select("cluster", "strain", "kmer").distinct()
    have = own.groupBy("cluster", "kmer").agg(F.count("*").alias("m"), F.min("strain").alias("only"))
    unique = have.join(n, "cluster").where("m = 1 and size > 1").select("cluster", F.col("only").alias("strain"), "kmer")
    unique = kmer_sets.capped(unique, "strain", cfg.unique_cap, F.col("kmer"))
    if blocks is None:
        some = have.join(n, "cluster").where("m > 1 and m < size").select("cluster", "kmer")
    else:
        some = bl.block_kmers(genomes, cluster, blocks, own, cfg.share, lambda g: occurrences(g, cfg))
    l2, at = staged(unique.unionByName(own.join(some, ["cluster", "kmer"], "left_semi").select("cluster", "strain", "kmer")).distinct(), "l2")
    twin = stage(similarity.near_identical(l2, cfg.recluster), "twins")
    return l2.join(twin.select(F.col("rep").alias("strain")).distinct(), "strain", "left_semi").select("cluster", "strain", "kmer"), twin


def known_kmers(index: Index) -> DataFrame:
    """The k-mers of an index: of its nodes and its clusters."""
    return index.node_kmer.select("kmer").union(index.cluster_kmer.select("kmer")).distinct()


def counts_of(reads: DataFrame, cfg: BuildConfig, known: DataFrame | None = None) -> DataFrame:
    """(sample, kmer, cnt) of reads(sample, seq), or (kmer, cnt) where reads have no sample. known: kmer, the only ones that are counted
    (J1): most others are dropped before the shuffle by a bitmap, the rest by a semi-join of the counts."""
    by = [c for c in ("sample",) if c in reads.columns]
    x = reads.select(F.col(by[0]) if by else F.lit(0).cast("long").alias("sample"), "seq")
    keep = None
    if known is not None:
        known = stage(known.select("kmer").distinct(), "known")
        keep = kmer_filter(known) if cfg.k <= MOST_K else None
    out = occurrences(x, cfg, "sample", keep).groupBy(*by, "kmer").agg(F.count("*").alias("cnt"))
    return out if known is None else out.join(known, "kmer", "left_semi").select(*by, "kmer", "cnt")


def find_clusters(index: Index, counts: DataFrame, level: int = 0) -> DataFrame:
    """L1: (sample, cluster, ab, cov, covered, total, share, how) of the clusters in every sample of counts(sample, kmer, cnt)."""
    cfg = index.config
    kind = category(F.col("length"), F.col("is_leaf"), F.col("rebuilt"), cfg.least, 3 * cfg.least, cfg.memory)
    node = index.node.select("id", "parent", "is_leaf", "length", kind.alias("category"))

    def correct(todo: DataFrame, leaves: DataFrame) -> DataFrame:
        return corrected_nodes(todo, leaves, index.node_kmer, counts, index.cluster_kmer, cfg.least)

    return tree_search.search(node, profiles.sample_metrics(index.node_kmer, counts), tree_search.PRESETS[level], correct)


@dataclass
class Report:
    """What identify says of a sample: strains of clusters of several (K1) and of one (K3), and all of them by their share (K2). With
    a sample column where the reads have one."""

    strains: DataFrame
    singles: DataFrame
    merged: DataFrame


def report(index: Index, reads: DataFrame, level: int = 0, scan: dominance.ScanConfig = dominance.ScanConfig()) -> Report:
    """Reports of the strains in reads(seq), or in each sample of reads(sample, seq)."""
    several = "sample" in reads.columns
    counts, at = staged(counts_of(reads if several else reads.withColumn("sample", F.lit(0).cast("long")), index.config, known_kmers(index)), "counts")
    found = find_clusters(index, counts, level)
    detected = found.select("sample", "cluster", F.col("ab").alias("cls_ab"), F.col("cov").alias("cls_cov"), F.col("covered").alias("cls_covered"), F.col("total").alias("cls_total"))
    size = index.cluster.groupBy("cluster").agg(F.count("*").alias("size"))
    single = index.cluster.join(detected, "cluster").join(size, "cluster").where("size = 1")
    singles = reports.single_report(single.select("sample", "cluster", "strain", F.col("cls_ab").alias("depth"), F.col("cls_cov").alias("cov"), F.col("cls_covered").cast("long").alias("covered"), F.col("cls_total").alias("total")))
    l2 = index.l2.join(detected.select("cluster").distinct(), "cluster", "left_semi")
    own = profiles.exclusive_counts(counts, index.cluster_kmer, detected.select("sample", "cluster"))
    strains = stage(reports.strain_report(dominance.detect(l2, counts, own, scan, detected), detected.select("sample", "cluster", "cls_ab"), scan.is_extra), "strains")
    singles = stage(singles, "singles")
    discard(reads.sparkSession, at)
    merged = reports.merged_report(singles.select("sample", "cluster", "strain", "depth", "cov", "covered", "total"), strains)
    return Report(strains, singles, merged) if several else Report(*(x.drop("sample") for x in (strains, singles, merged)))


def identify(index: Index, reads: DataFrame, level: int = 0, scan: dominance.ScanConfig = dominance.ScanConfig()) -> DataFrame:
    """Merged report of the strains in reads(seq), or reads(sample, seq): id, cluster, strain, depth, relative_abundance and what it
    rests on."""
    return report(index, reads, level, scan).merged


def cluster_probabilities(index: Index, counts: DataFrame, least: int = 1000) -> DataFrame:
    """Low-depth ranking (M8): (cluster, probability, n_strains, strains), from nodes of at least `least` k-mers."""
    from ..functions.stats import log_scale

    m = profiles.node_metrics(index.node_kmer, counts)
    x = m.select("node", F.when(F.col("length") >= least, log_scale(F.col("cov"))).alias("x"))
    up = kmer_sets.closure(index.node.select("id", "parent"))
    paths = up.join(index.node.where("is_leaf").select(F.col("id").alias("node")), "node", "left_semi").select(F.col("node").alias("leaf"), F.col("ancestor").alias("node"))
    return reports.probability_report(profiles.geometric_scores(x, paths).select(F.col("leaf").alias("cluster"), F.col("score").alias("probability")), index.cluster)


def subsample(genomes: DataFrame, cfg: BuildConfig = BuildConfig(), least: float = 0.99) -> DataFrame:
    """(cluster, rep): one representative of each complete-linkage cluster at a similarity."""
    inc, at = staged(occurrences(genomes, cfg).distinct(), "incidence")
    pairs = stage(similarity.jaccard(inc, least=least).select("a", "b", F.col("jaccard").alias("similarity")), "similarity")
    cluster = stage(similarity.complete_linkage(inc.select("strain").distinct(), pairs, least), "clusters")
    out = stage(similarity.medoids(cluster, pairs.select("a", "b", (1 - F.col("similarity")).alias("distance"))), "representatives")
    discard(genomes.sparkSession, at)
    return out


def short_contigs(genomes: DataFrame, clusters: DataFrame, below: int = 100_000) -> DataFrame:
    """Contigs of detected clusters that may be plasmids (F4, M15): the genomes of a second, smaller index (mink 500)."""
    return genomes.join(clusters, "strain", "left_semi").where(F.length("seq") < below)


def plasmids(index: Index, reads: DataFrame, contigs: DataFrame | None = None, genomes: DataFrame | None = None, level: int = 0, below: int = 100_000, mink: int = 500, scan: dominance.ScanConfig = dominance.ScanConfig()) -> Report | None:
    """Plasmids of the clusters of several strains that reads hold (M15): a second index of their short contigs (contigs: strain,
    seq), or of genomes of the user's own, and a second search. None where there is nothing to index. A plasmid of a user's own is
    wanted at 0.7 of its k-mers like any strain; one of the clusters found at any share of them (F13)."""
    if genomes is None:
        several = reads if "sample" in reads.columns else reads.withColumn("sample", F.lit(0).cast("long"))
        counts = stage(counts_of(several, index.config, index.node_kmer.select("kmer").union(index.cluster_kmer.select("kmer"))), "counts")
        found = find_clusters(index, counts, level).select("cluster").distinct()
        size = index.cluster.groupBy("cluster").agg(F.count("*").alias("size")).where("size > 1")
        wanted = index.cluster.join(found, "cluster", "left_semi").join(size, "cluster", "left_semi").select("strain")
        genomes = short_contigs(contigs, wanted, below)
        scan = replace(scan, coverage=0.0)
    genomes = genomes.where(F.length("seq") >= index.config.k)
    if genomes.isEmpty():
        return None
    second = build_index(genomes.select("strain", "seq"), replace(index.config, mink=mink))
    return report(second, reads, level, scan)
