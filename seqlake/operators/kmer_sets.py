"""Incidence of k-mers in strains and clusters: multiplicities, cores, unique k-mers, set algebra over a tree.

Tables: inc(strain, kmer), cluster(strain, cluster), cluster_kmer(cluster, kmer, mult, is_core), closure(node, leaf).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import codes_of, codes_of_parts, kmer_runs
from ..runtime import discard, stage, staged


def multiplicity(occurrences: DataFrame, by: str = "cluster") -> DataFrame:
    """How often each k-mer occurs in each cluster, every occurrence counted (A1)."""
    return occurrences.groupBy(by, "kmer").agg(F.count("*").alias("mult"))


def core(mult: DataFrame, sizes: DataFrame, alpha: float = 0.8) -> DataFrame:
    """Marks the k-mers with at least alpha occurrences a genome (A2; alpha 1: A3). sizes: cluster, n."""
    return mult.join(sizes, "cluster").select("cluster", "kmer", "mult", (F.col("mult") >= alpha * F.col("n")).alias("is_core"))


#: Buckets of k-mers for each partition of the genomes; about a million k-mers each where a partition is 128 MB.
BUCKETS = 128
MOST_CODE = (1 << 63) - 1


def whole_incidence(genomes: DataFrame, k: int, label: Column | None = None, strand: str = "given") -> DataFrame:
    """(strain, kmer, times, total, n_strains, first, lo, hi) for every k-mer of genomes(strain, seq) and each strain that has it: how often in
    the strain and in all, how many strains have it, the first of them, and the least and largest label of these (the strain itself without one).

    Runs of neighbouring k-mers that share a minimizer meet in buckets (A4), so no k-mer is shuffled; a bucket is sorted in one task.
    Null strains count in the total alone. k up to 31; label: a whole number of a row."""
    def of_bucket(t: pa.Table) -> pa.Table:
        x = _sorted_bucket(t, k, strand)
        of = x["of"]
        out = {"strain": x["strain"], "kmer": x["kmer"], "times": x["times"], **{c: x[c][of] for c in ("total", "n_strains", "first", "lo", "hi")}}
        return pa.table({c: pa.array(v[x["known"]], pa.int64()) for c, v in out.items()})

    return _buckets(genomes, k, label, strand).applyInArrow(of_bucket, "strain long, kmer long, times long, total long, n_strains long, first long, lo long, hi long")


def whole_patterns(genomes: DataFrame, k: int, strand: str = "given") -> DataFrame:
    """What `similarity.pattern_incidence` tells of the k-mers of genomes(strain, seq): (strain, p, q, f, n), k-mers counted by pattern in
    their buckets before anything of them is shuffled."""

    def of_bucket(t: pa.Table) -> pa.Table:
        x = _sorted_bucket(t, k, strand)
        own = lambda v: pa.array(v[x["of"]][x["known"]], pa.int64())
        out = pa.table({"strain": pa.array(x["strain"][x["known"]], pa.int64()), "p": own(x["p"]), "q": own(x["q"]), "f": own(x["n_strains"])})
        return out.group_by(["strain", "p", "q", "f"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["strain", "p", "q", "f", "n"])

    some = _buckets(genomes, k, None, strand).applyInArrow(of_bucket, "strain long, p long, q long, f long, n long")
    return some.groupBy("strain", "p", "q", "f").agg(F.sum("n").alias("n"))


def _buckets(genomes: DataFrame, k: int, label: Column | None, strand: str):
    g = genomes.select("strain", (F.col("strain") if label is None else label).cast("long").alias("label"), "seq")
    return kmer_runs(g, k, BUCKETS * genomes.rdd.getNumPartitions(), strand=strand, pack=True).groupBy("bucket")


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of whole numbers."""
    x = x.astype(np.uint64) + np.uint64(seed)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def _sorted_bucket(t: pa.Table, k: int, strand: str) -> dict[str, np.ndarray]:
    """A bucket's k-mers in order: by pair of k-mer and strain (strain, kmer, times, known, and of, the k-mer's place), and by k-mer (the others)."""
    t = t.sort_by("strain").combine_chunks()  # nulls last
    codes, part = codes_of_parts(t["part"].combine_chunks(), k, strand)
    order = np.argsort(codes, kind="stable")
    codes, part = codes[order], part[order]
    known = np.array(t["strain"].is_valid())[part]
    strain, label = (np.array(t[c].fill_null(0))[part] for c in ("strain", "label"))
    new = np.append(True, codes[1:] != codes[:-1])[: len(codes)]
    pair = new | np.append(True, (strain[1:] != strain[:-1]) | (known[1:] != known[:-1]))[: len(codes)]
    first, own = np.flatnonzero(new), np.flatnonzero(pair)
    most, in_set = np.iinfo(np.int64).max, pair & known
    by = lambda f, v: f.reduceat(v, first) if len(first) else np.zeros(0, np.int64)
    return {
        "strain": strain[own], "kmer": codes[own], "known": known[own], "times": np.diff(np.append(own, len(codes))), "of": (np.cumsum(new) - 1)[own],
        "total": np.diff(np.append(first, len(codes))), "n_strains": by(np.add, in_set.astype(np.int64)), "first": strain[first],
        "lo": by(np.minimum, np.where(known, label, most)), "hi": by(np.maximum, np.where(known, label, -most)),
        "p": by(np.bitwise_xor, np.where(in_set, _mixed(strain, 1), 0)), "q": by(np.bitwise_xor, np.where(in_set, _mixed(strain, 1 << 40), 0)),
    }


def first_unique(genomes: DataFrame, k: int, cap: int, strand: str = "given") -> DataFrame:
    """(strain, kmer): the `cap` smallest codes of each strain that no other strain has.

    First only the smallest codes of a strain are asked, three times as many as wanted; strains that have too few unique ones among
    these are asked for all. So what is ranked does not grow with the length of genomes."""
    many = 3 * cap

    @F.pandas_udf("long")
    def limit(seqs: pd.Series) -> pd.Series:
        out = []
        for seq in seqs:
            u = np.unique(codes_of((seq or "").encode("latin-1", "replace"), k, strand))
            out.append(int(u[many - 1]) if len(u) > many else MOST_CODE)
        return pd.Series(out, dtype="int64")

    g = genomes.select("strain", "seq", limit("seq").alias("limit"))
    whole = genomes.where("strain is not null").select("strain", limit("seq").alias("limit")).groupBy("strain").agg(F.min("limit").alias("limit"))
    some = whole_incidence(g, k, F.col("limit"), strand).where("n_strains = 1 and kmer <= hi").select("strain", "kmer")
    some = some.withColumnRenamed("strain", "of")
    some = stage(whole.join(some, (F.col("strain") == F.col("of")) & (F.col("kmer") <= F.col("limit")), "left").select("strain", "limit", "kmer"), "unique")
    few = some.groupBy("strain").agg(F.count("kmer").alias("n"), F.max("limit").alias("limit")).where((F.col("n") < cap) & (F.col("limit") < MOST_CODE)).select("strain")
    few = stage(few, "few")
    out = some.where("kmer is not null").select("strain", "kmer")
    if not few.isEmpty():
        rest = whole_incidence(genomes, k, None, strand).where("n_strains = 1").select("strain", "kmer").join(few, "strain", "left_semi")
        out = out.join(few, "strain", "left_anti").unionByName(rest)
    return capped(out, "strain", cap, F.col("kmer"))


def incidence(inc: DataFrame) -> DataFrame:
    """Number of strains and the sorted strains of each k-mer (A4)."""
    return inc.groupBy("kmer").agg(F.countDistinct("strain").alias("n_strains"), F.sort_array(F.collect_set("strain")).alias("strains"))


def unique_kmers(inc: DataFrame) -> DataFrame:
    """(strain, kmer) of k-mers that occur in one strain only (A5): one aggregate, no anti-join."""
    return inc.groupBy("kmer").agg(F.min("strain").alias("strain"), F.max("strain").alias("last")).where("strain = last").select("strain", "kmer")


def capped(df: DataFrame, by: str, cap: int, *order: Column) -> DataFrame:
    """The first `cap` rows of each `by` in an order."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rn") <= cap).drop("rn")


def hash_capped(df: DataFrame, by: str, cap: int, kmer: str = "kmer") -> DataFrame:
    """A reproducible sample of each `by`: the k-mers with the smallest MD5 (T5)."""
    return capped(df, by, cap, F.md5(F.col(kmer).cast("string")), F.col(kmer))


def confined(inc: DataFrame, block_inc: DataFrame) -> DataFrame:
    """K-mers of partial blocks found in at least two strains, all of them in the block (A7). block_inc: block, strain, kmer."""
    total = inc.groupBy("kmer").agg(F.countDistinct("strain").alias("n"))
    inside = block_inc.groupBy("block", "kmer").agg(F.countDistinct("strain").alias("m"))
    return inside.join(total, "kmer").where((F.col("n") == F.col("m")) & (F.col("n") >= 2)).select("block", "kmer", F.col("n").alias("n_strains"))


def discriminating(inc: DataFrame, n_strains: int) -> DataFrame:
    """K-mers of at least two strains but not of all."""
    return inc.groupBy("kmer").agg(F.countDistinct("strain").alias("n_strains")).where((F.col("n_strains") > 1) & (F.col("n_strains") < n_strains))


def block_kinds(blocks: DataFrame, n_strains: int | Column, share: float = 1.0, by: str | None = None) -> DataFrame:
    """global or partial for each block; of the partial ones, the share with the fewest strains is used (A9). blocks: block, strain
    and (by, and what n_strains names) a group in which blocks compete."""
    all_ = F.max(n_strains if isinstance(n_strains, Column) else F.lit(n_strains))
    n = blocks.groupBy("block", *([by] if by else [])).agg(F.countDistinct("strain").alias("n_strains"), all_.alias("_all"))
    n = n.withColumn("kind", F.when(F.col("n_strains") == F.col("_all"), "global").otherwise("partial"))
    group = [*([by] if by else []), "kind"]
    # few strains are a few values: ranks among blocks of equal size are found apart, so that a kind need not sort in one task
    rank = F.row_number().over(Window.partitionBy(*group, "n_strains").orderBy("block"))
    sizes = n.groupBy(*group, "n_strains").agg(F.count("*").alias("_m"))
    w = Window.partitionBy(*group)
    sizes = sizes.select(*group, "n_strains", (F.sum("_m").over(w.orderBy("n_strains")) - F.col("_m")).alias("_before"), F.sum("_m").over(w).alias("_many"))
    n = n.withColumn("_rank", rank).join(sizes, [*group, "n_strains"])
    rank, many = F.col("_rank") + F.col("_before"), F.col("_many")
    return n.select("block", "n_strains", "kind", ((F.col("kind") == "global") | (rank <= F.floor(share * many))).alias("used"))


def patterns(inc: DataFrame) -> DataFrame:
    """(pattern, n_kmers): how many k-mers occur in exactly that set of strains. Collapses what all strains share."""
    return incidence(inc).groupBy(F.col("strains").alias("pattern")).agg(F.count("*").alias("n_kmers"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """K-mers of either."""
    return a.select("kmer").unionByName(b.select("kmer")).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """K-mers of both."""
    return a.select("kmer").intersect(b.select("kmer"))


def chunked(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """Rows of each `by` dealt to n chunks of equal size, in an order (P13): chunk counts from 1."""
    return df.withColumn("chunk", F.ntile(n).over(Window.partitionBy(by).orderBy(order)).cast("long"))


def total_frequency(inc: DataFrame, by: str = "strain") -> DataFrame:
    """(by, total): counts of all its k-mers."""
    return inc.groupBy(by).agg(F.sum("cnt").alias("total"))


def long_blocks(parts: DataFrame, least: int = 50) -> DataFrame:
    """(block, n, longest): blocks of at least two strains with a part of at least `least` letters (F15). parts: block, strain, length."""
    x = parts.groupBy("block").agg(F.count("*").alias("n"), F.max("length").alias("longest"), F.countDistinct("strain").alias("strains"))
    return x.where((F.col("longest") >= least) & (F.col("strains") >= 2)).drop("strains")


def snp_columns(cells: DataFrame, gaps: float = 0.1, gap: str = "N") -> DataFrame:
    """(col, n): columns of aligned rows with few gaps and more than one base (F16). cells: col, base, a row for each sequence."""
    base = F.col("base")
    x = cells.groupBy("col").agg(F.count("*").alias("n"), F.count_if(base == gap).alias("gaps"), F.countDistinct(F.when(base != gap, base)).alias("kinds"))
    return x.where((F.col("gaps") <= F.floor(gaps * F.col("n"))) & (F.col("kinds") > 1)).select("col", "n")


# ---------------------------------------------------------------- tree
def depths(nodes: DataFrame) -> DataFrame:
    """(id, depth), the root at 0."""
    return closure(nodes).groupBy(F.col("node").alias("id")).agg(F.max("up").cast("long").alias("depth"))


def paths(nodes: DataFrame) -> DataFrame:
    """(id, path): ids from the root down to each node, joined by slashes."""
    steps = F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("o"), F.col("ancestor").cast("string").alias("a"))))
    return closure(nodes).groupBy(F.col("node").alias("id")).agg(F.array_join(F.transform(steps, lambda x: x["a"]), "/").alias("path"))


def closure(nodes: DataFrame) -> DataFrame:
    """(node, ancestor, up): every node with itself and all nodes above it (J9). nodes: id, parent (null at the root).

    Pointers are doubled: after round i all ancestors up to 2^i above are known, so rounds grow with the logarithm of the depth."""
    spark = nodes.sparkSession
    hop, at_hop = staged(nodes.where("parent is not null").select(F.col("id").alias("node"), F.col("parent").alias("ancestor")), "hops")
    known, at = staged(nodes.select(F.col("id").alias("node"), F.col("id").alias("ancestor"), F.lit(0).alias("up")), "closure")
    step = 1
    while not hop.isEmpty():
        mid = hop.withColumnRenamed("ancestor", "mid")
        further = mid.join(known.select(F.col("node").alias("mid"), "ancestor", "up"), "mid").select("node", "ancestor", (F.col("up") + step).alias("up"))
        known, new_at = staged(known.unionByName(further), "closure")
        hop, new_hop = staged(mid.join(hop.select(F.col("node").alias("mid"), "ancestor"), "mid").select("node", "ancestor"), "hops")
        discard(spark, at, at_hop)
        at, at_hop, step = new_at, new_hop, 2 * step
        if step > 1 << 40:
            raise ValueError("a node is above itself")
    return known


def siblings(nodes: DataFrame) -> DataFrame:
    """J10."""
    a, b = nodes.alias("a"), nodes.alias("b")
    return a.join(b, (F.col("a.parent") == F.col("b.parent")) & (F.col("a.id") != F.col("b.id"))).select(F.col("a.id").alias("id"), F.col("b.id").alias("sibling"))


def same_depth(depths: DataFrame) -> DataFrame:
    """Pairs of different nodes at one depth (J11). depths: id, depth."""
    a, b = depths.alias("a"), depths.alias("b")
    return a.join(b, (F.col("a.depth") == F.col("b.depth")) & (F.col("a.id") != F.col("b.id"))).select(F.col("a.id").alias("id"), F.col("b.id").alias("other"))


def union_deeper(sets: DataFrame, depth: int) -> DataFrame:
    """K-mers of all leaves below a depth (U1). sets: leaf, depth, kmer."""
    return sets.where(F.col("depth") > depth).select("kmer").distinct()


def core_intersection(leaf_core: DataFrame, leaves: DataFrame) -> DataFrame:
    """(node, kmer) that are core in every leaf under the node (U2). leaf_core: leaf, kmer; leaves: node, leaf."""
    n = leaves.groupBy("node").agg(F.count("*").alias("n_leaves"))
    have = leaves.join(leaf_core, "leaf").groupBy("node", "kmer").agg(F.countDistinct("leaf").alias("m"))
    return have.join(n, "node").where("m = n_leaves").select("node", "kmer")


def factored(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Node k-mers without those that the parent has already."""
    above = nodes.where("parent is not null").select(F.col("id").alias("node"), "parent").join(sets.select(F.col("node").alias("parent"), "kmer"), "parent").select("node", "kmer")
    return sets.join(above, ["node", "kmer"], "left_anti")


def same_depth_difference(sets: DataFrame, others: DataFrame, depths: DataFrame) -> DataFrame:
    """Node k-mers that no other node of the depth has in any of its leaves (U4). others: node, kmer of all kinds.

    As one aggregate: a k-mer stays if the nodes of the depth that have it are that node alone."""
    at = others.join(depths.select(F.col("id").alias("node"), "depth"), "node").groupBy("depth", "kmer").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
    own = sets.join(depths.select(F.col("id").alias("node"), "depth"), "node")
    return own.join(at, ["depth", "kmer"]).where("lo = hi and lo = node").select("node", "kmer")


def node_sets(cluster_kmer: DataFrame, leaves: DataFrame) -> DataFrame:
    """K-mers of every node in closed form (C7): those whose clusters are exactly the node's leaves, and core in all of them.

    One aggregate and one equi-join on the set of leaves replace the bottom-up walk. A set is known by its size and the exclusive or of
    two hashes of its members, so no list of clusters is built for a k-mer."""
    known = lambda c: [F.count("*").alias("f"), F.bit_xor(F.xxhash64(F.col(c).cast("long"))).alias("p"), F.bit_xor(F.xxhash64(F.col(c).cast("long"), F.lit(1))).alias("q")]
    one = cluster_kmer.groupBy("kmer", "cluster").agg(F.min("is_core").alias("is_core"))
    occ = one.groupBy("kmer").agg(*known("cluster"), F.min("is_core").alias("all_core"))
    of = leaves.select("node", "leaf").distinct().groupBy("node").agg(*known("leaf"))
    # of a chain of nodes with the same leaves the deepest has the k-mers
    of = of.groupBy("f", "p", "q").agg(F.max("node").alias("node"))
    return occ.where("all_core").join(of, ["f", "p", "q"]).select("node", "kmer")


def rebuilt_sets(leaf_sets: DataFrame, leaf_core: DataFrame, leaves: DataFrame, depths: DataFrame, short: DataFrame, maxk: int) -> DataFrame:
    """New k-mers (node, kmer, n_overlap) for nodes with too few (C8): core of all leaves, in no leaf of another node of the depth;
    of more than maxk, those shared with the fewest shallower leaves stay (T6). short: node."""
    sets = core_intersection(leaf_core, leaves.join(short, "node"))
    everything = leaves.join(leaf_sets, "leaf").select("node", "kmer").distinct()
    x = same_depth_difference(sets, everything, depths)
    d = depths.select(F.col("id").alias("node"), "depth")
    shallow = leaf_sets.join(depths.select(F.col("id").alias("leaf"), F.col("depth").alias("leaf_depth")), "leaf")
    n = x.join(d, "node").join(shallow, "kmer").where("leaf_depth < depth").groupBy("node", "kmer").agg(F.countDistinct("leaf").alias("n_overlap"))
    out = x.join(n, ["node", "kmer"], "left").select("node", "kmer", F.coalesce("n_overlap", F.lit(0)).cast("long").alias("n_overlap"))
    return capped(out, "node", maxk, F.col("n_overlap"), F.col("kmer"))
