"""What a sample's k-mer counts say about nodes and strains.

Tables: index(kmer, ...), counts(kmer, cnt), node_kmer(node, kmer), l2(strain, kmer, cnt) with cnt 0 where the sample has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import without_singletons
from ..runtime import stage


def read_counts(kmers: DataFrame) -> DataFrame:
    return kmers.groupBy("kmer").agg(F.count("*").alias("cnt"))


def probe(index: DataFrame, counts: DataFrame) -> DataFrame:
    """index with the sample's counts, 0 where it has none (J1). A small index is broadcast by the optimiser, which then
    filters the reads before their shuffle."""
    return index.join(counts, "kmer", "left").withColumn("cnt", F.coalesce("cnt", F.lit(0).cast("long")))


def matched(node_kmer: DataFrame, counts: DataFrame) -> DataFrame:
    """Node k-mers that the sample has."""
    return node_kmer.join(counts.where("cnt > 0"), "kmer", "left_semi")


def exclusive(own: DataFrame, others: DataFrame) -> DataFrame:
    """J3."""
    return own.join(others.select("kmer").distinct(), "kmer", "left_anti")


def without_outliers(df: DataFrame, by: str, value: str, factor: float = 100.0) -> DataFrame:
    """Rows below factor times the median of their group (F8)."""
    med = df.groupBy(by).agg(F.expr(f"median({value})").alias("med"))
    return df.join(med, by).where(F.col(value) < factor * F.col("med")).drop("med")


def without_global_outliers(df: DataFrame, value: str, factor: float = 1000.0) -> DataFrame:
    """Rows not above factor times the median of the positive values (F9); the one-row median is broadcast."""
    med = df.where(F.col(value) > 0).agg(F.expr(f"median({value})").alias("med"))
    return df.join(F.broadcast(med), F.col(value) <= factor * F.col("med")).drop("med")


def within_sigma(df: DataFrame, by: str, value: str, n: float = 3.0) -> DataFrame:
    """F12."""
    s = df.groupBy(by).agg(F.avg(value).alias("mu"), F.stddev_pop(value).alias("sd"))
    return df.join(s, by).where(F.abs(F.col(value) - F.col("mu")) <= n * F.col("sd")).drop("mu", "sd")


def node_metrics(node_kmer: DataFrame, counts: DataFrame, factor: float = 100.0) -> DataFrame:
    """(node, length, covered, cov, ab) of all nodes in one pass (A10, A11): covered k-mers and mean depth without outliers."""
    x = probe(node_kmer, counts)
    med = x.where("cnt > 0").groupBy("node").agg(F.expr("median(cnt)").alias("med"))
    x = x.join(med, "node", "left")
    good = (F.col("cnt") > 0) & (F.col("cnt") < factor * F.col("med"))
    out = x.groupBy("node").agg(F.count("*").alias("length"), F.count_if(good).alias("covered"), F.avg(F.when(good, F.col("cnt"))).alias("ab"))
    return out.select("node", "length", "covered", (F.col("covered") / F.col("length")).alias("cov"), F.coalesce("ab", F.lit(0.0)).alias("ab"))


def sample_metrics(node_kmer: DataFrame, counts: DataFrame, factor: float = 100.0) -> DataFrame:
    """(sample, node, covered, mean) of every node of which a sample has k-mers (A10, A11): k-mers found and their mean count, without
    outliers. counts: sample, kmer, cnt.

    A k-mer meets the list of its nodes, and the rows of a sample lie together before the lists are opened, so that only rows of counts are
    moved; a median is that of how often each count occurs. Samples of more than MOST_KMERS k-mers are few and each has more rows than nodes
    and counts: theirs are counted in all tasks, and only how often each count occurs is moved."""
    c = stage(counts.where("cnt > 0").select("sample", "kmer", "cnt"), "counts")
    large = c.groupBy("sample").agg(F.count("*").alias("n")).where(F.col("n") > MOST_KMERS).select("sample")
    large, of = stage(large, "large"), node_kmer.groupBy("kmer").agg(F.collect_list("node").alias("nodes"))
    met = of.join(c, "kmer").select("sample", "cnt", "nodes")
    some = large.isEmpty()
    small = met if some else met.join(F.broadcast(large), "sample", "left_anti")
    out = _metrics(small.repartition("sample"), factor)
    return out if some else out.unionByName(_metrics(met.join(F.broadcast(large), "sample", "left_semi"), factor))


#: K-mers of a sample from which on it is spread over tasks.
MOST_KMERS = 1 << 20


def _metrics(met: DataFrame, factor: float) -> DataFrame:
    h = met.select("sample", "cnt", F.explode("nodes").alias("node")).groupBy("sample", "node", "cnt").agg(F.count("*").alias("m"))
    w = Window.partitionBy("sample", "node")
    h = h.withColumn("upto", F.sum("m").over(w.orderBy("cnt"))).withColumn("all", F.sum("m").over(w))
    # the middle count, or the mean of the two in the middle
    at = lambda i: F.min(F.when(F.col("upto") >= i, F.col("cnt"))).over(w)
    h = h.withColumn("med", (at(F.floor((F.col("all") + 1) / 2)) + at(F.floor(F.col("all") / 2) + 1)) / 2)
    h = h.where(F.col("cnt") < factor * F.col("med"))
    return h.groupBy("sample", "node").agg(F.sum("m").alias("covered"), (F.sum(F.col("cnt") * F.col("m")) / F.sum("m")).alias("mean"))


def path_weighted(metrics: DataFrame, paths: DataFrame) -> DataFrame:
    """(leaf, w_ab, w_cov) over each leaf's path (A12). paths: leaf, node; metrics: node, length, cov, ab."""
    w = F.col("cov") * F.col("length")
    x = paths.join(metrics, "node").groupBy("leaf").agg(F.sum(F.col("ab") * w).alias("s"), F.sum(w).alias("c"), F.sum("length").alias("n"))
    return x.select("leaf", F.when(F.col("c") > 0, F.col("s") / F.col("c")).otherwise(F.lit(0.0)).alias("w_ab"), (F.col("c") / F.col("n")).alias("w_cov"))


def accepted(weighted: DataFrame, cutoff: float) -> DataFrame:
    """M6."""
    return weighted.where((F.col("w_cov") >= cutoff) & (F.col("w_ab") > 1))


def share(value: Column, *by: str) -> Column:
    """Share of a value within its group."""
    return value / F.sum(value).over(Window.partitionBy(*by))


def shares(df: DataFrame, value: str, name: str) -> DataFrame:
    """df with the share of a value in the sum of all rows (A13): one aggregate and a row that is broadcast, no window of one task."""
    return df.join(F.broadcast(df.agg(F.sum(value).alias("_whole")))).withColumn(name, F.col(value) / F.col("_whole")).drop("_whole")


def geometric_scores(metrics: DataFrame, paths: DataFrame) -> DataFrame:
    """(leaf, score): geometric mean of the scaled covered shares along the path (A22, M8); a zero on the path makes it zero.
    metrics: node, x; nodes that cannot be judged have null x and don't count."""
    x = paths.join(metrics.where("x is not null"), "node").groupBy("leaf").agg(F.min("x").alias("least"), F.sum(F.ln(F.when(F.col("x") > 0, F.col("x")))).alias("s"), F.count("*").alias("n"))
    return x.select("leaf", F.when(F.col("least") > 0, F.exp(F.col("s") / F.col("n"))).otherwise(F.lit(0.0)).alias("score"))


# ---------------------------------------------------------------- strains of a cluster
def strain_coverage(l2: DataFrame) -> DataFrame:
    """(strain, covered, total, cov) with single counts as none."""
    y = without_singletons(F.col("cnt"))
    x = l2.groupBy("strain").agg(F.count_if(y > 0).alias("covered"), F.count("*").alias("total"))
    return x.select("strain", "covered", "total", (F.col("covered") / F.col("total")).alias("cov"))


def passing(cov: DataFrame, by: str, least: float = 0.7) -> DataFrame:
    """Strains above the coverage floor; all of them where none is."""
    top = F.max("cov").over(Window.partitionBy(by))
    return cov.withColumn("top", top).where(F.when(F.col("top") > least, F.col("cov") > least).otherwise(F.lit(True))).drop("top")


def trimmed_stats(df: DataFrame, by: str | list[str], value: str, lo: float, hi: float, weight: str | None = None) -> DataFrame:
    """(by, p_lo, p_hi, n, total) of the values between two nearest-rank percentiles, both included (F10, F11). weight: how many values a
    row stands for.

    Works on how often each value occurs: ranks are running sums over a group's distinct values, so no group is collected."""
    by = [by] if isinstance(by, str) else by
    h = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg((F.sum(weight) if weight else F.count("*")).alias("m"))
    w = Window.partitionBy(*by)
    h = h.withColumn("upto", F.sum("m").over(w.orderBy("v"))).withColumn("all", F.sum("m").over(w))
    at = lambda q: F.min(F.when(F.col("upto") > F.bround(F.lit(q) * (F.col("all") - 1)), F.col("v"))).over(w)
    h = h.withColumn("p_lo", at(lo)).withColumn("p_hi", at(hi)).where("v between p_lo and p_hi")
    return h.groupBy(*by).agg(F.first("p_lo").alias("p_lo"), F.first("p_hi").alias("p_hi"), F.sum("m").alias("n"), F.sum(F.col("v") * F.col("m")).alias("total"))


def _positive(l2: DataFrame) -> DataFrame:
    y = without_singletons(F.col("cnt"))
    return l2.select("strain", F.when(y > 0, y).alias("y"))


def dominance(l2: DataFrame, lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    """(strain, score): sum of counts without those outside two percentiles of the strain's positive counts."""
    return trimmed_stats(_positive(l2), "strain", "y", lo, hi).select("strain", F.col("total").alias("score"))


def unexplained(l2: DataFrame, used: DataFrame) -> DataFrame:
    """(strain, n): covered k-mers outside the used set (A16); 0 where all are used."""
    u = used.select("kmer").distinct().withColumn("hit", F.lit(True))
    y = without_singletons(F.col("cnt"))
    return l2.join(u, "kmer", "left").groupBy("strain").agg(F.count_if((y > 0) & F.col("hit").isNull()).alias("n"))


def remaining_coverage(l2: DataFrame, dominant: DataFrame) -> DataFrame:
    """(strain, remain): coverage of each strain's k-mers that the dominant strain lacks."""
    rest = l2.join(dominant.select("kmer").distinct(), "kmer", "left_anti")
    y = without_singletons(F.col("cnt"))
    return rest.groupBy("strain").agg((F.count_if(y > 0) / F.count("*")).alias("remain"))


def average_depth(l2: DataFrame) -> DataFrame:
    """(strain, depth): mean of the middle half of the positive counts."""
    return trimmed_stats(_positive(l2), "strain", "y", 0.25, 0.75).select("strain", (F.col("total") / F.col("n")).alias("depth"))


def exclusive_counts(counts: DataFrame, cluster_kmer: DataFrame, detected: DataFrame) -> DataFrame:
    """(kmer, cnt): counts of k-mers of exactly one detected cluster, others 0 (A19); by sample where detected has samples."""
    by = ["sample", "kmer"] if "sample" in detected.columns else ["kmer"]
    n = cluster_kmer.join(detected.distinct(), "cluster").groupBy(*by).agg(F.countDistinct("cluster").alias("n"))
    return counts.join(n, by).select(*by, F.when(F.col("n") == 1, F.col("cnt")).otherwise(F.lit(0).cast("long")).alias("cnt"))
