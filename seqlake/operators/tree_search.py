"""Search of a cluster tree for the clusters that samples hold (M1-M7, T9, T10), all samples at once, level by level.

node: id, parent (null at the root), is_leaf, category, length; a binary tree. metrics: sample, node, covered (k-mers found, without
outliers), mean (of their counts); rows only where something was found. The frontier holds (sample, node) pairs whose children are
asked next; a level is one join with the tree, one with the metrics, and windows over two siblings. A node's unique path (C11) is not
walked: the frontier carries its sums, as whether a sibling was reached is settled when its level ends. Leaves accepted on one level
correct the rebuilt nodes of deeper ones, not each other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.stats import keep_both, piecewise
from ..runtime import discard, scratch, staged
from .kmer_sets import closure


@dataclass(frozen=True)
class Preset:
    """Cutoffs of coverage, of a path's coverage and of abundance."""

    cov: float
    path_cov: float
    ab: float


#: Depth presets; a level is tried again with looser cutoffs if it finds nothing (M7).
PRESETS = {0: (Preset(0.1, 0.4, 1), Preset(0.05, 0.05, 1)), 1: (Preset(0.01, 0.05, 1),), 2: (Preset(0.005, 0.01, 1),)}
#: Stands for the parent of the root.
TOP = -(1 << 63)
#: Coverage from which on a node vouches for what is below it (T10), and that the best rejected leaf must have.
QUALIFIED, REJECTED = 0.95, 0.1
#: K-mers of a path below which it says nothing of what is under it (M5).
LEAST_PATH = 1000

#: (nodes to correct: sample, node; accepted: sample, leaf, ab, path_ab) -> sample, node, category, length, covered, mean
Correct = Callable[[DataFrame, DataFrame], DataFrame]
SUMS = ("s_ab", "s_cov", "s_len")  # of a path: abundance by covered k-mers, covered k-mers, k-mers


def _other(*columns: str) -> Column:
    """Columns of the sibling, null where there is none."""
    w = Window.partitionBy("sample", "parent").orderBy("node")
    x = F.struct(*columns)
    return F.coalesce(F.lead(x).over(w), F.lag(x).over(w))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def evaluated(x: DataFrame, preset: Preset) -> DataFrame:
    """x: frontier rows with category, length, covered, mean and fixed (was corrected: the category before). Adds cov, ab, kind."""
    weak = F.col("category") == "0"
    x = x.withColumn("length", F.when(weak, F.lit(0)).otherwise(F.col("length")).cast("long"))
    x = x.withColumn("cov", F.when(F.col("length") > 0, F.col("covered") / F.col("length")).otherwise(F.lit(0.0)))
    ab = piecewise(F.col("cov"), F.coalesce("fixed", "category"), F.col("mean"), preset.cov)
    ab = F.when(weak | (F.col("length") == 0) | (ab < preset.ab), F.lit(0.0)).otherwise(ab)
    x = x.withColumn("category", F.when(F.col("fixed").isNull() & F.startswith("category", F.lit("o")), F.substring("category", 2, 1)).otherwise(F.col("category")))
    return x.withColumn("ab", ab).withColumn("kind", F.when(F.col("length") > 0, F.col("category")).otherwise(F.lit("0")))


def shared_out(x: DataFrame, preset: Preset) -> DataFrame:
    """Abundances of siblings one of which was corrected, from their parent's path (M5)."""
    x = x.withColumn("o", _other("ab", "kind", "category", "fixed", "node"))
    k, o, above = F.col("kind"), F.col("o.kind"), _ratio(F.col("s_ab"), F.col("s_cov"))
    told = F.col("o").isNotNull() & (F.coalesce("fixed", "o.fixed")).isNotNull() & (F.col("category") != "0") & (F.col("o.category") != "0")
    told = told & (F.col("s_len") >= LEAST_PATH) & (above > preset.ab)
    alike = (k == o) & k.isin("o1", "o2")
    mixed = (k == "0") | (o == "0") | F.concat(F.least(k, o), F.greatest(k, o)).isin("o1o2", "2o1", "2o2")
    # the first of two is the one to be told if it may be; the second if the first may not
    may = lambda a, b: a.isin("0", "o1") | (b == "2")
    low = F.when(F.col("node") < F.col("o.node"), may(k, o)).otherwise(~may(o, k))
    whole = F.col("ab") + F.col("o.ab")
    ab = F.when(told & alike & (whole > 0), above * F.col("ab") / whole).when(told & ~alike & mixed & low, F.greatest(above - F.col("o.ab"), F.lit(0.0))).otherwise(F.col("ab"))
    return x.withColumn("ab", ab).drop("o")


def decided(x: DataFrame, preset: Preset) -> DataFrame:
    """Adds kept, leaf results (accepted, path_ab, path_cov), reached, pushed, rank among the pushed, and the sums of the node's path."""
    x = x.withColumn("r", F.bround("ab").cast("long")).withColumn("o", _other("r", "node"))
    r, o = F.col("r"), F.col("o.r")
    ahead = o.isNull() | (r > o) | ((r == o) & (F.col("node") > F.col("o.node")))
    x = x.withColumn("ahead", ahead).withColumn("kept", (r > 0) & (F.col("category") != "0") & (F.col("ahead") | F.coalesce(keep_both(r, o), F.lit(False))))
    x = x.withColumn("reached", F.col("kept") | (F.col("category") == "0")).withColumn("judged", F.col("kept") & F.col("is_leaf")).drop("o")
    covered = F.col("cov") * F.col("length")
    own = dict(zip(SUMS, (F.col("ab") * covered, covered, F.col("length").cast("double")), strict=True))

    def tested(alone: Column) -> tuple[Column, Column, Column]:
        a, c, n = (own[s] + F.when(alone, F.lit(0.0)).otherwise(F.col(s)) for s in SUMS)
        ab, cov = _ratio(a, c), _ratio(c, n)
        return ab, cov, F.col("judged") & (cov >= preset.path_cov) & (ab > 1)

    # the one ahead is judged first; if it is rejected, the other's path goes on upwards
    x = x.withColumn("o", _other("reached")).withColumn("good", tested(F.coalesce("o.reached", F.lit(False)))[2])
    x = x.withColumn("o", _other("reached", "judged", "good"))
    there = F.coalesce("o.reached", F.lit(False))
    alone = F.when(F.col("ahead"), there).otherwise(there & ~(F.col("o.judged") & ~F.col("o.good")))
    ab, cov, good = tested(alone)
    x = x.withColumn("path_ab", ab).withColumn("path_cov", cov).withColumn("accepted", good)
    x = x.withColumn("reached", F.col("reached") & (~F.col("judged") | F.col("accepted"))).withColumn("o", _other("reached"))
    there = F.coalesce("o.reached", F.lit(False))
    for s in SUMS:
        x = x.withColumn(f"n_{s}", own[s] + F.when(there, F.lit(0.0)).otherwise(F.col(s)))
    early = (F.col("category") == "0") | (F.col("length") == 0)
    x = x.withColumn("pushed", ~F.col("is_leaf") & (F.col("kept") | early))
    second = F.when(early, F.coalesce(F.col("node") > _other("node")["node"], F.lit(False))).otherwise(~F.col("ahead"))
    x = x.withColumn("at", F.concat("at", (F.when(early, F.lit(0)).otherwise(F.lit(2)) + second.cast("int")).cast("string")))
    return x.withColumn("qualified", (F.col("parent") != TOP) & (F.col("cov") >= QUALIFIED)).drop("o", "r", "good", "ahead")


KEPT = ("sample", "parent", "node", "at", "is_leaf", "category", "length", "cov", "ab", "kept", "judged", "accepted", "path_ab", "path_cov", "qualified", "pushed", *(f"n_{s}" for s in SUMS))


def walk(node: DataFrame, metrics: DataFrame, preset: Preset, correct: Correct | None = None) -> DataFrame:
    """Every (sample, node) that the search asks, with what it decides there (KEPT). Written level by level."""
    spark = node.sparkSession
    tree, at_tree = staged(node.select(F.col("id").alias("node"), F.coalesce("parent", F.lit(TOP)).alias("parent"), "is_leaf", "category", "length"), "tree")
    found, at_found = staged(metrics.select("sample", "node", F.col("covered").cast("double"), "mean"), "metrics")
    zero = [F.lit(0.0).alias(s) for s in SUMS]
    front = found.select("sample").distinct().select("sample", F.lit(TOP).alias("parent"), F.lit("").alias("at"), *zero)
    base, depth, out = scratch(spark, "walk"), 0, None  # levels are folders of one table
    while True:
        x = front.join(tree, "parent").join(found, ["sample", "node"], "left")
        x = x.withColumn("covered", F.coalesce("covered", F.lit(0.0))).withColumn("mean", F.coalesce("mean", F.lit(0.0)))
        x = x.withColumn("fixed", F.lit(None).cast("string"))
        leaves = out.where("accepted").select("sample", F.col("node").alias("leaf"), "ab", "path_ab") if out is not None and correct else None
        if leaves is not None and not leaves.isEmpty():
            todo = x.where(F.startswith("category", F.lit("o"))).select("sample", "node").join(leaves.select("sample").distinct(), "sample", "left_semi")
            new = correct(todo, leaves).select("sample", "node", F.struct("category", "length", F.col("covered").cast("double").alias("covered"), "mean").alias("c"))
            x = x.join(new, ["sample", "node"], "left").withColumn("fixed", F.when(F.col("c").isNotNull(), F.col("category")))
            for c in ("category", "length", "covered", "mean"):
                x = x.withColumn(c, F.when(F.col("c").isNotNull(), F.col(f"c.{c}")).otherwise(F.col(c)))
        x = shared_out(evaluated(x, preset), preset) if leaves is not None else evaluated(x, preset)
        level = decided(x, preset).select(*KEPT)
        level.write.parquet(f"{base}/depth={depth}")
        out = spark.read.schema(StructType([*level.schema.fields, StructField("depth", IntegerType())])).parquet(base)
        level = spark.read.schema(level.schema).parquet(f"{base}/depth={depth}")
        front = level.where("pushed").select("sample", F.col("node").alias("parent"), "at", *(F.col(f"n_{s}").alias(s) for s in SUMS))
        if front.isEmpty():
            discard(spark, at_tree, at_found)
            return out
        depth += 1


def chosen(node: DataFrame, asked: DataFrame, up: DataFrame) -> DataFrame:
    """(sample, leaf, how): accepted leaves; of samples without any the rejected leaf whose path is covered best (T9); else the best
    covered leaf under the last well covered node (T10). up: closure of the tree."""
    yes = asked.where("accepted").select("sample", F.col("node").alias("leaf"), F.lit("accepted").alias("how"))
    no = asked.join(yes.select("sample").distinct(), "sample", "left_anti")
    top = F.max(F.struct("path_cov", (-F.col("node")).alias("o"), "node")).alias("m")
    best = no.where("judged").groupBy("sample").agg(top).where(F.col("m.path_cov") >= REJECTED).select("sample", F.col("m.node").alias("leaf"))
    line = best.join(up.select(F.col("node").alias("leaf"), F.col("ancestor").alias("node")), "leaf").join(no.select("sample", "node", "ab", "cov", "length"), ["sample", "node"])
    covered = F.col("cov") * F.col("length")
    line = line.groupBy("sample", "leaf").agg(F.sum(F.col("ab") * covered).alias("a"), F.sum(covered).alias("c"), F.sum("length").alias("n"))
    best = line.where((_ratio(F.col("c"), F.col("n")) >= REJECTED) & (_ratio(F.col("a"), F.col("c")) > 1)).select("sample", "leaf", F.lit("rejected").alias("how"))
    rest = no.join(best.select("sample"), "sample", "left_anti")
    last = rest.where("qualified").groupBy("sample").agg(F.max(F.struct("depth", F.substring(F.col("at"), F.lit(1), F.length("at") - 1).alias("at"), "node")).alias("m")).select("sample", F.col("m.node").alias("ancestor"))
    under = rest.where("is_leaf").join(up.select("node", "ancestor"), "node").join(last, ["sample", "ancestor"])
    under = under.groupBy("sample").agg(F.max(F.struct("cov", (-F.col("node")).alias("o"), "node")).alias("m")).select("sample", F.col("m.node").alias("leaf"), F.lit("qualified").alias("how"))
    return yes.unionByName(best).unionByName(under)


def unique_paths(node: DataFrame, on: DataFrame, leaves: DataFrame, up: DataFrame) -> DataFrame:
    """(sample, leaf, node, up): each leaf and the nodes above it, up to the first whose sibling was reached (C11).

    on: sample, node that were reached; leaves: sample, leaf."""
    line = leaves.join(up.select(F.col("node").alias("leaf"), F.col("ancestor").alias("node"), "up"), "leaf")
    kin = node.select(F.col("id").alias("node"), "parent")
    kin = kin.join(kin.select(F.col("node").alias("sibling"), "parent"), "parent").where("node <> sibling").select("node", "sibling")
    stop = line.join(kin, "node").join(on.select("sample", F.col("node").alias("sibling")).distinct(), ["sample", "sibling"], "left_semi")
    stop = stop.groupBy("sample", "leaf").agg(F.min("up").alias("last"))
    return line.join(stop, ["sample", "leaf"], "left").where(F.col("last").isNull() | (F.col("up") <= F.col("last"))).select("sample", "leaf", "node", "up")


def results(node: DataFrame, asked: DataFrame) -> DataFrame:
    """(sample, cluster, ab, cov, covered, total, share, how) of the chosen leaves, over their unique paths among chosen lines."""
    up = closure(node.select("id", "parent"))
    leaves = staged(chosen(node, asked, up), "chosen")[0]
    on = leaves.join(up.select(F.col("node").alias("leaf"), F.col("ancestor").alias("node")), "leaf").select("sample", "node")
    x = unique_paths(node, on, leaves.select("sample", "leaf"), up).join(asked.select("sample", "node", "ab", "cov", "length"), ["sample", "node"])
    covered = F.col("cov") * F.col("length")
    x = x.groupBy("sample", "leaf").agg(F.sum(F.col("ab") * covered).alias("a"), F.sum(covered).alias("covered"), F.sum("length").alias("total"))
    x = x.join(leaves, ["sample", "leaf"]).select("sample", F.col("leaf").alias("cluster"), _ratio(F.col("a"), F.col("covered")).alias("ab"), _ratio(F.col("covered"), F.col("total")).alias("cov"), "covered", "total", "how")
    whole = F.sum("ab").over(Window.partitionBy("sample"))
    return x.withColumn("share", _ratio(F.col("ab"), whole)).select("sample", "cluster", "ab", "cov", "covered", "total", "share", "how")


def search(node: DataFrame, metrics: DataFrame, presets: tuple[Preset, ...] = PRESETS[0], correct: Correct | None = None) -> DataFrame:
    """What every sample holds; samples in which nothing is found are searched again with the next, looser preset (M7)."""
    out: DataFrame | None = None
    metrics = staged(metrics, "metrics")[0]
    for preset in presets:
        found = staged(results(node, walk(node, metrics, preset, correct)), "found")[0]
        out = found if out is None else out.unionByName(found)
        metrics = metrics.join(found.select("sample").distinct(), "sample", "left_anti")
        if preset is not presets[-1] and metrics.isEmpty():
            break
    return out
