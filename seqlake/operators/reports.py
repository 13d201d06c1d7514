"""Report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import exist_evidence


# Fixed value: what the extra-region mode says of a strain without evidence.
EXTRA = " (With_ExtraRegion_covered)"


def ranked(df: DataFrame, by: Column, *ties: str, name: str = "rank") -> DataFrame:
    """1-based rank by falling value (T1). Reports are small: one row a strain found."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*_samples(df)).orderBy(by.desc(), *ties)).cast("long"))


def _samples(df: DataFrame) -> list[str]:
    """The column that reports of several samples are told apart by."""
    return ["sample"] if "sample" in df.columns else []


def strain_report(found: DataFrame, cluster_ab: DataFrame, extra: bool = False) -> DataFrame:
    """Per-cluster report (K1, M12): found as of dominance.detect; cluster_ab: cluster, cls_ab. extra: strains without evidence are
    said to be there with regions beyond their reference only (M14)."""
    of = _samples(found)
    x = found.join(cluster_ab, [*of, "cluster"]).withColumn("final_depth", F.col("abundance") * F.col("cls_ab"))
    rank = F.row_number().over(Window.partitionBy(*of, "cluster").orderBy(F.desc("abundance"), "strain")).cast("long")
    mark = exist_evidence(F.col("abundance"), F.col("cov"))
    note = [F.when(mark.isNull(), F.lit(EXTRA)).otherwise(F.lit("")).alias("note")] if extra else []
    return x.select(*of, rank.alias("strain_rank"), "cluster", "strain", "abundance", F.col("depth").alias("model_depth"), "final_depth", "cov", "covered", "total", "valid", "remain", mark.alias("exist_evidence"), *note)


def merged_report(singles: DataFrame, strains: DataFrame) -> DataFrame:
    """All clusters' strains by relative abundance (K2): singles: cluster, strain, depth; strains: cluster, strain, model_depth,
    final_depth. A cluster that reports one strain counts with its model depth. Columns cov, covered, total are kept where both have them."""
    of = _samples(strains)
    n = F.count("*").over(Window.partitionBy(*of, "cluster"))
    more = [c for c in ("cov", "covered", "total") if c in singles.columns and c in strains.columns]
    x = strains.select(*of, "cluster", "strain", F.when(n == 1, F.col("model_depth")).otherwise(F.col("final_depth")).alias("depth"), *more)
    x = singles.select(*of, "cluster", "strain", "depth", *more).unionByName(x)
    if of:
        return ranked(x.withColumn("relative_abundance", F.col("depth") / F.sum("depth").over(Window.partitionBy(*of))), F.col("relative_abundance"), "strain", name="id")
    whole = x.agg(F.sum("depth").alias("whole"))
    x = x.join(F.broadcast(whole)).withColumn("relative_abundance", F.col("depth") / F.col("whole")).drop("whole")
    return ranked(x, F.col("relative_abundance"), "strain", name="id")


def single_report(found: DataFrame) -> DataFrame:
    """Clusters of one strain (K3): cluster, strain, depth, cov."""
    return ranked(found, F.col("depth"), "strain", name="strain_rank")


def probability_report(scores: DataFrame, cluster: DataFrame) -> DataFrame:
    """(cluster, probability, n_strains, strains), likeliest first (K4)."""
    m = cluster.groupBy("cluster").agg(F.count("*").alias("n_strains"), F.array_join(F.transform(F.sort_array(F.collect_list("strain")), lambda x: x.cast("string")), ",").alias("strains"))
    return scores.join(m, "cluster").select("cluster", "probability", "n_strains", "strains")
