"""What runs need from the session: the package on the executors, and a folder that all of them share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_own_root: list[str] = []


def ship(spark: SparkSession) -> None:
    """Once for each application: the package as a zip that Spark serves from the driver."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(), "seqlake.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, with the scheme of Hadoop's default store if it names none.

    Unset, a local session gets a folder of our own; a cluster has none that is shared, so it must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own_root:
            _own_root.append("file://" + tempfile.mkdtemp(prefix="seqlake-"))
        root = _own_root[0]
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", root):
        return root.rstrip("/")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    at = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + at[5:] if re.match(r"file:/(?!/)", at) else at


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """(df written to the shared folder and read back, its path): cuts lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stage(df: DataFrame, name: str) -> DataFrame:
    return staged(df, name)[0]


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete folders of the shared store that no result needs any more."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext._jsc
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc.hadoopConfiguration()).delete(p, True)


def spread_out(df: DataFrame) -> DataFrame:
    """df over all cores where it is read in fewer pieces than there are cores: a table of so few splits is small to move."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
