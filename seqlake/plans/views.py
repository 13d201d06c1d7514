"""The driver's tables in the terms of this domain: genomes from documents, contigs from conversations, incidence from orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import spread_out

# The letters of a text as bases.
LETTERS, BASES_OF = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def bases(text: Column) -> Column:
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), LETTERS, BASES_OF)


def genome(spark: SparkSession, d: str) -> DataFrame:
    return spread_out(table(spark, d, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("strain"), bases(F.coalesce("text", F.lit(""))).alias("seq"))


def contigs(spark: SparkSession, d: str) -> DataFrame:
    return spread_out(table(spark, d, "conversations").select("conv_id", "turn", "text")).select(F.col("conv_id").alias("strain"), F.col("turn").alias("contig"), bases(F.coalesce("text", F.lit(""))).alias("seq"))


def inc(spark: SparkSession, d: str) -> DataFrame:
    """strain = supplier, kmer = part, cnt = quantity."""
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("strain"), F.col("l_partkey").alias("kmer")).agg(F.sum("l_quantity").cast("long").alias("cnt"))


def occurrences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("strain"), F.col("l_partkey").alias("kmer"), F.col("l_quantity").cast("long").alias("q"))


def cluster(spark: SparkSession, d: str) -> DataFrame:
    """strain = supplier, cluster = nation."""
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("strain"), F.col("s_nationkey").cast("long").alias("cluster"))


def region(spark: SparkSession, d: str) -> DataFrame:
    """strain = supplier, cluster = one of five groups of nations."""
    return cluster(spark, d).withColumn("cluster", F.col("cluster") % 5)


def order_inc(spark: SparkSession, d: str) -> DataFrame:
    """strain = supplier, kmer = order: k-mers of one strain or a few."""
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("strain"), F.col("l_orderkey").alias("kmer")).distinct()


def order_kmer(spark: SparkSession, d: str) -> DataFrame:
    """cluster, kmer, mult with orders as k-mers, many of which few nations supply."""
    x = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("strain"), F.col("l_orderkey").alias("kmer"))
    return x.join(cluster(spark, d), "strain").groupBy("cluster", "kmer").agg(F.count("*").alias("mult"))


def cluster_kmer(spark: SparkSession, d: str) -> DataFrame:
    """cluster, kmer, mult."""
    return occurrences(spark, d).join(cluster(spark, d), "strain").groupBy("cluster", "kmer").agg(F.count("*").alias("mult"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Tree over nations: leaf 32 + nation, parent id / 2, root 1."""
    leaf = table(spark, d, "nation").select((F.col("n_nationkey") + 32).cast("long").alias("leaf"))
    x = leaf.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.call_function("shiftright", F.col("leaf"), i))).alias("id")).distinct()
    return x.select("id", F.when(F.col("id") > 1, F.call_function("shiftright", F.col("id"), F.lit(1))).alias("parent"))


def node_counts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(node_kmer: brand, part), (counts: part, quantity returned)."""
    node_kmer = table(spark, d, "part").select(F.col("p_brand").alias("node"), F.col("p_partkey").alias("kmer"))
    counts = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("kmer")).agg(F.sum("l_quantity").cast("long").alias("cnt"))
    return node_kmer, counts


# The same in SQL, for the other engine.
SQL = {
    "genome": f"genome AS (SELECT doc_id AS strain, translate(regexp_replace(lower(coalesce(text,'')),'[^a-z]','','g'),'{LETTERS}','{BASES_OF}') AS seq FROM documents)",
    "contigs": f"contigs AS (SELECT conv_id AS strain, turn AS contig, translate(regexp_replace(lower(coalesce(text,'')),'[^a-z]','','g'),'{LETTERS}','{BASES_OF}') AS seq FROM conversations)",
    "inc": "inc AS (SELECT l_suppkey AS strain, l_partkey AS kmer, CAST(sum(l_quantity) AS BIGINT) AS cnt FROM lineitem GROUP BY ALL)",
    "cl": "cl AS (SELECT s_suppkey AS strain, CAST(s_nationkey AS BIGINT) AS cluster FROM supplier)",
    "rg": "cl AS (SELECT s_suppkey AS strain, CAST(s_nationkey % 5 AS BIGINT) AS cluster FROM supplier)",
    "ck": "ck AS (SELECT CAST(s_nationkey AS BIGINT) AS cluster, l_partkey AS kmer, count(*) AS mult FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)",
    "oi": "oi AS (SELECT DISTINCT l_suppkey AS strain, l_orderkey AS kmer FROM lineitem)",
    "ok": "ck AS (SELECT CAST(s_nationkey AS BIGINT) AS cluster, l_orderkey AS kmer, count(*) AS mult FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)",
    "nodes": "nodes AS (SELECT DISTINCT (n_nationkey + 32)::BIGINT >> i AS id FROM nation, range(0, 6) t(i))",
    "leaves": "leaves AS (SELECT DISTINCT ((n_nationkey + 32)::BIGINT >> i) AS node, n_nationkey::BIGINT AS leaf FROM nation, range(0, 6) t(i))",
    "nk": "nk AS (SELECT p_brand AS node, p_partkey AS kmer FROM part)",
    "cnts": "cnts AS (SELECT l_partkey AS kmer, CAST(sum(l_quantity) AS BIGINT) AS cnt FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)",
}


def sql(names: str, body: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names.split()) + (", " if body.startswith("+") else " ") + body.removeprefix("+")
