"""The corpus pipeline: quality, near duplicates, recurring passages, personal data, packing.

Each stage takes (spark, documents, sf_dir) and returns a table; all but the last return the columns of documents. A stage works
on all that the one before it kept, which is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqlake.llm import stages
from seqlake.llm.common import stage as written

STAGES = [
    ("quality classifier", stages.keep_quality),
    ("near duplicates", stages.one_of_each),
    ("recurring passages", stages.without_repeats),
    ("personal data", stages.without_pii),
    ("best-fit packing", stages.packed),
]

#: No stage but the last could be said in SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES[:-1]:
        docs = written(f(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
