"""The corpus pipeline: quality rules, line dedup, near-duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes each result as Parquet to the shared folder
and reads it again, and deletes what the stage wrote on its way. All but the last stage return the columns of documents. Quality rules also change texts. Line dedup drops documents
that lose all they said: each of their lines stands in an earlier document or line, or nearly stands there (one word edit from 8 words on, else one
character from 20 characters on).
Decontamination drops documents in which windows of two items or more occur, cuts the words of the windows of one item out, and keeps
the document, even if it becomes empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm import decontam, line_dedup, minhash, packing, quality
from scriptorium.llm.common import ship, stored
from scriptorium.session import scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs, drop_emptied=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return minhash.drop_near_duplicates(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("line dedup", lines), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("packing", pack)]
#: Near-duplicates, decontamination by windows and tokens are beyond SQL; tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark):
            docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
    return docs
