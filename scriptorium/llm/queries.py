"""The operN queries: each applies one operator to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, line_dedup, minhash, packing, pii, quality, substring, toxicity, warc
from .common import shared_dir, ship
from .oracles import ORACLES


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup.op1(_t(spark, sf, "documents"))


def op2_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality.op2(_t(spark, sf, "documents"))


def op3_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.op3(_t(spark, sf, "documents"))


def op4_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.op4(_t(spark, sf, "documents"), _t(spark, sf, "labels"))


def op5_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.op5(_t(spark, sf, "documents"))


def op6_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontam.op6(_t(spark, sf, "documents"), _t(spark, sf, "benchmark"))


def op7_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.op7(spark, _t(spark, sf, "pages"), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")


def op8_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.op8(_t(spark, sf, "documents"))


def op9_chat(spark: SparkSession, sf: str) -> DataFrame:
    return chat.op9(_t(spark, sf, "conversations"))


def op10_substring(spark: SparkSession, sf: str) -> DataFrame:
    return substring.op10(_t(spark, sf, "documents"))


__all__ = ["ORACLES", "QUERIES"]
QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_quality_rules, op3_packing, op4_toxicity, op5_minhash, op6_decontamination, op7_warc, op8_pii, op9_chat, op10_substring)}
