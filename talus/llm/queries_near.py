"""Queries: near duplicates and fingerprints of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from talus.llm import simhash, suffix_dedup, winnowing
from talus.llm.common import table
from talus.llm.registry import query


@query()
def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_groups(table(spark, folder, "documents"))


@query()
def op10_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    return winnowing.edited_report(table(spark, folder, "documents"))


@query()
def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.repeats(table(spark, folder, "documents"))
