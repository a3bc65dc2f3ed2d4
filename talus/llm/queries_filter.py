"""Queries: toxicity scores and exact duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from talus.llm import exact_dedup, toxicity
from talus.llm.common import table
from talus.llm.registry import query


@query()
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    out = toxicity.held_out(F.col("doc_id"))
    model = toxicity.fit(toxicity.labelled_sample(docs, labels, ~out))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


NORMAL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(sql=f"""
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = max(doc_id) OVER g AS kept, sha256({NORMAL}) AS text_sha256
    FROM documents WINDOW g AS (PARTITION BY {NORMAL})""")
def op8_radix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, folder, "documents"))
