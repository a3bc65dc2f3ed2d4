"""Queries: token files, packing, byte-level BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from talus.llm import byte_bpe, packing, token_files, tokens
from talus.llm.common import table
from talus.llm.registry import query


@query()
def op5_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.token_report(table(spark, folder, "documents"), tokens.vocabulary())


@query()
def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed_pieces(table(spark, folder, "documents"), tokens.vocabulary())


@query()
def op7_bpe_tree(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.round_trip(table(spark, folder, "documents"), byte_bpe.rank_file(), public_tokenizers.PATTERN)
