"""The training-set build as one plan: scores and manifest to shards, splits and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from talus.functions import text as X
from talus.operators import curation
from talus.operators.ordering import pack_batches
from talus.sources.files import SHARD_COLUMNS


def score_order() -> list:
    return [F.col("filter_score").desc(), F.col("route_image_id").asc()]


def training_set(manifest: DataFrame, scores: DataFrame, filter_version: str, threshold: float, shard_size: int) -> DataFrame:
    """Training rows in score order with their position and shard."""
    rows = curation.dataset_rows(manifest, scores, filter_version, threshold)
    return curation.with_shard(rows, score_order(), shard_size, "route_image_id", "filter_score")


def shard_rows(manifest: DataFrame, scores: DataFrame, photos: DataFrame, filter_version: str, threshold: float, shard_size: int) -> tuple[DataFrame, DataFrame]:
    """(rows, counters): training rows with the bytes of their photo, as `files.write_named_shards` takes them, and one row
    (written, skipped).

    `photos` has name (unique) and content; a row's photo is the last segment of its url. Rows whose photo is missing or
    empty are skipped, and the others are numbered without gaps. The numbering sees names only; bytes are joined last."""
    rows = curation.dataset_rows(manifest, scores, filter_version, threshold).withColumn("_name", X.last_segment(F.col("image_url")))
    there = photos.where(F.length("content") > 0).select(F.col("name").alias("_name"), F.lit(True).alias("_there"))
    flagged = rows.join(there, "_name", "left")
    found = flagged.where("_there").drop("_there")
    numbered = curation.with_shard(found, score_order(), shard_size, "route_image_id", "filter_score")
    image = F.struct(F.col("content").cast("binary").alias("bytes"), F.lit(None).cast("string").alias("path"))
    full = numbered.join(photos.select(F.col("name").alias("_name"), "content"), "_name").withColumn("image", image)
    typed = [F.col(name).cast(kind) for name, kind in SHARD_COLUMNS.items()]
    counters = flagged.agg(F.count_if("_there").alias("written"), F.count_if(F.col("_there").isNull()).alias("skipped"))
    return full.select(*typed, "idx", "shard"), counters


def training_batches(rows: DataFrame, epochs: int, max_batch_size: int, local: bool, seed: int = 42) -> DataFrame:
    """Route batches per epoch: routes in random order, or in area order with routes shuffled inside an area."""
    orders = curation.epoch_orders(curation.route_groups(rows), epochs, seed)
    return pack_batches(orders, "n", curation.LOCAL_ORDER if local else curation.RANDOM_ORDER, max_batch_size)
