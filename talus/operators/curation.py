"""Training-set curation: multi-view tables, labels, manifests, shards and leak-free splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from talus.functions import text as X
from talus.operators import hierarchy
from talus.operators.knn import with_partner
from talus.operators.ordering import global_rank, running_before
from talus.operators.rows import first_by_hash, last_per_key, with_group_minimum
from talus.operators.sampling import order_key
from talus.session import cut

# Text columns of a training shard that are written as '' when empty.
SHARD_TEXT = ["route_name", "grade", "type", "description", "location", "gps"]


def multiview(photos: DataFrame) -> DataFrame:
    """Photos (url, route_name, route_lineage, ...) of labels 'lineage|name' with more than one photo, with
    `str_label` and its integer `label`."""
    labelled = photos.withColumn("str_label", X.label_key(F.col("route_lineage"), F.col("route_name")))
    return with_label(with_group_minimum(labelled, "str_label", 2), "str_label")


def multiview_from_lists(routes: DataFrame) -> DataFrame:
    """The same from one row per route with an `images` array: lists longer than one are exploded."""
    many = routes.where(F.size("images") > 1)
    rows = many.select("route_name", "route_lineage", F.explode("images").alias("url"))
    return with_label(rows.withColumn("str_label", X.label_key(F.col("route_lineage"), F.col("route_name"))), "str_label")


def with_label(df: DataFrame, key: str, name: str = "label") -> DataFrame:
    """Rank of the key among the sorted distinct keys, from 0."""
    ranks = global_rank(df.select(key).distinct(), [key], name=name).withColumn(name, F.col(name) - 1)
    return df.join(ranks, key)


def last_metadata(photos: DataFrame, metadata: DataFrame, url: str, position: str) -> DataFrame:
    """Photos joined to their url's metadata; of several metadata rows the last one counts."""
    return photos.join(last_per_key(metadata, [url], F.col(position)).drop(position), url)


def mine_pairs(photos: DataFrame, label: str, id: str, vector: str, digest: str, position: str,
               threshold: float = 0.5, seen: DataFrame | None = None, **options) -> DataFrame:
    """Content dedup, then only photos with a similar partner inside their label."""
    return with_partner(cut(first_by_hash(photos, digest, position, seen)), label, id, vector, threshold, **options)


def batch_of_rows(df: DataFrame, order: list, size: int, name: str = "batch", first: int = 0) -> DataFrame:
    """Batch number over ordered rows, `size` rows each."""
    ranked = global_rank(df, order, name="_r")
    return ranked.withColumn(name, F.expr(f"(_r - 1) div {int(size)} + {int(first)}")).drop("_r")


def batch_of_groups(df: DataFrame, group: str, size: int, name: str = "batch", first: int = 1) -> DataFrame:
    """Batch number over the sorted distinct groups, `size` whole groups each."""
    ranks = with_label(df.select(group).distinct(), group, "_g")
    numbered = ranks.select(group, F.expr(f"_g div {int(size)} + {int(first)}").alias(name))
    return df.join(numbered, group)


def mining_batch_size(batch_size: int) -> int:
    """Routes per mining batch for an image batch size."""
    return max(1, int(batch_size / 2.5))


def in_manifest_order(rows: DataFrame, order: list) -> DataFrame:
    """The rows with their `position`, from 1, in the order in which a manifest lists them."""
    return global_rank(rows, order, name="position")


# The order of the two manifests; the last key breaks ties.
FULL_ORDER = ["area_id", "route_id", "route_image_id"]
FIELD_ORDER = ["route_id", "created_at", "image_id"]


def field_manifest(images: DataFrame, routes: DataFrame) -> DataFrame:
    return (
        images.where((F.col("status") == "approved") & F.col("route_id").isNotNull())
        .join(routes.select(F.col("id").alias("route_id"), "area_id"), "route_id")
        .select(F.col("id").alias("image_id"), "route_id", "area_id", "b2_key", F.col("route_id").alias("label"), "created_at")
    )


def full_manifest(route_images: DataFrame, routes: DataFrame, areas: DataFrame, lines: DataFrame, min_images: int = 2) -> DataFrame:
    """Catalogue photos with a usable url, their route and the full area path, for routes with enough photos."""
    usable = route_images.where(F.col("image_url").isNotNull() & (F.col("image_url") != ""))
    places = areas.select(F.col("id").alias("area_id"), F.col("name").alias("area_name")).join(
        hierarchy.area_paths(lines).withColumnRenamed("id", "area_id"), "area_id"
    )
    route_columns = routes.select(F.col("id").alias("route_id"), F.col("name").alias("route_name"), *[c for c in routes.columns if c in ("area_id", "grade", "type", "description", "location", "gps")])
    # a route's photos all survive the joins or none does, so they are counted before them, on two columns
    photos = with_group_minimum(usable.select(F.col("id").alias("route_image_id"), "route_id", "image_url"), "route_id", min_images)
    return photos.join(route_columns.join(places, "area_id"), "route_id")


def dataset_rows(manifest: DataFrame, scores: DataFrame, filter_version: str, threshold: float, min_images: int = 2) -> DataFrame:
    """Rows of the training set: passing scores joined to the manifest, best score per photo, routes with
    enough passing photos, empty text for missing values."""
    passing = scores.where((F.col("filter_model_version") == filter_version) & (F.col("raw_score") >= F.lit(float(threshold))))
    best = passing.groupBy("route_image_id").agg(F.max("raw_score").alias("filter_score"))
    rows = with_group_minimum(manifest.dropDuplicates(["route_image_id"]).join(best, "route_image_id"), "route_id", min_images)
    for name in SHARD_TEXT:
        rows = rows.withColumn(name, X.blank_if_null(F.col(name)) if name in rows.columns else F.lit(""))
    return rows.withColumn("filter_model_version", F.lit(filter_version))


def with_shard(rows: DataFrame, order: list, shard_size: int, key: str, *columns: str) -> DataFrame:
    """`idx` (position in the training set, from 0) and its shard; shards hold exactly `shard_size` rows but
    for the last. Only the unique `key` and the `columns` that `order` looks at are sorted; the rows get their number by key."""
    ranked = global_rank(rows.select(key, *columns), order, name="_r")
    numbers = ranked.select(key, (F.col("_r") - 1).alias("idx"), F.expr(f"(_r - 1) div {int(shard_size)}").alias("shard"))
    return rows.join(numbers, key)


def shard_name(shard: Column) -> Column:
    return F.format_string("train-%05d", shard)


# --- splits and epoch orders ------------------------------------------------------------------------------


def route_groups(rows: DataFrame, idx: str = "idx") -> DataFrame:
    """One row per route: first position, number of photos and the area path of the first photo."""
    return rows.groupBy("route_id").agg(
        F.min(idx).alias("first_idx"), F.count(F.lit(1)).alias("n"), F.min_by("area_path", idx).alias("area_path")
    )


def contiguous_split(groups: DataFrame, train: float, val: float, true_dfs: bool = False) -> DataFrame:
    """Whole routes in area order: train while fewer than int(train*N) photos came before, then val, then test."""
    if train < 0 or val < 0 or train + val > 1.0:
        raise ValueError("train and val must not be negative and not exceed 1 together")
    path = hierarchy.depth_first_key(F.col("area_path")) if true_dfs else F.col("area_path")
    ordered = running_before(groups.withColumn("_path", path), "n", ["_path", "first_idx"], name="before", total="_total")
    n_train = F.floor(F.lit(float(train)) * F.col("_total"))
    n_val = F.floor(F.lit(float(val)) * F.col("_total"))
    return ordered.withColumn(
        "split", F.when(F.col("before") < n_train, "train").when(F.col("before") < n_train + n_val, "val").otherwise("test")
    ).drop("_path", "_total")


def rows_of(rows: DataFrame, groups: DataFrame, *columns: str) -> DataFrame:
    """Photo rows with columns of their route's group row, such as its split or its batch."""
    return rows.join(groups.select("route_id", *columns), "route_id")


def epoch_orders(groups: DataFrame, epochs: int, seed: int = 42) -> DataFrame:
    """The route rows once per epoch with `shuffle_key`, a fresh order for each epoch."""
    every = groups.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(epochs - 1).cast("long"))))
    return every.withColumn("shuffle_key", order_key(seed, F.col("epoch"), F.col("route_id")))


RANDOM_ORDER = ["shuffle_key", "route_id"]                # routes anywhere
LOCAL_ORDER = ["area_path", "shuffle_key", "route_id"]    # areas in path order, routes shuffled inside
