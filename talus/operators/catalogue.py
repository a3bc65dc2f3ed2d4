"""Catalogue queries: scoped similarity search, text search, listings and review queues."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from talus.functions import text as X
from talus.functions.vectors import similarities_to
from talus.operators import hierarchy, scoring
from talus.operators.ordering import global_rank

TOP_K_RANGE = (1, 20)
AREA_DEPTH = 8               # deepest level of the listing queries below their root
AREA_ROWS, ROUTE_ROWS = 8, 10


def check_top_k(top_k: int) -> int:
    low, high = TOP_K_RANGE
    if not low <= top_k <= high:
        raise ValueError(f"top_k must be between {low} and {high}")
    return top_k


def check_query(query: str) -> str:
    if len(query) < 2:
        raise ValueError("a search text needs at least two characters")
    return query


def approved(df: DataFrame) -> DataFrame:
    return df.where(F.col("status") == "approved")


def of_version(df: DataFrame, version: str, column: str = "model_version") -> DataFrame:
    return df.where(F.col(column) == version)


def score_summary(queries: DataFrame, vectors: DataFrame, id: str) -> DataFrame:
    """(query_id, n, best, mean): each query vector (query_id, vector) against all stored ones."""
    found = scoring.summary(queries, vectors, id, "embedding")
    return found.select("query_id", "n", F.round("best", 6).alias("best"), F.round(F.col("total") / F.col("n"), 6).alias("mean"))


def similarity_search(queries: DataFrame, image_embeddings: DataFrame, images: DataFrame,
                      route_image_embeddings: DataFrame, route_images: DataFrame, routes: DataFrame,
                      areas: DataFrame, model_version: str, area_id: int | None = None, top_k: int = 5) -> DataFrame:
    """Best routes per query vector: cosine against field photos and catalogue photos, maximum per route,
    top k. With `area_id`, only routes in that area's subtree (any depth).

    Field photos need an approved image; catalogue photos need an approved route. Routes are settled first: photos
    learn their route, the others drop out, and each task keeps the best routes of every query among the vectors it
    reads. The stored vectors of either kind are scanned once, for any number of queries.
    """
    check_top_k(top_k)
    placed = routes.join(areas.select(F.col("id").alias("area_id")), "area_id", "left_semi")
    if area_id is not None:
        placed = placed.join(hierarchy.descend(areas, area_id).select(F.col("id").alias("area_id")), "area_id", "left_semi")
    known = placed.select(F.col("id").alias("route_id"), "status")
    field = approved(images).select(F.col("id").alias("image_id"), "route_id").join(known.select("route_id"), "route_id", "left_semi")
    shown = route_images.select(F.col("id").alias("route_image_id"), "route_id").join(approved(known).select("route_id"), "route_id", "left_semi")
    vectors = (
        of_version(image_embeddings, model_version).join(field, "image_id").select("route_id", "embedding")
        .unionByName(of_version(route_image_embeddings, model_version).join(shown, "route_image_id").select("route_id", "embedding"))
    )
    best = scoring.best_per_group(queries, vectors, "route_id", "embedding", top_k)
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc_nulls_last(), F.col("id"))
    top = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).withColumnRenamed("id", "route_id")
    named = top.join(routes.select(F.col("id").alias("route_id"), "area_id", "name", "grade", "url"), "route_id").join(
        areas.select(F.col("id").alias("area_id"), F.col("name").alias("area")), "area_id"
    )
    return named.select("query_id", "rank", "route_id", "name", "grade", "url", "area", F.round("similarity", 4).alias("similarity"))


def search_areas(areas: DataFrame, routes: DataFrame, query: str, escape: bool = False) -> DataFrame:
    """Approved areas whose name matches, with the number of routes (any status) up to eight levels below.

    Routes are counted per area first; a route has one area, so the distinct count of a subtree is the sum."""
    check_query(query)
    matching = approved(areas).where(X.matches_text(F.col("name"), query, escape)).select("id", "name", "parent_id")
    per_area = routes.groupBy("area_id").agg(F.count(F.lit(1)).alias("n"))
    values = per_area.select(F.col("area_id").alias("id"), F.col("n").alias("value"))
    counts = hierarchy.area_sums(areas, matching, values, AREA_DEPTH).groupBy("root").agg(F.sum("total").alias("routes"))
    top = (
        matching.join(counts, F.col("id") == F.col("root"), "left")
        .select("id", "name", "parent_id", F.coalesce("routes", F.lit(0)).alias("route_count"))
        .orderBy(F.col("route_count").desc(), "id").limit(AREA_ROWS)
    )
    parents = areas.select(F.col("id").alias("p_id"), F.col("name").alias("parent_name"))
    return (
        top.join(parents, F.col("parent_id") == F.col("p_id"), "left")
        .select("id", X.title(F.col("name")).alias("name"), X.path_label(F.col("parent_name"), F.col("name")).alias("full_path"), "route_count")
        .orderBy(F.col("route_count").desc(), "id")
    )


def search_routes(areas: DataFrame, routes: DataFrame, query: str, escape: bool = False) -> DataFrame:
    check_query(query)
    homes = areas.select(F.col("id").alias("a_id"), F.col("name").alias("a_name"), "parent_id")
    by_name = [F.col("name").asc_nulls_last(), F.col("id")]
    top = (
        approved(routes).where(X.matches_text(F.col("name"), query, escape)).select("id", "name", "grade", "area_id")
        .join(homes, F.col("area_id") == F.col("a_id")).orderBy(*by_name).limit(ROUTE_ROWS)
    )
    parents = areas.select(F.col("id").alias("p_id"), F.col("name").alias("p_name"))
    return (
        top.join(parents, F.col("parent_id") == F.col("p_id"), "left").orderBy(*by_name)
        .select("id", "name", "grade", X.path_label(F.col("p_name"), F.col("a_name")).alias("area"))
    )


def area_routes(areas: DataFrame, routes: DataFrame, area_id: int) -> DataFrame:
    """Approved routes up to eight levels below an area with their `position`, by area name, route name and id."""
    scope = hierarchy.descend(areas, area_id, AREA_DEPTH).select(F.col("id").alias("area_id"))
    named = approved(routes).join(scope, "area_id", "left_semi").join(areas.select(F.col("id").alias("area_id"), F.col("name").alias("area_name")), "area_id")
    named = named.select("id", "name", "grade", "url", "area_name")
    listed = global_rank(named, [F.col("area_name").asc_nulls_last(), F.col("name").asc_nulls_last(), "id"], name="position")
    return listed.select("position", "id", "name", "grade", "url", X.title(F.col("area_name")).alias("area"))


def pending_images(images: DataFrame, routes: DataFrame, areas: DataFrame) -> DataFrame:
    """Unreviewed photos that have a route, oldest first."""
    return (
        images.where(F.col("status") == "unreviewed")
        .join(routes.select(F.col("id").alias("route_id"), F.col("name").alias("route_name"), "grade", "area_id"), "route_id")
        .join(areas.select(F.col("id").alias("area_id"), F.col("name").alias("area")), "area_id")
        .orderBy(F.col("created_at").asc_nulls_last(), "id")
        .select("id", "submitted_by", X.iso_timestamp(F.col("created_at")).alias("created_at"), "route_id", "route_name", "grade", "area")
    )


def pending_areas(areas: DataFrame) -> DataFrame:
    parents = areas.select(F.col("id").alias("p_id"), F.col("name").alias("parent_name"))
    return (
        areas.where(F.col("status") == "unreviewed").join(parents, F.col("parent_id") == F.col("p_id"), "left")
        .orderBy(F.col("created_at").asc_nulls_last(), "id")
        .select("id", "name", "parent_id", "parent_name", "submitted_by", X.iso_timestamp(F.col("created_at")).alias("created_at"))
    )


def pending_routes(routes: DataFrame, areas: DataFrame) -> DataFrame:
    return (
        routes.where(F.col("status") == "unreviewed")
        .join(areas.select(F.col("id").alias("area_id"), F.col("name").alias("area")), "area_id")
        .orderBy(F.col("created_at").asc_nulls_last(), "id")
        .select("id", "name", "grade", "area_id", "area", "submitted_by", X.iso_timestamp(F.col("created_at")).alias("created_at"))
    )


def pending_counts(images: DataFrame, areas: DataFrame, routes: DataFrame) -> DataFrame:
    """One row of queue lengths; photos without a route count here although the list leaves them out."""
    parts = None
    for kind, df in (("image", images), ("area", areas), ("route", routes)):
        one = df.agg(F.count_if(F.col("status") == "unreviewed").alias("n")).select(F.lit(kind).alias("kind"), "n")
        parts = one if parts is None else parts.unionByName(one)
    return parts.agg(
        F.sum("n").alias("total"), *[F.sum(F.when(F.col("kind") == k, F.col("n"))).alias(f"{k}_count") for k in ("image", "area", "route")]
    )


def missing_embeddings(images: DataFrame, embeddings: DataFrame, model_version: str, id: str = "image_id") -> DataFrame:
    """Approved images without a vector of this version."""
    have = of_version(embeddings, model_version).select(F.col(id).alias("id"))
    return approved(images).join(have, "id", "left_anti")


def similarity_band(similarity):
    """Display band of a match and its rounded percentage."""
    band = F.when(similarity >= 0.9, "high").when(similarity >= 0.75, "medium").otherwise("low")
    return band, F.floor(F.lit(100.0) * similarity + F.lit(0.5)).cast("long")


def size_band(count):
    """Warning level of an area by its number of routes."""
    return F.when(count > 1000, "block").when(count > 500, "warn").otherwise("ok")


def variant_comparison(variants: DataFrame, image_embeddings: DataFrame, images: DataFrame, routes: DataFrame,
                       model_version: str, margin: float = 0.001, route_name: str | None = None) -> DataFrame:
    """Two forms of one query vector (query_id 0 and 1) against every approved stored photo; flags photos that
    the second form matches better by more than `margin`. With `route_name`, only photos of routes whose name holds it,
    whatever its case; `%` and `_` in it stand for any characters and any one."""
    forms = {row["query_id"]: row["vector"] for row in variants.where(F.col("query_id").isin(0, 1)).collect()}
    shown = routes if route_name is None else routes.where(F.col("name").ilike(f"%{route_name}%"))
    named = approved(images).select(F.col("id").alias("image_id"), "route_id").join(shown.select(F.col("id").alias("route_id"), F.col("name").alias("route_name")), "route_id")
    vectors = of_version(image_embeddings, model_version).join(named.select("image_id"), "image_id", "left_semi")
    scored = vectors.select("image_id", similarities_to(np.array([forms[0], forms[1]]))("embedding").alias("scores"))
    first, second = F.col("scores")[0], F.col("scores")[1]
    return (
        scored.join(named, "image_id")
        .select("image_id", "route_name", first.alias("sim_first"), second.alias("sim_second"), (second > first + margin).alias("second_wins"))
        .orderBy(F.col("sim_first").desc(), F.col("sim_second").desc(), F.col("route_name").desc(), "image_id")
    )


def self_consistency(stored: DataFrame, recomputed: DataFrame, id: str) -> DataFrame:
    """Cosine of the stored and the recomputed vector of each id."""
    from talus.functions.vectors import cosine

    again = recomputed.select(id, F.col("embedding").alias("again"))
    return stored.join(again, id).select(id, cosine(F.col("embedding"), F.col("again")).alias("similarity"))
