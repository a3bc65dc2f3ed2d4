"""Scalar expressions and row predicates over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.functions import text as X
from talus.plans.registry import query


@query("F4 F5 F6 F7", r"""
    SELECT id, list_last(string_split(image_url, '/')) AS segment, string_split(list_last(string_split(image_url, '/')), '?')[1] AS cache_name,
           md5(image_url) AS url_md5, md5(content) AS content_md5, regexp_replace(replace(small, '_topo', ''), '_(smallMed|small|medium)', '_large', 'g') AS normal,
           replace(replace(image_url, 'src', 'large'), 'large', 'medium') AS fallback
    FROM (SELECT *, replace(image_url, '_large', '_topo_smallMed') AS small FROM route_images)""")
def url_expressions(c):
    small = F.replace("image_url", F.lit("_large"), F.lit("_topo_smallMed"))
    url = F.col("image_url")
    return c.route_images.select(
        "id", X.last_segment(url).alias("segment"), X.cache_name(url).alias("cache_name"), F.md5("image_url").alias("url_md5"),
        F.md5("content").alias("content_md5"), X.normalise_image_url(small).alias("normal"), X.medium_fallback(F.replace(url, F.lit("src"), F.lit("large"))).alias("fallback"))


@query("F1", "SELECT doc_id, coalesce(TITLE(text), '') AS title FROM documents")
def document_titles(c):
    return c.table("documents").select("doc_id", X.title(F.col("text")).alias("title"))


@query("F8", "SELECT doc_id, array_to_string(list_transform(list_filter(list_zip(w, range(len(w))), lambda p: list_position(w, p[1]) = p[2] + 1), lambda p: p[1]), ' ') AS words FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)")
def distinct_words_in_order(c):
    return c.table("documents").select("doc_id", F.array_join(F.array_distinct(F.split("text", " ", -1)), " ").alias("words"))


@query("F9", "SELECT event_id, event_type AS a, CASE WHEN event_type = 'view' THEN 'late' ELSE 'early' END AS b, user_id::VARCHAR AS c FROM events")
def merged_maps(c):
    kind = F.col("event_type")
    first = F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.lit("early"))
    second = F.create_map(F.lit("a"), kind, F.lit("c"), F.col("user_id").cast("string"))
    third = F.when(kind == "view", F.create_map(F.lit("b"), F.lit("late"))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    merged = X.merge_maps(first, second, third)
    return c.table("events").select("event_id", *[merged[k].alias(k) for k in ("a", "b", "c")])


@query("F16 P4 Z5", "SELECT route_image_id, round(score, 4) AS score, score >= 0.9 AS passed, raw_score >= 0.9::DOUBLE AS raw_passed FROM filter_scores")
def score_flags(c):
    return c.filter_scores.select(
        "route_image_id", F.round("score", 4).alias("score"), (F.col("score") >= 0.9).alias("passed"), (F.col("raw_score") >= F.lit(0.9)).alias("raw_passed"))


@query("P3 P2", "SELECT route_image_id, round(raw_score::DOUBLE, 4) AS raw_score FROM filter_scores WHERE filter_model_version = 'best' AND raw_score >= 0.9::DOUBLE")
def passing_scores(c):
    rows = c.filter_scores.where((F.col("filter_model_version") == "best") & (F.col("raw_score") >= F.lit(0.9)))
    return rows.select("route_image_id", F.round(F.col("raw_score").cast("double"), 4).alias("raw_score"))


@query("F17 F18 Z10", """
    SELECT r.id, coalesce(description, '') AS description, coalesce(type, '') AS type, a.name || '|' || coalesce(description, 'None') AS label FROM routes r JOIN areas a ON a.id = r.area_id""")
def text_defaults(c):
    areas = c.areas.select(F.col("id").alias("area_id"), F.col("name").alias("area"))
    return c.routes.join(areas, "area_id").select(
        "id", X.blank_if_null(F.col("description")).alias("description"), X.blank_if_null(F.col("type")).alias("type"),
        X.label_key(F.col("area"), F.col("description")).alias("label"))


@query("F19", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS at FROM events")
def iso_timestamps(c):
    return c.table("events").select("event_id", X.iso_timestamp(F.col("ts")).alias("at"))


@query("F20", "SELECT id, regexp_extract(list_last(string_split(image_url, '/')), '^(.+)\\.[^.]+$', 1) AS tag FROM route_images")
def model_tags(c):
    return c.route_images.select("id", X.file_stem(F.col("image_url")).alias("tag"))


@query("F3", r"SELECT doc_id, '%' || replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), ' ', '-') || '%' AS pattern FROM documents")
def slug_patterns(c):
    padded = F.concat(F.lit("\t "), F.col("text"), F.lit(" \n"))
    return c.table("documents").select("doc_id", X.slug_pattern(padded).alias("pattern"))


@query("P5", "SELECT id FROM route_images WHERE image_url IS NOT NULL AND image_url <> ''")
def usable_photo_urls(c):
    return c.route_images.where(F.col("image_url").isNotNull() & (F.col("image_url") != "")).select("id")


@query("P6 P1", "SELECT route_image_id FROM filter_scores WHERE keep")
def kept_annotations(c):
    return c.filter_scores.where("keep").select("route_image_id")


@query("A5", "SELECT status, count(*) AS routes, count(DISTINCT area_id) AS areas FROM routes GROUP BY 1")
def distinct_counts_per_status(c):
    return c.routes.groupBy("status").agg(F.count(F.lit(1)).alias("routes"), F.countDistinct("area_id").alias("areas"))
