"""Similarity search, text search, listings, queues and the join shapes behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from talus.functions import text as X
from talus.operators import catalogue as C, hierarchy as H, prototypes
from talus.operators.ordering import global_rank
from talus.plans.registry import query
from talus.sources.tables import MODEL_VERSION, Catalogue


# Independent of the operators' way: best similarity per query and route over a narrow list of ids, ranks by counting
# better routes, names last.
SHOWN = """
    SELECT image_id AS photo, i.route_id, 'field' AS kind FROM image_embeddings e JOIN images i ON e.image_id = i.id AND i.status = 'approved'
    UNION ALL SELECT route_image_id, p.route_id, 'catalogue' FROM route_image_embeddings e JOIN route_images p ON e.route_image_id = p.id
    WHERE p.route_id IN (SELECT id FROM routes WHERE status = 'approved')"""
BEST = """
    SELECT query_id, route_id, max(list_cosine_similarity(v.embedding, q.vector)) AS s
    FROM shown JOIN (SELECT vec_id, embedding::DOUBLE[] AS embedding FROM embeddings) v ON v.vec_id = photo CROSS JOIN label_queries q
    WHERE route_id IN (SELECT id FROM routes WHERE area_id IN (SELECT id FROM areas)) {scope} GROUP BY query_id, route_id"""
TOP = """
    SELECT t.query_id, t.rank::INTEGER AS rank, t.route_id, r.name, r.grade, r.url, a.name AS area, round(t.s, 4) + 0.0 AS similarity
    FROM (SELECT b.*, rank() OVER (PARTITION BY query_id ORDER BY s DESC, route_id) AS rank FROM best b) t
    JOIN routes r ON r.id = t.route_id JOIN areas a ON a.id = r.area_id WHERE t.rank <= {k}"""
SCOPE = "AND route_id IN (SELECT x.id FROM area_closure c JOIN routes x ON x.area_id = c.descendant WHERE c.ancestor = {root})"


def _top_parts(scope: str = "") -> dict[str, str]:
    return {"shown": SHOWN, "best": BEST.format(scope=scope)}


TOP_PARTS = _top_parts()


def _search(c: Catalogue, **options) -> DataFrame:
    return C.similarity_search(
        c.label_queries, c.image_embeddings, c.images, c.route_image_embeddings, c.route_images, c.routes, c.areas,
        MODEL_VERSION, **options,
    )


@query("M1 J1 J2 U1 A1 T1 F11 F16 P1 P2", TOP.format(k=5), **TOP_PARTS)
def similarity_search(c):
    return _search(c)


@query("M1 R1 P8", TOP.format(k=5), **_top_parts(SCOPE.format(root=2)))
def similarity_search_in_region(c):
    return _search(c, area_id=2)


@query("M1 R1 T1", TOP.format(k=20), **_top_parts(SCOPE.format(root=103)))
def similarity_search_in_nation(c):
    return _search(c, area_id=103, top_k=20)


@query("R3 A2 T2 P7 J3 J4 F1 F2", """
    SELECT found.id, TITLE(found.name) AS name, coalesce(nullif(TITLE(up.name), '') || ' / ', '') || TITLE(found.name) AS full_path, found.n AS route_count
    FROM (SELECT a.id, a.name, a.parent_id, coalesce(sum(per.n), 0)::BIGINT AS n FROM areas a
          LEFT JOIN (SELECT ancestor, descendant FROM area_closure WHERE depth < 9) c ON c.ancestor = a.id
          LEFT JOIN (SELECT area_id, count(*) AS n FROM routes GROUP BY area_id) per ON per.area_id = c.descendant
          WHERE a.status = 'approved' AND lower(a.name) LIKE '%nation-%' GROUP BY a.id, a.name, a.parent_id) found
    LEFT JOIN areas up ON up.id = found.parent_id ORDER BY found.n DESC, found.id LIMIT 8""")
def text_search_areas(c):
    return C.search_areas(c.areas, c.routes, "nation-")


@query("P7 J3 T3 F2 Z1", """
    SELECT r.id, r.name, r.grade,
           TITLE(p.name) || ' / ' ||
           TITLE(a.name) AS area
    FROM routes r JOIN areas a ON a.id = r.area_id LEFT JOIN areas p ON p.id = a.parent_id
    WHERE (r.name ILIKE '%order-11%' OR r.name ILIKE '%order 11%') AND r.status = 'approved'
    ORDER BY r.name NULLS LAST, r.id LIMIT 10""")
def text_search_routes(c):
    return C.search_routes(c.areas, c.routes, "order 11")


@query("R2 P8 P12 T4 Z15", """
    SELECT r.id, r.name, r.grade, r.url, TITLE(a.name) AS area, row_number() OVER (ORDER BY a.name NULLS LAST, r.name NULLS LAST, r.id) AS position
    FROM routes r JOIN areas a ON a.id = r.area_id
    WHERE r.area_id IN (SELECT descendant FROM area_closure WHERE ancestor = 1 AND depth <= 8) AND r.status = 'approved'""")
def area_route_listing(c):
    return C.area_routes(c.areas, c.routes, 1)


@query("P7 Z7", """
    SELECT id, name FROM routes WHERE name ILIKE '%der_1%' AND status = 'approved'""")
def wildcard_name_match(c):
    return C.approved(c.routes).where(X.matches_text(F.col("name"), "der_1")).select("id", "name")


@query("F1 F2 F3 J3 P14", """
    SELECT a.id, TITLE(a.name) AS title,
           CASE WHEN p.name IS NULL THEN '' ELSE TITLE(p.name) || ' / ' END
           || TITLE(a.name) AS full_path,
           p.name AS parent_name, '%' || replace(trim(a.name), ' ', '-') || '%' AS pattern
    FROM areas a LEFT JOIN areas p ON p.id = a.parent_id""")
def area_titles(c):
    parents = c.areas.select(F.col("id").alias("p_id"), F.col("name").alias("parent_name"))
    return c.areas.join(parents, F.col("parent_id") == F.col("p_id"), "left").select(
        "id", X.title(F.col("name")).alias("title"), X.path_label(F.col("parent_name"), F.col("name")).alias("full_path"),
        "parent_name", X.slug_pattern(F.col("name")).alias("pattern"),
    )


@query("J4 A2 Z6", """
    SELECT g.id, g.name, count(r.id) AS route_count FROM areas g
    LEFT JOIN area_closure d ON d.ancestor = g.id LEFT JOIN routes r ON r.area_id = d.descendant GROUP BY g.id, g.name""")
def route_counts_per_area(c):
    per_area = c.routes.groupBy("area_id").agg(F.count(F.lit(1)).alias("n"))
    counts = H.area_sums(c.areas, c.areas, per_area.select(F.col("area_id").alias("id"), F.col("n").alias("value")))
    return c.areas.join(counts, F.col("id") == F.col("root"), "left").select("id", "name", F.coalesce("total", F.lit(0)).alias("route_count"))


@query("J1 T4 F19", """
    SELECT e.image_id, r.id AS route_id, a.id AS area_id, a.name AS area, strftime(i.created_at, '%Y-%m-%dT%H:%M:%S.%f') AS created_at
    FROM image_embeddings e JOIN images i ON i.id = e.image_id JOIN routes r ON r.id = i.route_id JOIN areas a ON a.id = r.area_id
    WHERE e.model_version = 'v1' AND i.status = 'approved'""")
def field_photo_chain(c):
    return (
        C.of_version(c.image_embeddings, MODEL_VERSION).select("image_id")
        .join(C.approved(c.images).select(F.col("id").alias("image_id"), "route_id", "created_at"), "image_id")
        .join(c.routes.select(F.col("id").alias("route_id"), "area_id"), "route_id")
        .join(c.areas.select(F.col("id").alias("area_id"), F.col("name").alias("area")), "area_id")
        .orderBy("route_id", "created_at", "image_id")
        .select("image_id", "route_id", "area_id", "area", X.iso_timestamp(F.col("created_at")).alias("created_at"))
    )


@query("J2", """
    SELECT e.route_image_id, r.id AS route_id, a.id AS area_id FROM route_image_embeddings e
    JOIN route_images i ON i.id = e.route_image_id JOIN routes r ON r.id = i.route_id JOIN areas a ON a.id = r.area_id
    WHERE e.model_version = 'v1' AND r.status = 'approved'""")
def catalogue_photo_chain(c):
    return (
        C.of_version(c.route_image_embeddings, MODEL_VERSION).select("route_image_id")
        .join(c.route_images.select(F.col("id").alias("route_image_id"), "route_id"), "route_image_id")
        .join(C.approved(c.routes).select(F.col("id").alias("route_id"), "area_id"), "route_id")
        .join(c.areas.select(F.col("id").alias("area_id")), "area_id", "left_semi")
        .select("route_image_id", "route_id", "area_id")
    )


@query("J5 A4", """
    SELECT i.id, i.route_id FROM images i WHERE i.status = 'approved'
    AND NOT EXISTS (SELECT 1 FROM image_embeddings e WHERE e.image_id = i.id AND e.model_version = 'v1')""")
def embedding_backlog(c):
    return C.missing_embeddings(c.images, c.image_embeddings, MODEL_VERSION).select("id", "route_id")


@query("A4", """
    SELECT count(*) AS pending FROM images i WHERE i.status = 'approved'
    AND NOT EXISTS (SELECT 1 FROM image_embeddings e WHERE e.image_id = i.id AND e.model_version = 'v1')""")
def embedding_backlog_size(c):
    return C.missing_embeddings(c.images, c.image_embeddings, MODEL_VERSION).agg(F.count(F.lit(1)).alias("pending"))


@query("T5 J1 F19", """
    SELECT i.id, i.submitted_by, strftime(i.created_at, '%Y-%m-%dT%H:%M:%S.%f') AS created_at, r.id AS route_id, r.name AS route_name, r.grade, a.name AS area
    FROM images i JOIN routes r ON r.id = i.route_id JOIN areas a ON a.id = r.area_id WHERE i.status = 'unreviewed'""")
def pending_image_queue(c):
    return C.pending_images(c.images, c.routes, c.areas)


def in_order(rows_: DataFrame, *order: str) -> DataFrame:
    """The rows with their place, so that the comparison sees the order."""
    return global_rank(rows_, list(order), name="position")


@query("T5 J3", """
    SELECT a.id, a.name, a.parent_id, p.name AS parent_name, a.submitted_by, strftime(a.created_at, '%Y-%m-%dT%H:%M:%S.%f') AS created_at,
           row_number() OVER (ORDER BY a.created_at, a.id) AS position
    FROM areas a LEFT JOIN areas p ON p.id = a.parent_id WHERE a.status = 'unreviewed'""")
def pending_area_queue(c):
    return in_order(C.pending_areas(c.areas), "created_at", "id")


@query("T5 F19", """
    SELECT r.id, r.name, r.grade, r.area_id, a.name AS area, r.submitted_by, strftime(r.created_at, '%Y-%m-%dT%H:%M:%S.%f') AS created_at,
           row_number() OVER (ORDER BY r.created_at, r.id) AS position
    FROM routes r JOIN areas a ON a.id = r.area_id WHERE r.status = 'unreviewed'""")
def pending_route_queue(c):
    return in_order(C.pending_routes(c.routes, c.areas), "created_at", "id")


@query("A3", """
    SELECT i + a + r AS total, i AS image_count, a AS area_count, r AS route_count FROM (
        SELECT (SELECT count(*) FROM images WHERE status = 'unreviewed') AS i, (SELECT count(*) FROM areas WHERE status = 'unreviewed') AS a,
               (SELECT count(*) FROM routes WHERE status = 'unreviewed') AS r)""")
def pending_totals(c):
    return C.pending_counts(c.images, c.areas, c.routes)


@query("P13", """
    SELECT route_id, query_id, CASE WHEN similarity >= 0.9 THEN 'high' WHEN similarity >= 0.75 THEN 'medium' ELSE 'low' END AS band,
           floor(100 * similarity + 0.5)::BIGINT AS percent FROM top""", **TOP_PARTS, top=TOP.format(k=5))
def match_bands(c):
    """Display bands of the best matches."""
    band, percent = C.similarity_band(F.col("similarity"))
    return _search(c).select("route_id", "query_id", band.alias("band"), percent.alias("percent"))


@query("P13", """
    SELECT g.id, count(r.id) AS n, CASE WHEN count(r.id) > 1000 THEN 'block' WHEN count(r.id) > 500 THEN 'warn' ELSE 'ok' END AS level
    FROM areas g LEFT JOIN area_closure d ON d.ancestor = g.id LEFT JOIN routes r ON r.area_id = d.descendant GROUP BY g.id""")
def area_size_levels(c):
    return route_counts_per_area(c).select("id", F.col("route_count").alias("n"), C.size_band(F.col("route_count")).alias("level"))


@query("J8 F11", """
    SELECT q.query_id, count(*) AS n, round(max(list_cosine_similarity(e.embedding, q.vector)), 6) + 0.0 AS best,
           round(avg(list_cosine_similarity(e.embedding, q.vector)), 6) + 0.0 AS mean
    FROM image_embeddings e, label_queries q GROUP BY 1""")
def query_score_summary(c):
    return C.score_summary(c.label_queries, c.image_embeddings, "image_id")


VARIANTS = """
    SELECT image_id, route_name, round(a, 6) + 0.0 AS sim_first, round(b, 6) + 0.0 AS sim_second, b > a + 0.001 AS second_wins FROM (
        SELECT e.image_id, r.name AS route_name, list_cosine_similarity(e.embedding, v.pos) AS a, list_cosine_similarity(e.embedding, v.neg) AS b
        FROM image_embeddings e JOIN images i ON i.id = e.image_id JOIN routes r ON r.id = i.route_id,
             (SELECT max(CASE WHEN keep THEN m END) AS pos, max(CASE WHEN NOT keep THEN m END) AS neg FROM means) v
        WHERE i.status = 'approved' {scope})"""
VARIANT_MEANS = """SELECT keep, list(x ORDER BY pos) AS m FROM (SELECT keep, pos, avg(x) AS x FROM (
        SELECT keep, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM scored) GROUP BY ALL) GROUP BY 1"""


def _variants(c, **options):
    rows_ = c.table("embeddings").withColumn("keep", F.col("label") < 5)
    variants = prototypes.mean_vectors(rows_, "keep", "embedding").select((~F.col("keep")).cast("long").alias("query_id"), F.col("mean").alias("vector"))
    result = C.variant_comparison(variants, c.image_embeddings, c.images, c.routes, MODEL_VERSION, **options)
    return result.withColumn("sim_first", F.round("sim_first", 6)).withColumn("sim_second", F.round("sim_second", 6))


@query("M2 J8 T6", VARIANTS.format(scope=""), means=VARIANT_MEANS)
def variant_comparison(c):
    return _variants(c)


@query("M2 J8 P7", VARIANTS.format(scope="AND r.name ILIKE '%ORDER 3%'"), means=VARIANT_MEANS)
def variant_comparison_by_route(c):
    return _variants(c, route_name="ORDER 3")


@query("M3 F10 F11", """
    SELECT image_id, 1.0::DOUBLE AS similarity FROM image_embeddings""")
def stored_vector_consistency(c):
    again = c.image_embeddings.select("image_id", X.text_to_vector(X.vector_to_text(F.col("embedding"))).alias("embedding"))
    return C.self_consistency(c.image_embeddings, again, "image_id").withColumn("similarity", F.round("similarity", 4))


@query("M3 F11", """
    SELECT image_id, round(list_cosine_similarity(embedding, list_transform(embedding, lambda x, i: x * (1 + (image_id + i) % 3))), 6) + 0.0 AS similarity FROM image_embeddings""")
def changed_vector_consistency(c):
    """Stored vectors against ones that were recomputed with other weights, which differ from photo to photo."""
    again = F.transform("embedding", lambda x, i: x.cast("double") * (1 + (F.col("image_id") + i + 1) % 3)).alias("embedding")
    found = C.self_consistency(c.image_embeddings, c.image_embeddings.select("image_id", again), "image_id")
    return found.withColumn("similarity", F.round("similarity", 6))


@query("U1 U3", """
    SELECT source, count(*) AS n, sum(id)::BIGINT AS ids FROM (
        SELECT 'field' AS source, image_id AS id FROM image_embeddings UNION ALL SELECT 'catalogue', route_image_id FROM route_image_embeddings) GROUP BY 1""")
def embedding_union(c):
    both = c.image_embeddings.select(F.lit("field").alias("source"), F.col("image_id").alias("id")).unionByName(
        c.route_image_embeddings.select(F.lit("catalogue").alias("source"), F.col("route_image_id").alias("id")))
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query("J6 U2 K9", """
    SELECT i.id FROM route_images i WHERE NOT EXISTS (SELECT 1 FROM filter_scores s WHERE s.route_image_id = i.id AND s.filter_model_version = 'best')""")
def unscored_photos(c):
    done = C.of_version(c.filter_scores, "best", "filter_model_version").select(F.col("route_image_id").alias("id"))
    return c.route_images.select("id").join(done, "id", "left_anti")


@query("U4", "SELECT DISTINCT url FROM (SELECT image_url AS url FROM route_images UNION ALL SELECT 'https://x/route/' || route_id FROM route_images)")
def processed_key_union(c):
    urls = c.route_images.select(F.col("image_url").alias("url"))
    return urls.union(c.route_images.select(F.concat(F.lit("https://x/route/"), F.col("route_id").cast("string")).alias("url"))).distinct()
