"""Registered queries and, next to each, the same question in SQL for the comparison engine."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from talus.sources.tables import Catalogue

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(covers: str, sql: str | None = None, **ctes: str):
    """Register a function of a Catalogue under its own name; `covers` names the inventory ids."""

    def add(fn: Callable[[Catalogue], DataFrame]):
        QUERIES[fn.__name__] = lambda spark, folder: fn(Catalogue(spark, folder))
        COVERS[fn.__name__] = covers
        if sql is not None:
            ORACLES[fn.__name__] = with_views(sql, **ctes)
        return fn

    return add


# The catalogue relations in SQL, in dependency order (see talus.sources.tables.Catalogue).
VIEWS = {
    "areas": """
        SELECT *, 'https://x/area/' || id || '/' || name AS url FROM (
        SELECT r_regionkey::BIGINT AS id, NULL::BIGINT AS parent_id, lower(r_name) AS name, 'approved' AS status, NULL::BIGINT AS submitted_by, NULL::TIMESTAMP AS created_at FROM region
        UNION ALL SELECT (100 + n_nationkey)::BIGINT, n_regionkey::BIGINT, lower(replace(n_name, '_', '-')), 'approved', NULL, NULL FROM nation
        UNION ALL SELECT (1000 + c_custkey)::BIGINT, (100 + c_nationkey)::BIGINT, lower(replace(c_name, '#', '-')),
               CASE WHEN c_acctbal < 0 THEN 'unreviewed' ELSE 'approved' END, c_nationkey::BIGINT,
               TIMESTAMP '2020-01-01 00:00:00' + to_minutes(floor(c_acctbal)::BIGINT) FROM customer)""",
    "part_tree": """
        SELECT id, CASE WHEN id > 1 THEN id // 2 END AS parent_id, 'p' || id AS name FROM (SELECT p_partkey + 1 AS id FROM part)""",
    "routes": """
        SELECT o_orderkey AS id, 1000 + o_custkey AS area_id, 'Order ' || o_orderkey AS name, o_orderpriority AS grade,
               'https://x/route/' || o_orderkey AS url, o_orderstatus AS type,
               CASE WHEN o_totalprice > 250000 THEN 'long route' END AS description,
               CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'unreviewed' ELSE 'rejected' END AS status,
               o_orderdate AS created_at, o_custkey AS submitted_by FROM orders""",
    "images": """
        SELECT event_id AS id, user_id AS route_id, CASE WHEN event_type = 'signup' THEN 'admin' ELSE 'user' END AS source,
               CASE event_type WHEN 'error' THEN 'rejected' WHEN 'view' THEN 'unreviewed' ELSE 'approved' END AS status,
               user_id AS submitted_by, ts AS created_at, event_type AS content FROM events""",
    "route_images": """
        SELECT doc_id AS id, doc_id // 10 AS route_id, 'https://x/' || source || '/' || doc_id || '_large.jpg?c=1' AS image_url,
               text AS content FROM documents""",
    "image_embeddings": "SELECT vec_id AS image_id, 'v1' AS model_version, embedding::DOUBLE[] AS embedding, label FROM embeddings",
    "route_image_embeddings": "SELECT vec_id AS route_image_id, 'v1' AS model_version, embedding::DOUBLE[] AS embedding, label FROM embeddings",
    "filter_scores": """
        SELECT doc_id AS route_image_id, 'best' AS filter_model_version, ((doc_id * 37) % 1000)::DOUBLE / 1000.0::DOUBLE AS score,
               (((doc_id * 37) % 1000)::DOUBLE / 1000.0::DOUBLE)::FLOAT AS raw_score, quality = 1 AS keep FROM labels""",
    "label_queries": """
        SELECT label::BIGINT AS query_id, list(x ORDER BY pos) AS vector FROM (
            SELECT label, pos, avg(x::DOUBLE) AS x FROM (
                SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY ALL)
        GROUP BY 1""",
    "review_log": """
        SELECT user_id AS image_id, ts, event_id,
               CASE WHEN event_type IN ('error', 'purchase', 'signup') THEN 'review' ELSE 'feedback' END AS channel,
               CASE event_type WHEN 'error' THEN 'reject' WHEN 'purchase' THEN 'approve' WHEN 'signup' THEN 'approve' END AS action,
               CASE event_type WHEN 'click' THEN true WHEN 'view' THEN false END AS confirmed,
               CASE WHEN event_type IN ('purchase', 'view', 'error') THEN (props::JSON ->> '$.k')::BIGINT END AS correct_route_id
        FROM events""",
    "area_closure": """
        SELECT id AS ancestor, id AS descendant, 0 AS depth FROM areas
        UNION ALL SELECT c.ancestor, a.id, c.depth + 1 FROM areas a JOIN area_closure c ON a.parent_id = c.descendant""",
    "part_closure": """
        SELECT id AS ancestor, id AS descendant, 0 AS depth FROM part_tree
        UNION ALL SELECT c.ancestor, a.id, c.depth + 1 FROM part_tree a JOIN part_closure c ON a.parent_id = c.descendant""",
    "area_paths": """
        SELECT id, name AS area_path, 0 AS area_depth FROM areas WHERE parent_id IS NULL
        UNION ALL SELECT a.id, p.area_path || '/' || a.name, p.area_depth + 1 FROM areas a JOIN area_paths p ON a.parent_id = p.id""",
    "manifest": """
        SELECT * FROM (
            SELECT ri.id AS route_image_id, ri.image_url, r.id AS route_id, r.name AS route_name, r.grade, r.type, r.description,
                   a.id AS area_id, a.name AS area_name, p.area_path, p.area_depth, count(*) OVER (PARTITION BY r.id) AS n
            FROM route_images ri JOIN routes r ON r.id = ri.route_id JOIN areas a ON a.id = r.area_id JOIN area_paths p ON p.id = a.id
            WHERE ri.image_url IS NOT NULL AND ri.image_url <> '') WHERE n >= 2""",
    "train_rows": """
        SELECT *, row_number() OVER (ORDER BY filter_score DESC, route_image_id) - 1 AS idx FROM (
            SELECT m.*, s.raw_score AS filter_score, count(*) OVER (PARTITION BY m.route_id) AS passing
            FROM manifest m JOIN filter_scores s USING (route_image_id) WHERE s.raw_score >= 0.2::DOUBLE) WHERE passing >= 2""",
    "train_groups": """
        SELECT route_id, min(idx) AS first_idx, count(*) AS n, arg_min(area_path, idx) AS area_path FROM train_rows GROUP BY 1""",
    "manifest_groups": """
        SELECT route_id, min(route_image_id) AS first_idx, count(*) AS n, arg_min(area_path, route_image_id) AS area_path FROM manifest GROUP BY 1""",
    "scored": """
        SELECT vec_id AS id, label < 5 AS keep, label, embedding::DOUBLE[] AS embedding,
               (1.0 + embedding[1]::DOUBLE) / 2.0 AS score FROM embeddings""",
}


def _mentions(text: str, name: str) -> bool:
    return re.search(rf"\b{name}\b", text) is not None


def _title(match: re.Match) -> str:
    """SQL of talus.functions.text.title for one column, written TITLE(column) in a statement."""
    words = rf"regexp_extract_all(replace({match[1]}, '-', ' '), '\p{{L}}+|[^\p{{L}}]+')"
    return f"array_to_string(list_transform({words}, lambda w: CASE w[1] WHEN 'ß' THEN 'Ss' ELSE upper(w[1]) END || lower(w[2:])), '')"


def with_views(sql: str, **ctes: str) -> str:
    """Prefix the views and CTEs a statement needs."""
    sql = re.sub(r"TITLE\(([^)]+)\)", _title, sql)
    needed: set[str] = set()

    def need(text: str):
        for name, body in VIEWS.items():
            if name not in needed and _mentions(text, name):
                needed.add(name)
                need(body)

    for text in (sql, *ctes.values()):
        need(text)
    parts = [f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in needed] + [f"{n} AS ({b})" for n, b in ctes.items()]
    return (f"WITH RECURSIVE {', '.join(parts)} " if parts else "") + sql
