"""Classifiers, pair mining, the coarse-cell index and the embedding job."""

from __future__ import annotations

import string

import numpy as np

from pyspark.sql import functions as F

from talus.functions import text as X, vectors as V
from talus.operators import knn, metrics as M, prototypes as P
from talus.operators.curation import mine_pairs
from talus.operators.rows import upsert
from talus.plans import embed_job
from talus.plans.queries.metric_reports import NEIGHBOURS, scored_vectors
from talus.plans.registry import query
from talus.session import cut

MEANS = """SELECT keep, list(x ORDER BY pos) AS m FROM (SELECT keep, pos, avg(x) AS x FROM (
    SELECT keep, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM scored) GROUP BY ALL) GROUP BY 1"""
SCORES = """SELECT s.id, s.keep, 1 / (1 + exp(list_cosine_similarity(s.embedding, n.m) - list_cosine_similarity(s.embedding, p.m))) AS p
    FROM scored s, (SELECT m FROM means WHERE keep) p, (SELECT m FROM means WHERE NOT keep) n"""


@query("M7 A8 F12 F13", "SELECT id, round(p, 6) AS score FROM scores", means=MEANS, scores=SCORES)
def prototype_scores(c):
    rows = scored_vectors(c).drop("score")
    return P.prototype_scores(rows, "embedding", P.keep_prototypes(rows, "keep", "embedding")).select("id", F.round("score", 6).alias("score"))


@query("M7 A9", """
    SELECT count(*) FILTER (WHERE keep AND p >= 0.5) AS tp, count(*) FILTER (WHERE NOT keep AND p >= 0.5) AS fp,
           count(*) FILTER (WHERE keep AND p < 0.5) AS fn, count(*) FILTER (WHERE NOT keep AND p < 0.5) AS tn FROM scores""", means=MEANS, scores=SCORES)
def prototype_confusion(c):
    rows = scored_vectors(c).drop("score")
    return M.confusion(P.prototype_scores(rows, "embedding", P.keep_prototypes(rows, "keep", "embedding")), "score", "keep", 0.5)


@query("M8")
def logistic_scores(c):
    """Balanced logistic regression on all vectors: confusion at 0.5."""
    from talus.operators.classifiers import balanced_logistic

    return M.confusion(balanced_logistic(scored_vectors(c).drop("score"), "keep", "embedding"), "score", "keep", 0.5)


# Newton's method on the weighted sum of log losses plus half the squared coefficients, three parameters, the inverse of
# the 3 x 3 second derivative written out.
NEWTON = """
    SELECT 0 AS k, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2
    UNION ALL SELECT k + 1,
        b0 - ((d * f - e * e) * g0 + (c * e - b * f) * g1 + (b * e - c * d) * g2) / det,
        b1 - ((c * e - b * f) * g0 + (a * f - c * c) * g1 + (b * c - a * e) * g2) / det,
        b2 - ((b * e - c * d) * g0 + (b * c - a * e) * g1 + (a * d - b * b) * g2) / det
    FROM (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM (
        SELECT k, b0, b1, b2, sum(w * (p - y)) AS g0, sum(w * (p - y) * x1) + b1 AS g1, sum(w * (p - y) * x2) + b2 AS g2,
               sum(w * p * (1 - p)) AS a, sum(w * p * (1 - p) * x1) AS b, sum(w * p * (1 - p) * x2) AS c,
               sum(w * p * (1 - p) * x1 * x1) + 1 AS d, sum(w * p * (1 - p) * x1 * x2) AS e, sum(w * p * (1 - p) * x2 * x2) + 1 AS f
        FROM (SELECT n.*, t.*, 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))) AS p FROM newton n, points t WHERE n.k < 12) GROUP BY k, b0, b1, b2))"""
POINTS = """
    SELECT embedding[1] AS x1, embedding[2] AS x2, keep::INT AS y,
           count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY keep)) AS w FROM scored"""


@query("M8", """
    SELECT name, round(value, 3) + 0.0 AS value FROM (
        SELECT 'intercept' AS name, b0 AS value FROM newton WHERE k = 12 UNION ALL SELECT 'first', b1 FROM newton WHERE k = 12
        UNION ALL SELECT 'second', b2 FROM newton WHERE k = 12)""", points=POINTS, newton=NEWTON)
def logistic_coefficients(c):
    """Coefficients of the balanced regression on the first two components of all vectors."""
    from talus.operators.classifiers import balanced_head

    rows = scored_vectors(c).select("keep", F.slice("embedding", 1, 2).alias("x"))
    (first, second), intercept = balanced_head(rows, "keep", "x", tol=1e-12)
    values = F.explode(F.create_map(F.lit("intercept"), F.lit(intercept), F.lit("first"), F.lit(first), F.lit("second"), F.lit(second)))
    return c.spark.range(1).select(values.alias("name", "value")).select("name", (F.round("value", 3) + 0.0).alias("value"))


# A fixed linear head for the scoring queries: weight 1/(i+1) on component i, bias 0.1.
HEAD = "list_transform(range(len(embedding)), lambda i: 1.0::DOUBLE / (i + 1))"


def head_of(c) -> list[float]:
    dim = len(c.table("embeddings").select("embedding").first()["embedding"])
    return [1.0 / (i + 1) for i in range(dim)]


@query("M9 F14 F12 P4 K6 Z5", f"""
    SELECT route_image_id, round(s::FLOAT::DOUBLE, 4) AS raw_score, s >= 0.55 AS passed FROM (
        SELECT route_image_id, 1 / (1 + exp(-(list_dot_product(embedding, {HEAD}) / sqrt(list_dot_product(embedding, embedding)) + 0.1))) AS s FROM route_image_embeddings)""")
def linear_head_scores(c):
    scored = P.linear_scores(c.route_image_embeddings, "embedding", head_of(c), 0.1)
    earlier = P.score_log(c.filter_scores, "route_image_id", "best", 0.55)
    merged = upsert(earlier, P.score_log(scored, "route_image_id", "head", 0.55), ["route_image_id", "filter_model_version"], F.col("scored_at"))
    head = merged.where(F.col("filter_model_version") == "head")
    return head.select("route_image_id", F.round(F.col("raw_score").cast("double"), 4).alias("raw_score"), "passed")


@query("M6 J9", """
    SELECT id FROM scored a WHERE EXISTS (SELECT 1 FROM scored b WHERE b.label = a.label AND b.id <> a.id AND list_cosine_similarity(a.embedding, b.embedding) > 0.3)""")
def photos_with_partner(c):
    rows = c.table("embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    return knn.with_partner(rows, "label", "id", "embedding", 0.3).select("id")


@query("M6 J9", """
    SELECT id FROM scored a WHERE EXISTS (SELECT 1 FROM scored b WHERE b.label = a.label AND b.id <> a.id AND list_cosine_similarity(a.embedding, b.embedding) > 0.3)""")
def photos_with_partner_in_small_blocks(c):
    """The same with labels cut into small blocks, as a hot label is at scale."""
    rows = c.table("embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    return knn.with_partner(rows, "label", "id", "embedding", 0.3, block_rows=32, lists=8).select("id")


@query("M6 W3 J9 J11", """
    SELECT id FROM firsts a WHERE EXISTS (SELECT 1 FROM firsts b WHERE b.label = a.label AND b.id <> a.id AND list_cosine_similarity(a.embedding, b.embedding) > 0.2)""",
    firsts="""SELECT id, label, embedding FROM (SELECT s.*, row_number() OVER (PARTITION BY md5(d.text) ORDER BY s.id) AS rn FROM scored s JOIN documents d ON d.doc_id = s.id) WHERE rn = 1""")
def mined_photos(c):
    content = c.route_images.select("id", F.md5("content").alias("digest"))
    rows = c.table("embeddings").select(F.col("vec_id").alias("id"), "label", "embedding").join(content, "id")
    return mine_pairs(rows, "label", "id", "embedding", "digest", "id", 0.2).select("id")


def _vectors(c):
    return c.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _recall(exact, found):
    hits = exact.join(found.select("query_id", "neighbour_id", F.lit(1).alias("hit")), ["query_id", "neighbour_id"], "left")
    return hits.agg(F.count(F.lit(1)).alias("exact"), F.count("hit").alias("found"), F.round(F.count("hit") / F.count(F.lit(1)), 4).alias("recall"))


@query("M5")
def coarse_cell_recall(c):
    """Share of the exact 5 nearest that the stored inverted lists find with 4 of 16 cells probed."""
    index = knn.InvertedLists.build(_vectors(c), lists=16)
    return _recall(knn.nearest(_vectors(c), _vectors(c), 5, exclude_self=True), index.search(_vectors(c), 5, probes=4, exclude_self=True))


@query("M5", """
    SELECT query_id, neighbour_id, rank::INTEGER AS rank, round(s, 6) + 0.0 AS similarity FROM neighbours WHERE rank <= 5""", neighbours=NEIGHBOURS)
def neighbours_in_all_lists(c):
    """The stored inverted lists with every cell probed: the exact 5 nearest."""
    index = knn.InvertedLists.build(_vectors(c), lists=16)
    reopened = knn.InvertedLists.open(c.spark, index.path)
    return reopened.search(_vectors(c), 5, probes=16, exclude_self=True).withColumn("similarity", F.round("similarity", 6))


@query("M5", "SELECT count(*) * 5 AS exact, true AS reached FROM embeddings")
def list_recall_reached(c):
    """The fewest probes that find nine tenths of the exact 5 nearest, and that they do."""
    index = knn.InvertedLists.build(_vectors(c), lists=16)
    exact = cut(knn.nearest(_vectors(c), _vectors(c), 5, exclude_self=True))
    found = index.search(_vectors(c), 5, probes=index.probes_for(exact, 0.9), exclude_self=True)
    return _recall(exact, found).select("exact", (F.col("recall") >= 0.9).alias("reached"))


def letter_encoder():
    """A small deterministic batch encoder for the job: relative letter frequencies; refuses letterless text."""

    def encode(texts: list[str]) -> list[list[float]]:
        counts = np.array([[low.count(letter) for letter in string.ascii_lowercase] for low in map(str.lower, texts)], dtype=float)
        totals = counts.sum(axis=1, keepdims=True)
        if not totals.all():
            raise ValueError("no letters")
        return (counts / totals).tolist()

    return encode


LETTERS = "(length(lower(text)) - length(replace(lower(text), '{}', '')))"


@query("M10 J5 K5 J13 D2 P16", f"""
    SELECT i.doc_id AS image_id, round(({LETTERS.format('a')} / total::DOUBLE)::FLOAT::DOUBLE, 4) AS a, round(({LETTERS.format('e')} / total::DOUBLE)::FLOAT::DOUBLE, 4) AS e
    FROM (SELECT *, {' + '.join(LETTERS.format(x) for x in string.ascii_lowercase)} AS total FROM documents) i
    WHERE total > 0 AND NOT EXISTS (SELECT 1 FROM image_embeddings v WHERE v.image_id = i.doc_id)""")
def newly_embedded(c):
    """Documents without a stored vector, encoded by a batch encoder and upserted; the new rows."""
    images = c.route_images.select("id", F.lit("approved").alias("status"), "content")
    table, _ = embed_job.embed_pending(images, c.image_embeddings.drop("label"), "content", letter_encoder, "v1")
    new = table.where(F.size("embedding") == 26)
    return new.select("image_id", F.round(F.col("embedding")[0].cast("double"), 4).alias("a"), F.round(F.col("embedding")[4].cast("double"), 4).alias("e"))


@query("M10 A21 P16", f"""
    SELECT count(*) FILTER (WHERE total > 0) AS embedded, count(*) FILTER (WHERE total = 0) AS failed
    FROM (SELECT {' + '.join(LETTERS.format(x) for x in string.ascii_lowercase)} AS total FROM documents)""")
def embedding_counters(c):
    rows = c.route_images.select("id", "content")
    return embed_job.job_counters(embed_job.encode(rows, "id", "content", letter_encoder, "v2"))


@query("F10", "SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: printf('%.8f', x::DOUBLE)), ',') || ']' AS text FROM embeddings")
def vectors_as_text(c):
    return c.table("embeddings").select("vec_id", X.vector_to_text(F.col("embedding")).alias("text"))


@query("F11 F12 F15", """
    SELECT id, round(sqrt(list_dot_product(embedding, embedding)), 5) AS norm, round(list_cosine_similarity(embedding, q.m), 6) + 0.0 AS cosine,
           round(pow(list_distance(embedding, q.m), 2), 5) AS distance, round(2 - 2 * list_cosine_similarity(embedding, q.m), 5) AS unit_distance
    FROM scored, (SELECT m FROM means WHERE keep) q""", means=MEANS)
def vector_expressions(c):
    rows = scored_vectors(c)
    m = P.mean_vectors(rows, "keep", "embedding").where("keep").select("mean").scalar()
    v = F.col("embedding")
    return rows.withColumn("m", m).select(
        "id", F.round(V.norm(v), 5).alias("norm"), F.round(V.cosine(v, F.col("m")), 6).alias("cosine"),
        F.round(V.squared_euclidean(v, F.col("m")), 5).alias("distance"), F.round(V.squared_distance_unit(V.cosine(v, F.col("m"))), 5).alias("unit_distance"))
