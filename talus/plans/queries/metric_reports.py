"""Threshold, retrieval and class metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.operators import knn, metrics as M, prototypes as P
from talus.plans.registry import query

RATES = """
    SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM (
        SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall,
               100.0::DOUBLE * (tp + fp) / (tp + fp + fn + tn) AS keep_pct FROM ({counts}))"""
COUNTS = """
    SELECT t AS threshold, count(*) FILTER (WHERE keep AND score >= t) AS tp, count(*) FILTER (WHERE NOT keep AND score >= t) AS fp,
           count(*) FILTER (WHERE keep AND score < t) AS fn, count(*) FILTER (WHERE NOT keep AND score < t) AS tn FROM {source}, ({grid}) GROUP BY t"""
PARETO_GRID = "SELECT unnest(range(40, 99))::DOUBLE / 100 AS t"
SHOWN = "threshold, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(keep_pct, 6) AS keep_pct"


def _grid(values) -> str:
    return f"SELECT unnest([{', '.join(repr(v) for v in values)}]::DOUBLE[]) AS t"


def _rates(grid: str, source: str = "filter_scores") -> str:
    return RATES.format(counts=COUNTS.format(source=source, grid=grid))


def _shown(df):
    return df.select("threshold", "tp", "fp", "fn", "tn", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1", "keep_pct")])


def scored_vectors(c):
    """Every stored vector with a class, a label and a score from its first component."""
    first = F.col("embedding")[0].cast("double")
    return c.table("embeddings").select(
        F.col("vec_id").alias("id"), (F.col("label") < 5).alias("keep"), "label", "embedding", ((F.lit(1.0) + first) / F.lit(2.0)).alias("score"))


@query("A11 A9 A10", f"SELECT {SHOWN} FROM ({_rates(_grid(M.REPORT_THRESHOLDS))})")
def threshold_report(c):
    return _shown(M.threshold_sweep(c.filter_scores, "score", "keep", M.REPORT_THRESHOLDS))


@query("A11", f"SELECT {SHOWN} FROM ({_rates(_grid(M.CHECKPOINT_THRESHOLDS))})")
def checkpoint_threshold_report(c):
    return _shown(M.threshold_sweep(c.filter_scores, "score", "keep", M.CHECKPOINT_THRESHOLDS))


@query("A11", f"SELECT {SHOWN} FROM ({_rates(_grid(M.VALIDATION_THRESHOLDS), 'scored')})")
def validation_threshold_report(c):
    return _shown(M.threshold_sweep(scored_vectors(c), "score", "keep", M.VALIDATION_THRESHOLDS))


@query("A12", f"""SELECT round(precision, 6) AS precision, threshold, round(keep_pct, 6) AS keep_pct FROM ({_rates(PARETO_GRID)})
    WHERE keep_pct >= 5.0 AND precision > 0 ORDER BY 1 DESC, 2 LIMIT 1""")
def pareto_score(c):
    return M.pareto(c.filter_scores, "score", "keep").withColumn("precision", F.round("precision", 6)).withColumn("keep_pct", F.round("keep_pct", 6))


@query("A13", f"""SELECT round(precision, 6) AS precision, threshold FROM ({_rates(_grid(M.REPORT_THRESHOLDS))}) WHERE precision > 0 ORDER BY 1 DESC, 2 LIMIT 1""")
def best_precision_threshold(c):
    best = M.best_precision(M.threshold_sweep(c.filter_scores, "score", "keep", M.REPORT_THRESHOLDS))
    return best.select(F.round("precision", 6).alias("precision"), "threshold")


@query("A9 A10", f"""SELECT tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM ({_rates("SELECT 0.55::DOUBLE AS t", "scored")})""")
def confusion_at_threshold(c):
    out = M.with_rates(M.confusion(scored_vectors(c), "score", "keep", 0.55))
    return out.select("tp", "fp", "fn", "tn", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")])


@query("A20", f"""
    SELECT class, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, tp + fn AS support FROM (
        SELECT 'keep' AS class, tp, fp, fn FROM c UNION ALL SELECT 'reject', tn, fn, fp FROM c)""",
    c=COUNTS.format(source="scored", grid="SELECT 0.5::DOUBLE AS t"))
def class_report(c):
    report = M.class_report(scored_vectors(c), "score", "keep", 0.5)
    return report.select("class", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "support")


@query("A20 Z18", "SELECT round(100.0::DOUBLE * count(*) FILTER (WHERE keep) / count(*), 6) AS base_rate FROM filter_scores")
def base_rate(c):
    return c.filter_scores.agg(F.round(F.try_divide(F.lit(100.0) * F.count_if("keep"), F.count(F.lit(1)).cast("double")), 6).alias("base_rate"))


@query("A18", """
    SELECT round(-avg(y * ln(p + 1e-8) + (1 - y) * pow(pn, 4) * ln(1 - pn + 1e-8)), 6) AS loss FROM (
        SELECT keep::INT AS y, p, greatest(p - 0.05, 0.0) AS pn FROM (SELECT keep, 1 / (1 + exp(-(score * 4 - 2))) AS p FROM filter_scores))""")
def asymmetric_loss(c):
    rows = c.filter_scores.select((F.col("score") * 4 - 2).alias("logit"), "keep")
    return M.asymmetric_loss(rows, "logit", "keep").select(F.round("loss", 6).alias("loss"))


@query("A19", """
    SELECT count(*) FILTER (WHERE kept >= 2) AS viable, count(*) AS labels, round(100.0::DOUBLE * count(*) FILTER (WHERE kept >= 2) / count(*), 6) AS viable_pct FROM (
        SELECT route_image_id // 10 AS label, count(*) FILTER (WHERE score >= 0.55) AS kept FROM filter_scores GROUP BY 1)""")
def route_viability(c):
    rows = c.filter_scores.withColumn("label", F.expr("route_image_id div 10"))
    return M.route_viability(rows, "score", "label", 0.55).withColumn("viable_pct", F.round("viable_pct", 6))


@query("T7", """
    SELECT id, kind FROM (SELECT id, 'fp' AS kind FROM scored WHERE NOT keep AND score >= 0.55 ORDER BY score DESC, id LIMIT 5)
    UNION ALL SELECT id, kind FROM (SELECT id, 'fn' AS kind FROM scored WHERE keep AND score < 0.55 ORDER BY score, id LIMIT 5)""")
def worst_errors(c):
    return M.worst_errors(scored_vectors(c), "score", "keep", "id", 0.55, 10).select("id", "kind")


@query("T8", """
    SELECT id, CASE WHEN keep THEN 'tp' ELSE 'fp' END AS kind FROM scored WHERE score >= 0.55
    UNION ALL SELECT id, kind FROM (SELECT id, 'fn' AS kind FROM scored WHERE keep AND score < 0.55 ORDER BY score DESC, id LIMIT 20)""")
def review_sample(c):
    return M.review_sample(scored_vectors(c), "score", "keep", "id", 0.55, 20).select("id", "kind")


NEIGHBOURS = """
    SELECT a.id AS query_id, b.id AS neighbour_id, a.label = b.label AS same, list_cosine_similarity(a.embedding, b.embedding) AS s,
           row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.embedding, b.embedding), 12) DESC, b.id) AS rank
    FROM scored a JOIN scored b ON a.id <> b.id"""


@query("A14 A15 J10 M4 Z4", """
    SELECT round(avg(CASE WHEN f <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_1, round(avg(CASE WHEN f <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_3,
           round(avg(CASE WHEN f <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_5, round(avg(CASE WHEN f <= 5 THEN 1.0 / f ELSE 0.0 END), 6) AS mrr FROM (
        SELECT query_id, min(CASE WHEN same THEN rank END) AS f FROM neighbours GROUP BY 1)""", neighbours=NEIGHBOURS)
def retrieval_metrics(c):
    out = M.retrieval(c.table("embeddings"), "vec_id", "label", "embedding")
    return out.select(*[F.round(x, 6).alias(x) for x in out.columns])


@query("M4 J10 Z4", "SELECT query_id, neighbour_id, rank::INTEGER AS rank, round(s, 6) + 0.0 AS similarity FROM neighbours WHERE rank <= 6", neighbours=NEIGHBOURS)
def exact_neighbours(c):
    rows = c.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return knn.nearest(rows, rows, 6, exclude_self=True).withColumn("similarity", F.round("similarity", 6))


@query("M4 J8", "SELECT query_id, neighbour_id, rank::INTEGER AS rank, round(s, 6) + 0.0 AS similarity FROM neighbours WHERE rank <= 6", neighbours=NEIGHBOURS)
def exact_neighbours_by_cells(c):
    """The same with few cells and small blocks, as crowded cells have at scale."""
    rows = c.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return knn.nearest(rows, rows, 6, exclude_self=True, block_rows=512, lists=16).withColumn("similarity", F.round("similarity", 6))


@query("A16 F15", """
    SELECT round(avg(a), 6) AS alignment FROM (
        SELECT a.label, avg(2 - 2 * list_dot_product(a.embedding, b.embedding)) AS a FROM scored a JOIN scored b ON a.label = b.label AND a.id < b.id GROUP BY 1)""")
def alignment(c):
    return knn.alignment(c.table("embeddings"), "label", "embedding").select(F.round("alignment", 6).alias("alignment"))


@query("A16", """
    SELECT a.label, round(avg(2 - 2 * list_dot_product(a.embedding, b.embedding)), 6) AS alignment FROM scored a JOIN scored b ON a.label = b.label AND a.id < b.id GROUP BY 1""")
def alignment_per_label(c):
    return knn.label_alignment(c.table("embeddings"), "label", "embedding").select("label", F.round("alignment", 6).alias("alignment"))


@query("A17 F15 X4", """
    SELECT round(ln(avg(exp(-2 * pow(list_distance(a.embedding, b.embedding), 2)))), 6) AS uniformity FROM sampled a JOIN sampled b ON a.id < b.id""",
    sampled="SELECT id, embedding FROM (SELECT *, row_number() OVER (ORDER BY md5('42|' || id), id) AS rn FROM scored) WHERE rn <= 150")
def uniformity(c):
    return knn.uniformity(c.table("embeddings"), "vec_id", "embedding", sample=150).select(F.round("uniformity", 6).alias("uniformity"))


@query("A8", """
    SELECT label, pos, round(avg(x), 6) + 0.0 AS mean FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM scored) GROUP BY 1, 2""")
def class_mean_vectors(c):
    means = P.mean_vectors(c.table("embeddings"), "label", "embedding")
    return means.select("label", F.posexplode("mean").alias("pos", "mean")).select("label", F.col("pos").cast("long").alias("pos"), F.round("mean", 6).alias("mean"))
