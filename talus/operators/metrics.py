"""Evaluation metrics over scored rows: one pass over the data, then work on a handful of rows."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window, functions as F

from talus.functions.vectors import sigmoid
from talus.operators import knn

# Threshold grids of the reports and of the Pareto search, and the loss constants.
REPORT_THRESHOLDS = [0.40, 0.50, 0.60, 0.70, 0.75, 0.80, 0.85, 0.90, 0.91, 0.92, 0.93, 0.94, 0.95, 0.96, 0.97, 0.98, 0.99]
CHECKPOINT_THRESHOLDS = [0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.91, 0.92, 0.93, 0.94, 0.95, 0.96, 0.97, 0.98, 0.99]
VALIDATION_THRESHOLDS = [0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95]
PARETO_THRESHOLDS = [t / 100 for t in range(40, 99)]
GAMMA_NEG, GAMMA_POS, MARGIN, EPS = 4, 0, 0.05, 1e-8


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def with_rates(df: DataFrame) -> DataFrame:
    """precision, recall, f1 (0.0 where undefined) and keep_pct (NULL on empty input) from tp/fp/fn/tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return (
        df.withColumn("precision", ratio(tp, tp + fp))
        .withColumn("recall", ratio(tp, tp + fn))
        .withColumn("f1", ratio(F.lit(2.0) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
        .withColumn("keep_pct", F.try_divide(F.lit(100.0) * (tp + fp), (tp + fp + fn + tn).cast("double")))
    )


def confusion(df: DataFrame, score: str, truth: str, threshold: float, groups: list[str] = ()) -> DataFrame:
    predicted = F.col(score) >= F.lit(float(threshold))
    actual = F.col(truth)
    return df.groupBy(*groups).agg(
        F.count_if(actual & predicted).alias("tp"),
        F.count_if(~actual & predicted).alias("fp"),
        F.count_if(actual & ~predicted).alias("fn"),
        F.count_if(~actual & ~predicted).alias("tn"),
    )


def threshold_sweep(df: DataFrame, score: str, truth: str, thresholds: list[float]) -> DataFrame:
    """One row of counts and rates per threshold (score >= threshold keeps).

    A row only adds to the bucket "how many thresholds does it reach"; the table is read once whatever the
    number of thresholds, and the cumulative sums run over the buckets."""
    grid = sorted(set(float(t) for t in thresholds))
    reached = reduce(add, [(F.col(score) >= F.lit(t)).cast("int") for t in grid])
    buckets = df.where(F.col(score).isNotNull()).groupBy(reached.alias("bucket")).agg(
        F.count_if(F.col(truth)).alias("pos"), F.count_if(~F.col(truth)).alias("neg")
    )
    steps = df.sparkSession.range(1).select(F.posexplode(F.array(F.lit(None).cast("double"), *[F.lit(t) for t in grid])).alias("bucket", "threshold"))
    filled = steps.join(buckets, "bucket", "left").select(
        "bucket", "threshold", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("neg", F.lit(0)).alias("neg")
    )
    whole = Window.partitionBy(F.lit(0))
    above = whole.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, 0)
    counted = filled.select(
        "threshold",
        F.sum("pos").over(above).alias("tp"),
        F.sum("neg").over(above).alias("fp"),
        (F.sum("pos").over(whole) - F.sum("pos").over(above)).alias("fn"),
        (F.sum("neg").over(whole) - F.sum("neg").over(above)).alias("tn"),
    )
    return with_rates(counted.where(F.col("threshold").isNotNull()))


def best_precision(sweep: DataFrame, min_keep_pct: float | None = None) -> DataFrame:
    """(precision, threshold, keep_pct) of the highest precision above zero; the lowest threshold wins a tie,
    and a row of zeros stands for none."""
    usable = sweep.where(F.col("precision") > 0)
    if min_keep_pct is not None:
        usable = usable.where(F.col("keep_pct") >= F.lit(float(min_keep_pct)))
    best = usable.agg(F.max_by(F.struct("precision", "threshold", "keep_pct"), F.struct("precision", -F.col("threshold"))).alias("b"))
    return best.select(*[F.coalesce(f"b.{c}", F.lit(0.0)).alias(c) for c in ("precision", "threshold", "keep_pct")])


def pareto(df: DataFrame, score: str, truth: str, min_keep_pct: float = 5.0) -> DataFrame:
    return best_precision(threshold_sweep(df, score, truth, PARETO_THRESHOLDS), min_keep_pct)


def asymmetric_loss(df: DataFrame, logit: str, target: str) -> DataFrame:
    p = sigmoid(F.col(logit))
    p_neg = F.greatest(p - F.lit(MARGIN), F.lit(0.0))
    y = F.col(target).cast("double")
    positive = y * F.pow(F.lit(1.0) - p, F.lit(float(GAMMA_POS))) * F.log(p + F.lit(EPS))
    negative = (F.lit(1.0) - y) * F.pow(p_neg, F.lit(float(GAMMA_NEG))) * F.log(F.lit(1.0) - p_neg + F.lit(EPS))
    return df.agg((-F.avg(positive + negative)).alias("loss"))


def class_report(df: DataFrame, score: str, truth: str, threshold: float) -> DataFrame:
    """precision, recall, f1 and support of both classes at one threshold."""
    counts = confusion(df, score, truth, threshold)
    both = counts.select(F.inline(F.array(
        F.struct(F.lit("keep").alias("class"), "tp", "fp", "fn", "tn"),
        F.struct(F.lit("reject").alias("class"), F.col("tn").alias("tp"), F.col("fn").alias("fp"), F.col("fp").alias("fn"), F.col("tp").alias("tn")),
    )))
    return with_rates(both).select("class", "precision", "recall", "f1", (F.col("tp") + F.col("fn")).alias("support"))


def route_viability(df: DataFrame, score: str, label: str, threshold: float, minimum: int = 2) -> DataFrame:
    """Labels that still have `minimum` rows at the threshold, all labels, and the share in percent."""
    per = df.groupBy(label).agg(F.count_if(F.col(score) >= F.lit(float(threshold))).alias("kept"))
    return per.agg(
        F.count_if(F.col("kept") >= minimum).alias("viable"), F.count(F.lit(1)).alias("labels")
    ).withColumn("viable_pct", F.try_divide(F.lit(100.0) * F.col("viable"), F.col("labels").cast("double")))


def worst_errors(df: DataFrame, score: str, truth: str, id: str, threshold: float, n: int = 10) -> DataFrame:
    """The n//2 highest-scored false positives and the n//2 lowest-scored false negatives."""
    half = n // 2
    kept = F.col(score) >= F.lit(float(threshold))
    fp = df.where(kept & ~F.col(truth)).orderBy(F.col(score).desc(), id).limit(half).withColumn("kind", F.lit("fp"))
    fn = df.where(~kept & F.col(truth)).orderBy(F.col(score).asc(), id).limit(half).withColumn("kind", F.lit("fn"))
    return fp.unionByName(fn)


def review_sample(df: DataFrame, score: str, truth: str, id: str, threshold: float, show_fn: int) -> DataFrame:
    """Every kept row as tp or fp, plus the `show_fn` best-scored false negatives."""
    keeps = F.col(score) >= F.lit(float(threshold))
    kept = df.where(keeps).withColumn("kind", F.when(F.col(truth), "tp").otherwise("fp"))
    missed = df.where(~keeps & F.col(truth)).orderBy(F.col(score).desc(), id).limit(show_fn).withColumn("kind", F.lit("fn"))
    return kept.unionByName(missed)


def retrieval(df: DataFrame, id: str, label: str, vector: str, ks: tuple[int, ...] = (1, 3, 5), **knn_options) -> DataFrame:
    """recall_at_k for every k and the reciprocal rank cut off at max(ks), over all rows (rows alone in their
    label count as misses)."""
    rows = df.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("vector"))
    labels = df.select(F.col(id).cast("long").alias("_id"), F.col(label).alias("_label"))
    found = knn.nearest(rows, rows, max(ks), exclude_self=True, **knn_options)
    # queries x k neighbour rows: look both labels up by key
    own = labels.select(F.col("_id").alias("query_id"), F.col("_label").alias("own"))
    other = labels.select(F.col("_id").alias("neighbour_id"), F.col("_label").alias("other"))
    hits = (
        found.join(other, "neighbour_id").join(own, "query_id").where(F.col("own") == F.col("other"))
        .groupBy("query_id").agg(F.min("rank").alias("first_hit"))
    )
    scored = labels.join(hits, labels["_id"] == hits["query_id"], "left")
    total = F.count(F.lit(1)).cast("double")
    return scored.agg(
        *[F.try_divide(F.count_if(F.col("first_hit") <= k).cast("double"), total).alias(f"recall_at_{k}") for k in ks],
        F.try_divide(F.sum(F.coalesce(F.lit(1.0) / F.col("first_hit"), F.lit(0.0))), total).alias("mrr"),
    )
