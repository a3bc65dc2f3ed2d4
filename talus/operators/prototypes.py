"""Class mean vectors and prototype scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from talus.functions import vectors as V


def summaries(df: DataFrame, key: str, vector: str, *metrics: str) -> DataFrame:
    """(key, s): per-class vector statistics. Each task combines its rows into one buffer per class, so what is
    shuffled is a vector per class and task, however many rows a class has."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    rows = df.where(F.col(vector).isNotNull()).select(key, array_to_vector(F.col(vector)).alias("v"))
    return rows.groupBy(key).agg(Summarizer.metrics(*metrics).summary(F.col("v")).alias("s"))


def mean_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, members, mean): the element-wise mean per class."""
    from pyspark.ml.functions import vector_to_array

    return summaries(df, key, vector, "count", "mean").select(
        key, F.col("s.count").alias("members"), vector_to_array("s.mean").alias("mean")
    )


def keep_prototypes(df: DataFrame, keep: str, vector: str) -> DataFrame:
    """One row: unit mean vector of the kept and of the rejected rows."""
    means = mean_vectors(df, keep, vector).select(keep, V.normalise(F.col("mean")).alias("unit"))
    return means.agg(
        F.max_by("unit", F.col(keep).cast("int")).alias("positive"),
        F.min_by("unit", F.col(keep).cast("int")).alias("negative"),
    )


def prototype_scores(df: DataFrame, vector: str, prototypes: DataFrame, name: str = "score") -> DataFrame:
    """P(keep) of each row: softmax over the similarities to the two prototypes (a two-vector subquery)."""
    unit = V.normalise(F.col(vector))
    positive = prototypes.select("positive").scalar()
    negative = prototypes.select("negative").scalar()
    return (
        df.withColumns({"_unit": unit, "_p": positive, "_n": negative})
        .withColumn("_pos", V.dot(F.col("_unit"), F.col("_p")))
        .withColumn("_neg", V.dot(F.col("_unit"), F.col("_n")))
        .withColumn(name, V.softmax_first(F.col("_pos"), F.col("_neg")))
        .drop("_unit", "_p", "_n", "_pos", "_neg")
    )


def linear_scores(df: DataFrame, vector: str, weights: list[float], bias: float, name: str = "score") -> DataFrame:
    """sigmoid(w . v/|v| + b) for a fixed linear head."""
    head = F.array(*[F.lit(float(w)) for w in weights])
    z = V.dot(F.col(vector), head)
    return df.withColumn(name, V.sigmoid(F.try_divide(z, V.norm(F.col(vector))) + F.lit(float(bias))))


def score_log(scored: DataFrame, id: str, version: str, threshold: float, score: str = "score") -> DataFrame:
    """Rows of the filter-score table. The stored score is a FLOAT, but `passed` is decided on the double."""
    limit = F.lit(float(threshold))
    return scored.select(
        id, F.lit(version).alias("filter_model_version"), F.col(score).cast("float").alias("raw_score"),
        (F.col(score) >= limit).alias("passed"), limit.cast("float").alias("threshold"), F.current_timestamp().alias("scored_at"),
    )
