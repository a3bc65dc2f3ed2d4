"""Trained classifiers over vector columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from talus.functions.vectors import dot, sigmoid


def balanced_head(training: DataFrame, keep: str, vector: str, c: float = 1.0, max_iter: int = 1000, tol: float = 1e-6) -> tuple[list[float], float]:
    """(coefficients, intercept) of a logistic regression for P(keep) whose classes weigh n / (2 n_class).

    The penalty 1/(c * sum of weights) makes Spark's averaged objective the usual sum form with inverse
    strength c; features are not standardised, the intercept is not penalised."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = training.select(
        array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.col(keep).cast("double").alias("label")
    )
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("pos")).first()
    total, positives = counts["n"], counts["pos"]
    negatives = total - positives
    if not positives or not negatives:
        raise ValueError("both classes are needed")
    weight = F.when(F.col("label") == 1, total / (2.0 * positives)).otherwise(total / (2.0 * negatives))
    model = LogisticRegression(
        weightCol="weight", regParam=1.0 / (c * total), elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=tol
    ).fit(rows.withColumn("weight", weight))
    return [float(w) for w in model.coefficients], float(model.intercept)


def balanced_logistic(df: DataFrame, keep: str, vector: str, train: DataFrame | None = None, c: float = 1.0,
                      max_iter: int = 1000, name: str = "score") -> DataFrame:
    """P(keep) from `balanced_head`, fitted on `train` or on the rows themselves. The head is one weight per dimension, so
    scoring is a plain expression."""
    weights, intercept = balanced_head(df if train is None else train, keep, vector, c, max_iter)
    return df.withColumn(name, sigmoid(dot(F.col(vector), F.array(*[F.lit(w) for w in weights])) + F.lit(intercept)))
