"""Incremental embedding: rows without a vector of this version go through an encoder and are upserted."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from talus.operators.catalogue import missing_embeddings
from talus.operators.rows import upsert


def encode(pending: DataFrame, id: str, content: str, make_encoder: Callable[[], Callable], model_version: str) -> DataFrame:
    """(id, model_version, embedding, error) per pending row.

    `make_encoder` runs once per task and returns a function from a list of content values to as many lists of
    floats. If a batch fails, its values are encoded one by one; one that fails alone becomes an error row and does
    not stop the task."""
    id_type = pending.schema[id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make_encoder()

        def one(value):
            try:
                return encoder([value])[0], None
            except Exception as problem:  # a bad row is reported, not raised
                return None, f"{type(problem).__name__}: {problem}"

        for pdf in batches:
            values = pdf[content].tolist()
            try:
                vectors = encoder(values)
                if len(vectors) != len(values):
                    raise ValueError("an encoder has to return a vector for each value")
                results = [(vector, None) for vector in vectors]
            except Exception:  # some value of the batch: find out which
                results = [one(v) for v in values]
            yield pd.DataFrame({
                id: pdf[id], "model_version": model_version,
                "embedding": [r[0] for r in results], "error": [r[1] for r in results],
            })

    return pending.select(id, content).mapInPandas(run, f"{id} {id_type}, model_version string, embedding array<float>, error string")


def split_results(encoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = encoded.where(F.col("error").isNull()).drop("error")
    return good, encoded.where(F.col("error").isNotNull())


def job_counters(encoded: DataFrame) -> DataFrame:
    return encoded.agg(
        F.count_if(F.col("error").isNull()).alias("embedded"), F.count_if(F.col("error").isNotNull()).alias("failed")
    )


def embed_pending(images: DataFrame, embeddings: DataFrame, content: str, make_encoder: Callable[[], Callable],
                  model_version: str, key: str = "image_id") -> tuple[DataFrame, DataFrame]:
    """(embeddings after the job, failed rows). `images` has id, status and the content column."""
    from talus.session import cut

    pending = missing_embeddings(images, embeddings, model_version, key).withColumnRenamed("id", key)
    good, failed = split_results(cut(encode(pending, key, content, make_encoder, model_version)))
    fresh = good.withColumn("computed_at", F.current_timestamp())
    if "computed_at" not in embeddings.columns:
        fresh = fresh.drop("computed_at")
    return upsert(embeddings, fresh, [key, "model_version"], F.col(key), F.col("model_version") == model_version), failed
