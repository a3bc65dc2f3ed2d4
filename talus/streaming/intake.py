"""Incremental intake: review events arrive as files and are folded micro-batch by micro-batch.

Below one folder lie
  folds/batch=<n>     the per-image folds of micro-batch n,
  vectors/batch=<n>   the vectors of the photos that micro-batch n made approved,
  bases/upto=<n>      the folded state and all vectors up to micro-batch n, written by `compact`,
  pointer             the n of the base that counts.
A micro-batch writes its own two folders (again, if it is replayed, so the stream is idempotent) and nothing else.
Readers take the base that the pointer names and the batches after it; so do micro-batches when they look up earlier
state. A compaction therefore runs beside the stream, and a batch that is replayed after it changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from talus.operators import state
from talus.plans.embed_job import embed_pending, encode, split_results

VECTOR = "image_id long, model_version string, embedding array<float>, error string"


def _base(spark: SparkSession, folder: str) -> int | None:
    """The micro-batch up to which the base that counts goes."""
    try:
        row = spark.read.schema("upto long").json(f"{folder}/pointer").agg(F.max("upto")).first()
    except AnalysisException:  # nothing was compacted yet
        return None
    return row[0]


def _stored(spark: SparkSession, folder: str, kind: str, base: int | None, before: int | None = None) -> DataFrame | None:
    """Rows of a kind from the base and the batches after it (and before `before`), None where there are none."""
    parts = []
    if base is not None:
        parts.append(spark.read.parquet(f"{folder}/bases/upto={base}/{kind}"))
    try:
        batches = spark.read.option("basePath", f"{folder}/{kind}").parquet(f"{folder}/{kind}/batch=*")
        number = F.col("batch").cast("long")
        after = number > (-1 if base is None else base)
        parts.append(batches.where(after if before is None else after & (number < before)).drop("batch"))
    except AnalysisException:  # no batch yet
        pass
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def fold_batch(folder: str, routes: DataFrame | None = None, embed: Callable[[DataFrame, int], DataFrame] | None = None):
    """foreachBatch function that stores the batch's folds, and with `embed` (see `embed_newly_approved`) the vectors of what
    they made approved. With `routes`, corrections to routes that do not exist are refused."""

    def write(batch: DataFrame, batch_id: int) -> None:
        decisions = state.decisions_of(batch)
        if routes is not None:
            decisions = state.known_corrections(decisions, routes)
        spark, place = batch.sparkSession, f"{folder}/folds/batch={batch_id}"
        state.fold_decisions(decisions).write.mode("overwrite").parquet(place)
        if embed is not None:
            made = embed(spark.read.parquet(place), batch_id)
            made.write.mode("overwrite").parquet(f"{folder}/vectors/batch={batch_id}")

    return write


def embed_newly_approved(folder: str, images: DataFrame, embeddings: DataFrame, content: str, make_encoder, model_version: str):
    """`embed` for `fold_batch`: (image_id, model_version, embedding, error) of the images that the batch leaves approved and
    that have no vector of this version, neither in `embeddings` nor from an earlier batch. Failed images are tried again
    when a later batch touches them."""

    def embed(folds: DataFrame, batch_id: int) -> DataFrame:
        spark = folds.sparkSession
        base = _base(spark, folder)
        earlier = _stored(spark, folder, "folds", base, before=batch_id)
        touched = folds.select("image_id")
        known = folds if earlier is None else folds.unionByName(earlier.join(touched, "image_id", "left_semi"))
        approved = state.refold_decisions(known).where("approved").select(F.col("image_id").alias("id"))
        pending = images.select("id", content).join(approved, "id", "left_semi").withColumnRenamed("id", "image_id")
        have = embeddings.where(F.col("model_version") == model_version).select("image_id")
        made = _stored(spark, folder, "vectors", base, before=batch_id)
        if made is not None:
            have = have.unionByName(made.where(F.col("error").isNull() & (F.col("model_version") == model_version)).select("image_id"))
        return encode(pending.join(have, "image_id", "left_anti"), "image_id", content, make_encoder, model_version)

    return embed


def run_available(stream: DataFrame, folder: str, checkpoint: str, routes: DataFrame | None = None, embed=None) -> None:
    """Fold everything that has arrived, then stop. `stream` yields review-log rows; a later call with the
    same checkpoint continues after the files already folded."""
    query = (
        stream.writeStream.foreachBatch(fold_batch(folder, routes, embed)).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def current_folds(spark: SparkSession, folder: str) -> DataFrame:
    """The folded state of all batches; needs at least one."""
    return state.refold_decisions(_stored(spark, folder, "folds", _base(spark, folder)))


def current_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(image_id, model_version, embedding, error) of all batches, empty where there are none."""
    found = _stored(spark, folder, "vectors", _base(spark, folder))
    return spark.createDataFrame([], VECTOR) if found is None else found


def compact(spark: SparkSession, folder: str, upto: int) -> None:
    """Write the state after micro-batch `upto` as a base, then let the pointer name it. Until then readers and the running
    stream use what they used before; a base is never written again, and a pointer never goes back."""
    base = _base(spark, folder)
    if base is not None and base >= upto:
        return
    target = f"{folder}/bases/upto={upto}"
    state.refold_decisions(_stored(spark, folder, "folds", base, before=upto + 1)).write.mode("overwrite").parquet(f"{target}/folds")
    vectors = _stored(spark, folder, "vectors", base, before=upto + 1)
    vectors = spark.createDataFrame([], VECTOR) if vectors is None else vectors
    vectors.write.mode("overwrite").parquet(f"{target}/vectors")
    spark.range(1).select(F.lit(upto).alias("upto")).write.mode("append").json(f"{folder}/pointer")


def current_images(images: DataFrame, folder: str) -> DataFrame:
    return state.apply_decisions(images, current_folds(images.sparkSession, folder))


def embed_approved(images: DataFrame, folder: str, embeddings: DataFrame, content: str, make_encoder, model_version: str):
    """(embeddings, failed rows) after encoding every image that the folded state shows as approved and that
    has no vector of this version, for images that were approved before the stream saw them. The vectors of the stream
    are among the embeddings. A second run finds nothing to do."""
    spark = images.sparkSession
    made, _ = split_results(current_vectors(spark, folder))
    have = embeddings.unionByName(made.where(F.col("model_version") == model_version).select(*embeddings.columns))
    return embed_pending(current_images(images, folder), have, content, make_encoder, model_version)
