import datetime as dt

import pytest
from pyspark.sql import functions as F

from talus.operators import curation as K, rows as R, state as S
from talus.plans import embed_job
from talus.streaming import intake

LOG = "image_id long, seq struct<ts: timestamp_ntz, event_id: long>, channel string, action string, confirmed boolean, correct_route_id long"


def log(spark, *events):
    start = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, (start + dt.timedelta(minutes=n), n), *rest) for n, (i, *rest) in enumerate(events)], LOG)


def images(spark):
    return spark.createDataFrame([(1, 10, "unreviewed"), (2, 20, "unreviewed"), (3, None, "approved"), (4, 40, "unreviewed")], "id long, route_id long, status string")


EVENTS = [
    (1, "review", "approve", None, 77), (1, "review", "approve", None, None),      # a plain approval keeps the correction
    (2, "review", "approve", None, None), (2, "review", "reject", None, 99),       # a rejection moves nothing
    (3, "feedback", None, False, 5), (3, "review", "approve", None, 0),            # 0 means none in a review
    (4, "feedback", None, False, None), (4, "review", "later", None, None),        # both refused
]
EXPECTED = {(1, 77, "approved"), (2, 20, "rejected"), (3, 5, "approved"), (4, 40, "unreviewed")}


def as_set(df):
    return {(r["id"], r["route_id"], r["status"]) for r in df.select("id", "route_id", "status").collect()}


def test_fold(spark):
    decisions = S.decisions_of(log(spark, *EVENTS))
    assert as_set(S.apply_decisions(images(spark), S.fold_decisions(decisions))) == EXPECTED


@pytest.mark.parametrize("cut", range(1, 6))
def test_folds_of_folds(spark, cut):
    decisions = S.decisions_of(log(spark, *EVENTS))
    early = S.fold_decisions(decisions.where(F.col("seq.event_id") < cut))
    late = S.fold_decisions(decisions.where(F.col("seq.event_id") >= cut))
    assert as_set(S.apply_decisions(images(spark), S.refold_decisions(late.unionByName(early)))) == EXPECTED


def test_only_the_first_decision_on_an_area_counts(spark):
    areas = spark.createDataFrame([(1, "unreviewed"), (2, "approved"), (3, "unreviewed")], "id long, status string")
    decisions = spark.createDataFrame([(1, "reject", 1), (1, "approve", 2), (2, "reject", 3)], "id long, action string, seq long")
    assert {tuple(r) for r in S.first_decisions(areas, decisions).select("id", "status").collect()} == {(1, "rejected"), (2, "approved"), (3, "unreviewed")}


def test_stream_resumes_and_replays_safely(spark, tmp_path):
    source, folds, progress = (str(tmp_path / n) for n in ("in", "folds", "progress"))
    everything = log(spark, *EVENTS)
    stream = lambda: spark.readStream.schema(everything.schema).parquet(source)
    everything.where(F.col("seq.event_id") < 3).write.parquet(source)
    intake.run_available(stream(), folds, progress)
    everything.where(F.col("seq.event_id") >= 3).write.mode("append").parquet(source)
    intake.run_available(stream(), folds, progress)
    assert as_set(intake.current_images(images(spark), folds)) == EXPECTED
    intake.run_available(stream(), folds, progress)                      # nothing new
    intake.fold_batch(folds)(everything.where(F.col("seq.event_id") < 3), 0)  # a replayed batch
    assert as_set(intake.current_images(images(spark), folds)) == EXPECTED
    intake.compact(spark, folds, 0)                                       # the stream's second batch comes after it
    assert as_set(intake.current_images(images(spark), folds)) == EXPECTED
    intake.compact(spark, folds, 1)
    assert as_set(intake.current_images(images(spark), folds)) == EXPECTED
    intake.fold_batch(folds)(everything.where(F.col("seq.event_id") < 0), 0)  # what is in the base is not read again
    intake.compact(spark, folds, 0)                                       # a pointer never goes back
    assert as_set(intake.current_images(images(spark), folds)) == EXPECTED


def test_insert_if_absent_is_stable(spark):
    existing = spark.createDataFrame([(5, "a", "old")], "id long, url string, name string")
    incoming = spark.createDataFrame([("b", "first", 2), ("b", "second", 3), ("a", "new", 1), ("c", "x", 0)], "url string, name string, pos long")
    once = S.insert_if_absent(existing, incoming, "url", "pos")
    assert {tuple(r) for r in once.collect()} == {(5, "a", "old"), (6, "c", "x"), (7, "b", "first")}
    assert {tuple(r) for r in S.insert_if_absent(once, incoming, "url", "pos").collect()} == {tuple(r) for r in once.collect()}


def test_upsert_twice_changes_nothing(spark):
    existing = spark.createDataFrame([(1, "v1", 1.0), (2, "v1", 2.0)], "id long, model_version string, x double")
    incoming = spark.createDataFrame([(2, "v1", 9.0), (2, "v2", 8.0), (2, "v1", 7.0)], "id long, model_version string, x double")
    once = R.upsert(existing, incoming, ["id", "model_version"], F.col("x"))
    twice = R.upsert(once, incoming, ["id", "model_version"], F.col("x"))
    assert {tuple(r) for r in once.collect()} == {tuple(r) for r in twice.collect()} == {(1, "v1", 1.0), (2, "v1", 9.0), (2, "v2", 8.0)}


def test_last_metadata_row_and_first_photo_win(spark):
    photos = spark.createDataFrame([(0, "u", "h1"), (1, "w", "h1"), (2, "u2", "h2"), (3, "s", "h9")], "id long, url string, digest string")
    metadata = spark.createDataFrame([("u", "r1", 0), ("u", "r2", 1), ("u2", "r3", 2)], "url string, route string, pos long")
    seen = spark.createDataFrame([("h9",)], "digest string")
    kept = R.first_by_hash(photos, "digest", "id", seen)
    assert {r["id"] for r in kept.collect()} == {0, 2}
    assert {(r["id"], r["route"]) for r in K.last_metadata(kept, metadata, "url", "pos").collect()} == {(0, "r2"), (2, "r3")}


def test_embed_job_reports_failures_and_is_idempotent(spark):
    def make():
        def encode(texts):
            if "bad" in texts:
                raise ValueError("no")
            return [[float(len(text)), 1.0] for text in texts]
        return encode

    rows = spark.createDataFrame([(1, "approved", "abc"), (2, "approved", "bad"), (3, "unreviewed", "x"), (4, "approved", "done")], "id long, status string, content string")
    have = spark.createDataFrame([(4, "v1", [9.0, 9.0])], "image_id long, model_version string, embedding array<float>")
    table, failed = embed_job.embed_pending(rows, have, "content", make, "v1")
    state = {(r["image_id"], tuple(r["embedding"])) for r in table.collect()}
    assert state == {(1, (3.0, 1.0)), (4, (9.0, 9.0))}
    assert [r["error"] for r in failed.collect()] == ["ValueError: no"]
    again, _ = embed_job.embed_pending(rows, table, "content", make, "v1")
    assert {(r["image_id"], tuple(r["embedding"])) for r in again.collect()} == state
