"""Upserts, first-wins inserts, submissions, review folds and referential actions."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.operators import catalogue as C, rows, state as S
from talus.plans.queries.vector_jobs import letter_encoder
from talus.plans.registry import query
from talus.session import scratch
from talus.sources import files
from talus.streaming import intake


@query("K5 Z2", """
    SELECT image_id, model_version, round(embedding[1], 6) + 0.0 AS first_component FROM (
        SELECT image_id, model_version, embedding FROM image_embeddings WHERE label >= 5
        UNION ALL SELECT image_id, CASE WHEN label < 5 THEN 'v1' ELSE 'v2' END, list_transform(embedding, lambda x: -x) FROM image_embeddings)""")
def upserted_embeddings(c):
    existing = c.image_embeddings.drop("label")
    version = F.when(F.col("label") < 5, "v1").otherwise("v2")
    twice = c.image_embeddings.withColumn("model_version", version).withColumn("arrival", F.explode(F.array(F.lit(1), F.lit(2))))
    flipped = F.transform("embedding", lambda x: F.when(F.col("arrival") == 2, -x).otherwise(x * F.lit(2).cast("float")))
    incoming = twice.withColumn("embedding", flipped).drop("label")
    existing = existing.withColumn("arrival", F.lit(0))
    merged = rows.upsert(existing, incoming, ["image_id", "model_version"], F.col("arrival"))
    return merged.select("image_id", "model_version", F.round(F.col("embedding")[0].cast("double"), 6).alias("first_component"))


@query("K6", """
    SELECT route_image_id, filter_model_version, round(score, 6) AS score, score >= 0.8 AS passed FROM (
        SELECT route_image_id, filter_model_version, CASE WHEN keep THEN 1.0::DOUBLE - score ELSE score END AS score FROM filter_scores)""")
def upserted_scores(c):
    base = c.filter_scores.select("route_image_id", "filter_model_version", "score", (F.col("score") >= 0.8).alias("passed"))
    again = c.filter_scores.where("keep").withColumn("score", F.lit(1.0) - F.col("score")).select(
        "route_image_id", "filter_model_version", "score", (F.col("score") >= 0.8).alias("passed"))
    merged = rows.upsert(base, again, ["route_image_id", "filter_model_version"], F.col("score"))
    return merged.withColumn("score", F.round("score", 6))


@query("K7", """
    SELECT 'old' AS origin, c_custkey + 1 AS id, c_name AS url FROM customer
    UNION ALL SELECT 'new', (SELECT max(c_custkey) + 1 FROM customer) + row_number() OVER (ORDER BY first), url FROM (
        SELECT 'https://x/' || user_id AS url, min(event_id) AS first FROM events GROUP BY 1)""")
def first_wins_insert(c):
    existing = c.table("customer").select(F.lit("old").alias("origin"), (F.col("c_custkey") + 1).alias("id"), F.col("c_name").alias("url"))
    incoming = c.table("events").select(
        F.lit("new").alias("origin"), F.concat(F.lit("https://x/"), F.col("user_id").cast("string")).alias("url"), F.col("event_id").alias("arrival"))
    again = existing.select("origin", "url", F.lit(-1).cast("long").alias("arrival"))
    return S.insert_if_absent(existing, incoming.unionByName(again), "url", "arrival")


@query("K10 P14", """
    SELECT id, 'images/routes/' || route_id || '/' || id || '.jpg' AS b2_key, CASE WHEN source = 'admin' THEN 'approved' ELSE 'unreviewed' END AS status FROM images""")
def submitted_photos(c):
    return S.submissions(c.images).select("id", "b2_key", "status")


@query("K11 P9 P12", r"""
    SELECT s.event_id, regexp_replace(s.name, '^\s+|\s+$', '', 'g') AS name, CASE WHEN regexp_matches(s.name, '^\s*$') THEN 'name is empty'
           WHEN s.parent_id IS NOT NULL AND a.id IS NULL THEN 'parent area is not approved' END AS reason
    FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN chr(9) || chr(10) ELSE ' ' || event_type || chr(9) END AS name,
                 CASE WHEN event_type <> 'view' THEN 1000 + user_id * 2 END AS parent_id FROM events) s
    LEFT JOIN (SELECT id FROM areas WHERE status = 'approved') a ON a.id = s.parent_id""")
def suggested_areas(c):
    kind = F.col("event_type")
    suggestions = c.table("events").select(
        "event_id", F.when(kind == "error", "\t\n").otherwise(F.concat(F.lit(" "), kind, F.lit("\t"))).alias("name"),
        F.when(kind != "view", F.lit(1000) + F.col("user_id") * 2).alias("parent_id"))
    return S.area_suggestions(suggestions, c.areas).select("event_id", "name", "reason")


@query("K11 P9 P12", r"""
    SELECT s.event_id, s.name, regexp_replace(s.grade, '^\s+|\s+$', '', 'g') AS grade, CASE WHEN s.name = '' THEN 'name is empty' WHEN regexp_matches(s.grade, '^\s*$') THEN 'grade is empty'
           WHEN a.id IS NULL THEN 'area is not approved' END AS reason
    FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS name, CASE WHEN event_type = 'click' THEN ' ' || chr(10) ELSE ' 5.9' || chr(10) END AS grade,
                 1000 + user_id * 2 AS area_id FROM events) s
    LEFT JOIN (SELECT id FROM areas WHERE status = 'approved') a ON a.id = s.area_id""")
def suggested_routes(c):
    kind = F.col("event_type")
    suggestions = c.table("events").select(
        "event_id", F.when(kind == "error", "").otherwise(kind).alias("name"), F.when(kind == "click", " \n").otherwise(" 5.9\n").alias("grade"),
        (F.lit(1000) + F.col("user_id") * 2).alias("area_id"))
    return S.route_suggestions(suggestions, c.areas).select("event_id", "name", "grade", "reason")


DECISIONS = """
    SELECT image_id, ts, event_id, CASE WHEN channel = 'review' AND action = 'reject' THEN 'rejected' ELSE 'approved' END AS status,
           CASE WHEN channel = 'review' AND action = 'approve' THEN nullif(correct_route_id, 0)
                WHEN channel = 'feedback' AND NOT confirmed THEN correct_route_id END AS set_route FROM review_log
    WHERE (CASE WHEN channel = 'review' AND action = 'approve' THEN nullif(correct_route_id, 0)
                WHEN channel = 'feedback' AND NOT confirmed THEN correct_route_id END) IN (SELECT id FROM routes)
       OR (CASE WHEN channel = 'review' AND action = 'approve' THEN nullif(correct_route_id, 0)
                WHEN channel = 'feedback' AND NOT confirmed THEN correct_route_id END) IS NULL"""
FOLDED = """
    SELECT s.image_id, s.status, r.set_route FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY ts DESC, event_id DESC) AS rn FROM decisions) s
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY ts DESC, event_id DESC) AS rn FROM decisions WHERE set_route IS NOT NULL) r
    ON r.image_id = s.image_id AND r.rn = 1 WHERE s.rn = 1"""
REVIEWED = """
    SELECT i.id, coalesce(f.status, i.status) AS status, coalesce(f.set_route, i.route_id) AS route_id FROM images i LEFT JOIN folded f ON f.image_id = i.id"""


@query("K12 K13 W11", REVIEWED, decisions=DECISIONS, folded=FOLDED)
def reviewed_images(c):
    folded = S.fold_decisions(S.known_corrections(S.decisions_of(c.review_log), c.routes))
    return S.apply_decisions(c.images, folded).select("id", "status", "route_id")


def _folded_stream(c) -> str:
    """Run the review log through the file stream until everything has arrived; the folder of the intake."""
    base = scratch(c.spark, "intake")
    schema = c.table("events").schema
    arriving = type(c)(c.spark, c.folder)
    events = c.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(c.folder)
    arriving.table = lambda name: events if name == "events" else c.table(name)
    intake.run_available(arriving.review_log, base, f"{base}/progress", c.routes)
    return base


@query("G1 K12 K13", REVIEWED, decisions=DECISIONS, folded=FOLDED)
def streamed_review_state(c):
    """The same state through the file stream."""
    return intake.current_images(c.images, _folded_stream(c)).select("id", "status", "route_id")


LETTER_E = "round(((length(i.content) - length(replace(i.content, 'e', ''))) / length(i.content)::DOUBLE)::FLOAT::DOUBLE, 4)"


@query("G1 M10 J5", f"""
    SELECT i.id AS image_id, {LETTER_E} AS e
    FROM images i JOIN reviewed r ON r.id = i.id WHERE r.status = 'approved' AND i.id NOT IN (SELECT image_id FROM image_embeddings)""",
    decisions=DECISIONS, folded=FOLDED, reviewed=REVIEWED)
def embedded_after_intake(c):
    """Review events through the stream, then the embedding job over what became approved; the new vectors."""
    table, _ = intake.embed_approved(c.images, _folded_stream(c), c.image_embeddings.drop("label"), "content", letter_encoder, "v1")
    new = table.where(F.size("embedding") == 26)
    return new.select("image_id", F.round(F.col("embedding")[4].cast("double"), 4).alias("e"))


EVENT_FILES = 5  # the review log arrives in so many files, a micro-batch each


@query("G1 M10 J5 K12 A21", f"""
    SELECT i.id AS image_id, r.status, r.route_id, {LETTER_E} AS e
    FROM images i JOIN reviewed r ON r.id = i.id WHERE i.id IN (SELECT image_id FROM decisions) AND r.status = 'approved'
    AND i.id NOT IN (SELECT image_id FROM image_embeddings WHERE label < 4)""", decisions=DECISIONS, folded=FOLDED, reviewed=REVIEWED)
def intake_loop(c):
    """The intake in micro-batches of one file each, vectors made inside them. Between the first three and the rest the state
    is compacted, and a batch from before and one from after the compaction are replayed. Photos of some labels have a vector
    from earlier. The approved photos that the stream decided, with their new vectors."""
    base = scratch(c.spark, "intake-loop")
    events, arriving = c.table("events"), type(c)(c.spark, c.folder)
    ordered = events.withColumn("part", F.expr(f"cast(event_id % {EVENT_FILES} as int)"))
    embed = intake.embed_newly_approved(base, c.images, c.image_embeddings.where("label < 4"), "content", letter_encoder, "v1")

    def arrive(part: int) -> None:
        ordered.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(f"{base}/events")

    def run() -> None:
        stream = c.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/events")
        arriving.table = lambda name: stream if name == "events" else c.table(name)
        arriving.__dict__.pop("review_log", None)
        intake.run_available(arriving.review_log, base, f"{base}/progress", c.routes, embed)

    def replay(batch_id: int) -> None:
        held = type(c)(c.spark, c.folder)
        held.table = lambda name: ordered.where(F.col("part") == batch_id) if name == "events" else c.table(name)
        intake.fold_batch(base, c.routes, embed)(held.review_log, batch_id)

    for part in range(3):
        arrive(part)
    run()
    intake.compact(c.spark, base, 1)
    for part in range(3, EVENT_FILES):
        arrive(part)
    run()
    replay(0)
    replay(EVENT_FILES - 1)
    vectors = intake.current_vectors(c.spark, base).where(F.col("error").isNull())
    state = intake.current_images(c.images, base).where(F.col("status") == "approved")
    return state.select(F.col("id").alias("image_id"), "status", "route_id").join(vectors, "image_id").select(
        "image_id", "status", "route_id", F.round(F.col("embedding")[4].cast("double"), 4).alias("e"))


def misspelt():
    """The action of a review row; every third is not a known one and must not decide anything."""
    return F.when(F.col("seq.event_id") % 3 == 0, "aprove").otherwise(F.col("action")).alias("action")


@query("K12 Z11", """
    SELECT a.id, CASE WHEN a.status = 'unreviewed' AND d.action IS NOT NULL THEN CASE WHEN d.action = 'approve' THEN 'approved' ELSE 'rejected' END ELSE a.status END AS status
    FROM areas a LEFT JOIN (SELECT 1000 + image_id AS id, arg_min(action, event_id) AS action FROM review_log WHERE channel = 'review' AND event_id % 3 <> 0 GROUP BY 1) d ON d.id = a.id""")
def reviewed_areas(c):
    decisions = c.review_log.where(F.col("channel") == "review").select(
        (F.lit(1000) + F.col("image_id")).alias("id"), misspelt(), F.col("seq.event_id").alias("seq"))
    return S.first_decisions(c.areas, decisions).select("id", "status")


@query("K12", """
    SELECT r.id, CASE WHEN r.status = 'unreviewed' AND d.action IS NOT NULL THEN CASE WHEN d.action = 'approve' THEN 'approved' ELSE 'rejected' END ELSE r.status END AS status
    FROM routes r LEFT JOIN (SELECT image_id AS id, arg_min(action, event_id) AS action FROM review_log WHERE channel = 'review' AND event_id % 3 <> 0 GROUP BY 1) d ON d.id = r.id""")
def reviewed_routes(c):
    decisions = c.review_log.where(F.col("channel") == "review").select(F.col("image_id").alias("id"), misspelt(), F.col("seq.event_id").alias("seq"))
    return S.first_decisions(c.routes, decisions).select("id", "status")


@query("P12", """
    SELECT event_id, o_orderkey FROM (SELECT event_id, (value * 1000)::BIGINT AS o_orderkey FROM events) e WHERE o_orderkey NOT IN (SELECT id FROM routes)""")
def decisions_on_unknown_routes(c):
    events = c.table("events").select("event_id", F.round(F.col("value") * 1000).cast("long").alias("o_orderkey"))
    return S.unknown_targets(events, c.routes, "o_orderkey").select("event_id", "o_orderkey")


@query("P9 Z11", """
    SELECT channel, count(*) AS n, sum(CASE WHEN channel = 'feedback' AND NOT confirmed AND correct_route_id IS NULL THEN 1 ELSE 0 END)::BIGINT AS refused FROM review_log GROUP BY 1""")
def refused_decisions(c):
    problem = F.when(F.col("channel") == "review", S.decision_problem("review")).otherwise(S.decision_problem("feedback"))
    return c.review_log.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.count_if(problem.isNotNull()).alias("refused"))


@query("P9", """
    SELECT doc_id, CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'unsupported content type' WHEN n_chars * 1000 > 10485760 THEN 'file too large' END AS reason FROM documents""")
def upload_checks(c):
    kinds = F.when(F.col("lang") == "en", S.CONTENT_TYPES[0]).when(F.col("lang") == "de", S.CONTENT_TYPES[1]).when(F.col("lang") == "fr", S.CONTENT_TYPES[2])
    rows_ = c.table("documents").select("doc_id", kinds.alias("content_type"), (F.col("n_chars") * 1000).alias("size"))
    return rows_.select("doc_id", S.submission_problem().alias("reason"))


@query("K14", """
    SELECT i.id, r.id AS route_id FROM images i LEFT JOIN routes r ON r.id = i.route_id AND r.status <> 'rejected'""")
def photos_after_route_deletes(c):
    left = c.routes.where(F.col("status") != "rejected")
    return S.drop_route_links(c.images, left).select("id", "route_id")


@query("K14", """
    SELECT e.image_id, e.model_version FROM image_embeddings e JOIN images i ON i.id = e.image_id AND i.status <> 'rejected'""")
def vectors_after_photo_deletes(c):
    left = c.images.where(F.col("status") != "rejected")
    return S.drop_orphans(c.image_embeddings, left, "image_id").select("image_id", "model_version")


@query("K14", "SELECT s.route_image_id, s.filter_model_version FROM filter_scores s JOIN (SELECT id FROM route_images WHERE length(content) > 500) i ON i.id = s.route_image_id")
def scores_after_photo_deletes(c):
    left = c.route_images.where(F.length("content") > 500)
    return S.drop_orphans(c.filter_scores, left, "route_image_id").select("route_image_id", "filter_model_version")


@query("K2 U3", "SELECT keep, count(*) AS n FROM filter_scores GROUP BY 1")
def appended_results(c):
    path = scratch(c.spark, "results")
    files.append_rows(c.filter_scores.where("keep"), path)
    files.append_rows(c.filter_scores.where(~F.col("keep")), path)
    return c.spark.read.parquet(path).groupBy("keep").agg(F.count(F.lit(1)).alias("n"))


@query("K5", "SELECT model_version, count(*) AS n FROM (SELECT CASE WHEN label < 5 THEN 'v1' ELSE 'v2' END AS model_version FROM embeddings) GROUP BY 1")
def versioned_rewrite(c):
    path = scratch(c.spark, "versions")
    version = F.when(F.col("label") < 5, "v1").otherwise("v2")
    files.write_versioned(c.image_embeddings.withColumn("model_version", version), path)
    again = c.spark.read.parquet(path).where(F.col("model_version") == "v2")
    files.write_versioned(again, path + "-next")
    files.write_versioned(c.image_embeddings.where(F.col("label") < 5), path + "-next")
    return c.spark.read.parquet(path + "-next").groupBy("model_version").agg(F.count(F.lit(1)).alias("n"))


@query("K5", """
    SELECT model_version, image_id, round(CASE WHEN image_id % 4 = 1 AND model_version = 'v2' THEN 7 * embedding[1] ELSE embedding[1] END, 4) + 0.0 AS first FROM (
        SELECT CASE WHEN label < 3 THEN 'v1' WHEN label < 7 THEN 'v2' ELSE 'v3' END AS model_version, image_id, embedding FROM image_embeddings)
    UNION ALL SELECT 'v2', -1 - image_id, round(7 * embedding[1], 4) + 0.0 FROM image_embeddings WHERE image_id % 10 = 0""")
def upserted_versions(c):
    """A stored table of three versions; of one of them a quarter is replaced and a tenth of all photos is added."""
    path = scratch(c.spark, "version-table")
    version = F.when(F.col("label") < 3, "v1").when(F.col("label") < 7, "v2").otherwise("v3")
    stored = c.image_embeddings.select("image_id", version.alias("model_version"), "embedding")
    files.write_versioned(stored, path)
    again = F.transform("embedding", lambda x: (x * 7).cast("float")).alias("embedding")
    changed = stored.where("model_version = 'v2' AND image_id % 4 = 1").select("image_id", "model_version", again)
    added = stored.where("image_id % 10 = 0").select((-1 - F.col("image_id")).alias("image_id"), F.lit("v2").alias("model_version"), again)
    files.upsert_versions(c.spark, path, changed.unionByName(added), ["image_id"], F.col("image_id"))
    first = F.round(F.col("embedding")[0].cast("double"), 4)
    return c.spark.read.parquet(path).select("model_version", "image_id", first.alias("first"))


@query("P9", """
    SELECT event_id, CASE WHEN event_type NOT IN ('view', 'click') THEN 'unknown source' WHEN event_type = 'click' THEN 'unknown status' END AS reason FROM events""")
def domain_checks(c):
    """Events with their type read as a source and a status."""
    kind = F.col("event_type")
    rows_ = c.table("events").select(
        "event_id", F.when(kind == "view", "admin").when(kind == "click", "user").otherwise(kind).alias("source"),
        F.when(kind == "view", "approved").alias("status"))
    return rows_.select("event_id", S.domain_problem().alias("reason"))
