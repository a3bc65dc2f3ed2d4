"""Review workflow as folds over event logs.

Tables are immutable files, so a state change is an event and the current state is an aggregate of events.
Every fold is a grouped maximum or minimum: it combines inside tasks, and partial folds can be folded again,
which is what the streaming intake stores per micro-batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from talus.functions.text import strip
from talus.operators.ordering import global_rank
from talus.operators.rows import first_per_key

# Enum domains and submission limits.
STATUSES = ["unreviewed", "approved", "rejected"]
SOURCES = ["mp_scraped", "user", "admin"]
ACTIONS = ["approve", "reject"]
CONTENT_TYPES = ["image/jpeg", "image/png", "image/webp"]
MAX_UPLOAD_BYTES = 10 * 1024 * 1024


def blank(column: Column) -> Column:
    return column.isNull() | (strip(column) == "")


def review_decisions(events: DataFrame) -> DataFrame:
    """Review rows (image_id, seq, action, correct_route_id) as decisions. A correction applies only to an
    approval, and 0 means none. Unknown actions are no decisions."""
    return events.where(F.col("action").isin(ACTIONS)).select("image_id", "seq", _approves(), _review_route().alias("set_route"))


def feedback_decisions(events: DataFrame) -> DataFrame:
    """Feedback rows (image_id, seq, confirmed, correct_route_id): both forms approve, the unconfirmed one
    also moves the image to the given route."""
    return events.select("image_id", "seq", F.lit(True).alias("approved"), _feedback_route().alias("set_route"))


def decisions_of(events: DataFrame) -> DataFrame:
    """Applicable decisions of a log with both channels (channel 'review' or 'feedback'), in one pass."""
    review = F.col("channel") == "review"
    problem = F.when(review, decision_problem("review")).otherwise(decision_problem("feedback"))
    return events.where(F.col("channel").isin("review", "feedback") & problem.isNull()).select(
        "image_id", "seq", (~review | (F.col("action") == "approve")).alias("approved"),
        F.when(review, _review_route()).otherwise(_feedback_route()).alias("set_route"),
    )


def _approves():
    return (F.col("action") == "approve").alias("approved")


def _review_route():
    return F.when((F.col("action") == "approve") & (F.col("correct_route_id") != 0), F.col("correct_route_id"))


def _feedback_route():
    return F.when(~F.col("confirmed"), F.col("correct_route_id"))


def decision_problem(channel: str):
    """Reason column for events that cannot be applied (NULL where fine)."""
    if channel == "review":
        return F.when(outside(F.col("action"), ACTIONS), "unknown action")
    missing = F.coalesce(~F.col("confirmed"), F.lit(True)) & F.col("correct_route_id").isNull()
    return F.when(missing, "route is missing")


def known_corrections(decisions: DataFrame, routes: DataFrame) -> DataFrame:
    """Decisions without a correction, or with one to a route that exists. The others change nothing at all, as their
    update breaks the reference from images to routes."""
    moved = F.col("set_route").isNotNull()
    known = decisions.where(moved).join(routes.select(F.col("id").alias("set_route")), "set_route", "left_semi")
    return decisions.where(~moved).unionByName(known)


def fold_decisions(decisions: DataFrame) -> DataFrame:
    """One row per image: last status, last correction and their sequence numbers. `seq` is anything that
    orders; with a number all buffers are fixed-width and Spark aggregates by hash instead of by sort."""
    moved = F.col("set_route").isNotNull()
    return decisions.groupBy("image_id").agg(
        F.max_by("approved", "seq").alias("approved"),
        F.max_by("set_route", F.when(moved, F.col("seq"))).alias("set_route"),
        F.max("seq").alias("seq"),
        F.max(F.when(moved, F.col("seq"))).alias("route_seq"),
    )


def refold_decisions(folds: DataFrame) -> DataFrame:
    """Merge partial folds (for instance one per micro-batch)."""
    return folds.groupBy("image_id").agg(
        F.max_by("approved", "seq").alias("approved"),
        F.max_by("set_route", "route_seq").alias("set_route"),
        F.max("seq").alias("seq"),
        F.max("route_seq").alias("route_seq"),
    )


def apply_decisions(images: DataFrame, folded: DataFrame) -> DataFrame:
    """Images with their current status and route."""
    status = F.when(F.col("approved"), "approved").otherwise("rejected")
    state = folded.select(F.col("image_id").alias("id"), status.alias("_status"), F.col("set_route").alias("_route"))
    return (
        images.join(state, "id", "left")
        .withColumn("status", F.coalesce("_status", "status"))
        .withColumn("route_id", F.coalesce("_route", "route_id"))
        .drop("_status", "_route")
    )


def unknown_targets(events: DataFrame, rows: DataFrame, event_key: str, row_key: str = "id") -> DataFrame:
    """Events that name a row which does not exist."""
    return events.join(rows.select(F.col(row_key).alias(event_key)), event_key, "left_anti")


def first_decisions(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Areas or routes with their status after review: only an unreviewed row can be decided, and only the
    first decision (id, seq, action) counts. Unknown actions are refused before that."""
    first = decisions.where(F.col("action").isin(ACTIONS)).groupBy("id").agg(F.min_by("action", "seq").alias("_action"))
    decided = F.when(F.col("_action") == "approve", "approved").when(F.col("_action").isNotNull(), "rejected")
    changed = F.when(F.col("status") == "unreviewed", F.coalesce(decided, F.col("status"))).otherwise(F.col("status"))
    return rows.join(first, "id", "left").withColumn("status", changed).drop("_action")


def outside(column: Column, domain: list[str]) -> Column:
    """True for a value that is missing or not in the domain."""
    return F.coalesce(~column.isin(domain), F.lit(True))


def domain_problem(source: str = "source", status: str = "status") -> Column:
    """Reason column for rows whose source or status is not a known value."""
    return F.when(outside(F.col(source), SOURCES), "unknown source").when(outside(F.col(status), STATUSES), "unknown status")


def submission_problem(content_type: str = "content_type", size: str = "size"):
    return (
        F.when(outside(F.col(content_type), CONTENT_TYPES), "unsupported content type")
        .when(F.col(size) > MAX_UPLOAD_BYTES, "file too large")
    )


def submissions(rows: DataFrame) -> DataFrame:
    """New photo rows (id, route_id, source, submitted_by): storage key and starting status."""
    key = F.concat(F.lit("images/routes/"), F.col("route_id").cast("string"), F.lit("/"), F.col("id").cast("string"), F.lit(".jpg"))
    return rows.select(
        "id", "route_id", "source", key.alias("b2_key"),
        F.when(F.col("source") == "admin", "approved").otherwise("unreviewed").alias("status"), "submitted_by",
    )


def _with_approved(rows: DataFrame, areas: DataFrame, key: str, flag: str) -> DataFrame:
    known = areas.where(F.col("status") == "approved").select(F.col("id").alias(key), F.lit(True).alias(flag))
    return rows.join(known, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def area_suggestions(rows: DataFrame, areas: DataFrame) -> DataFrame:
    """Suggested areas (name, parent_id, ...) with trimmed name, status 'unreviewed' and a reason column; rows
    with a reason are refused."""
    checked = _with_approved(rows, areas, "parent_id", "_known")
    reason = F.when(blank(F.col("name")), "name is empty").when(
        F.col("parent_id").isNotNull() & ~F.col("_known"), "parent area is not approved"
    )
    return checked.withColumn("reason", reason).withColumn("name", strip(F.col("name"))).withColumn("status", F.lit("unreviewed")).drop("_known")


def route_suggestions(rows: DataFrame, areas: DataFrame) -> DataFrame:
    checked = _with_approved(rows, areas, "area_id", "_known")
    reason = (
        F.when(blank(F.col("name")), "name is empty")
        .when(blank(F.col("grade")), "grade is empty")
        .when(~F.col("_known"), "area is not approved")
    )
    return (
        checked.withColumn("reason", reason).withColumn("name", strip(F.col("name"))).withColumn("grade", strip(F.col("grade")))
        .withColumn("status", F.lit("unreviewed")).drop("_known")
    )


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: str, arrival: str, id: str = "id") -> DataFrame:
    """Existing rows plus the first incoming row of each new natural key. New ids continue the existing ones
    in arrival order; an existing row is never changed."""
    fresh = first_per_key(incoming, [key], F.col(arrival)).join(existing.select(key), key, "left_anti")
    numbered = global_rank(fresh, [arrival, key], name="_n")
    last = existing.agg(F.coalesce(F.max(id), F.lit(0)).alias("m")).scalar()
    new = numbered.withColumn(id, (last + F.col("_n")).cast("long")).select(*existing.columns)
    return existing.unionByName(new)


def drop_route_links(images: DataFrame, routes: DataFrame) -> DataFrame:
    """SET NULL: photos of routes that no longer exist lose their route."""
    live = routes.select(F.col("id").alias("route_id"), F.lit(True).alias("_live"))
    return images.join(live, "route_id", "left").withColumn(
        "route_id", F.when(F.col("_live"), F.col("route_id"))
    ).drop("_live")


def drop_orphans(children: DataFrame, parents: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """CASCADE: children whose parent row is gone are removed."""
    return children.join(parents.select(F.col(parent_key).alias(key)), key, "left_semi")
