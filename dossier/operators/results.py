"""Durable results: write classes, revisions, hashes, review leases and job runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITEM = ["job_id", "item_id"]
TERMINAL = ("succeeded", "failed", "review_required", "incomplete")


def classify_writes(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """new / identical / definition_mismatch / conflict per incoming result.

    Both: job_id, item_id, definition_hash, payload_hash.
    """
    old = store.select(*ITEM, F.col("definition_hash").alias("__def"), F.col("payload_hash").alias("__hash"))
    joined = incoming.join(old, ITEM, "left")
    return joined.select(
        *ITEM,
        F.when(F.col("__def").isNull(), "new")
        .when(F.col("__def") != F.col("definition_hash"), "definition_mismatch")
        .when(F.col("__hash") == F.col("payload_hash"), "identical")
        .otherwise("conflict")
        .alias("outcome"),
    )


def apply_revisions(store: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new store, outcome per update): only updates that expect the stored revision are applied.

    store: job_id, item_id, definition_hash, payload_hash, revision; updates: the same keys,
    definition_hash, payload_hash, expected_revision.
    """
    wanted = updates.select(
        *ITEM, F.col("definition_hash").alias("__def"), F.col("payload_hash").alias("__hash"), "expected_revision"
    )
    joined = store.withColumn("__stored", F.lit(True)).join(wanted, ITEM, "full_outer")
    outcome = (
        F.when(F.col("__stored").isNull(), "not_found")
        .when(F.col("expected_revision") != F.col("revision"), "revision_conflict")
        .when(F.col("__def") != F.col("definition_hash"), "definition_mismatch")
        .otherwise("applied")
    )
    asked = F.col("expected_revision").isNotNull()
    marked = joined.withColumn("outcome", F.when(asked, outcome))
    applied = F.coalesce(F.col("outcome") == "applied", F.lit(False))
    new_store = marked.where("__stored").select(
        *ITEM,
        "definition_hash",
        F.when(applied, F.col("__hash")).otherwise(F.col("payload_hash")).alias("payload_hash"),
        (F.col("revision") + applied.cast("int")).alias("revision"),
    )
    return new_store, marked.where(asked).select(*ITEM, "outcome")


def payload_hash(payload: Column) -> Column:
    """sha256 of the payload's JSON; the struct's fields must be in alphabetical order."""
    return F.sha2(F.to_json(payload, {"ignoreNullFields": "false"}), 256)


def verify_payload_hash(results: DataFrame) -> DataFrame:
    return results.select(*ITEM, (payload_hash(F.col("payload")) == F.col("payload_hash")).alias("intact"))


def lease_state(events: DataFrame, now: Column) -> DataFrame:
    """Current lease per item, folded from its review log.

    events: job_id, item_id, event_id, action (claimed / taken_over / renewed / released /
    completed), reviewer_id, at, ttl (seconds). A release or completion removes the lease; the
    events after it number its revisions. Two partial aggregations, joined on the item.
    """
    when = F.struct("at", "event_id")
    ends = F.col("action").isin("released", "completed")
    last = events.groupBy(*ITEM).agg(
        F.max(F.when(ends, when)).alias("ended"),
        F.max_by("action", when).alias("last_action"),
    )
    live = events.join(last, ITEM).where(F.col("ended").isNull() | (F.struct("at", "event_id") > F.col("ended")))
    taken = F.col("action").isin("claimed", "taken_over")
    lease = live.groupBy(*ITEM).agg(
        F.max_by("reviewer_id", when).alias("reviewer_id"),
        F.count("*").alias("revision"),
        F.coalesce(F.max(F.when(taken, F.col("at"))), F.min("at")).alias("claimed_at"),
        F.max_by(F.col("at") + F.col("ttl"), when).alias("expires_at"),
    )
    joined = last.join(lease, ITEM, "left")
    return joined.select(
        *ITEM,
        "last_action",
        "reviewer_id",
        F.coalesce("revision", F.lit(0)).alias("revision"),
        "claimed_at",
        "expires_at",
        F.coalesce(now < F.col("expires_at"), F.lit(False)).alias("active"),
    )


def pending_reviews(results: DataFrame, leases: DataFrame, include_claimed: bool = False) -> DataFrame:
    """Results that need review, without (or with) those under an active lease."""
    joined = results.where(F.col("status") == "review_required").join(
        leases.select(*ITEM, "reviewer_id", "active"), ITEM, "left"
    )
    marked = joined.withColumn("available", ~F.coalesce("active", F.lit(False))).drop("active")
    return marked if include_claimed else marked.where("available")


def review_history(events: DataFrame, job_id=None, item_id=None) -> DataFrame:
    """The log of a job or item by time, then event id."""
    if job_id is not None:
        events = events.where(F.col("job_id") == job_id)
    if item_id is not None:
        events = events.where(F.col("item_id") == item_id)
    return events.orderBy("at", "event_id")


def duplicate_events(events: DataFrame) -> DataFrame:
    """Event ids that occur more than once."""
    return events.groupBy("event_id").agg(F.count("*").alias("times")).where("times > 1")


def resume_items(job: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Items still to run: everything not terminal; a running item counts as pending.

    job: job_id, item_id; checkpoint: job_id, item_id, status.
    """
    done = checkpoint.where(F.col("status").isin(*TERMINAL)).select(*ITEM)
    return (
        job.join(done, ITEM, "left_anti")
        .join(checkpoint.select(*ITEM, "status"), ITEM, "left")
        .select(*ITEM, F.lit("pending").alias("status"), F.coalesce("status", F.lit("pending")).alias("stored_status"))
    )


def checkpoint_mismatch(job: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Jobs whose stored checkpoint has other items or another definition (job_id, item_id, definition_hash)."""
    a = job.select(*ITEM, F.col("definition_hash").alias("__job"))
    b = checkpoint.select(*ITEM, F.col("definition_hash").alias("__stored"))
    known = b.select("job_id").distinct()
    joined = a.join(known, "job_id", "left_semi").join(b, ITEM, "full_outer")
    return (
        joined.groupBy("job_id")
        .agg(
            F.count_if(F.col("__job").isNull() | F.col("__stored").isNull()).alias("different_items"),
            F.count_if(F.col("__job") != F.col("__stored")).alias("different_definitions"),
        )
        .where("different_items > 0 OR different_definitions > 0")
    )


def job_summary(items: DataFrame) -> DataFrame:
    """Counts and overall status per job."""
    count = lambda s: F.count_if(F.col("status") == s)
    per = items.groupBy("job_id").agg(
        F.count("*").alias("items"),
        F.count_if(~F.col("status").isin(*TERMINAL)).alias("pending"),
        *[count(s).alias(s) for s in TERMINAL],
    )
    return per.withColumn(
        "job_status",
        F.when(F.col("pending") > 0, "partial")
        .when(F.col("failed") > 0, "completed_with_failures")
        .when(F.col("review_required") + F.col("incomplete") > 0, "needs_attention")
        .otherwise("succeeded"),
    )


def record_set_completeness(manifests: DataFrame, records: DataFrame) -> DataFrame:
    """Missing and repeated ids per manifest (job_id, item_id, record_ids)."""
    wanted = manifests.select(*ITEM, F.explode("record_ids").alias("record_id"))
    repeated = (
        wanted.groupBy(*ITEM, "record_id").count().where("count > 1").groupBy(*ITEM).agg(F.count("*").alias("repeated"))
    )
    missing = (
        wanted.join(records.select(*ITEM, "record_id"), [*ITEM, "record_id"], "left_anti").groupBy(*ITEM).agg(F.count("*").alias("missing"))
    )
    joined = manifests.select(*ITEM, F.size("record_ids").alias("expected")).join(repeated, ITEM, "left").join(missing, ITEM, "left")
    return joined.na.fill(0, ["repeated", "missing"]).withColumn(
        "complete", (F.col("repeated") == 0) & (F.col("missing") == 0)
    )
