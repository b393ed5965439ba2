"""Change detection, refresh state, retention and collection statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_INTERVAL = 300


def detect_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """unchanged / changed / new / missing per resource_id by content_hash."""
    before = old.select("resource_id", F.col("content_hash").alias("previous_hash"))
    after = new.select("resource_id", F.col("content_hash").alias("current_hash"))
    joined = before.join(after, "resource_id", "full_outer")
    return joined.select(
        "resource_id",
        "previous_hash",
        "current_hash",
        F.when(F.col("previous_hash").isNull(), "new")
        .when(F.col("current_hash").isNull(), "missing")
        .when(F.col("previous_hash") == F.col("current_hash"), "unchanged")
        .otherwise("changed")
        .alias("outcome"),
    )


def due_resources(resources: DataFrame, now: Column, k: int | None = None) -> DataFrame:
    """Resources whose next refresh time has come, oldest first; the first ``k`` of them when given."""
    due = resources.where(F.col("next_refresh_at").isNotNull() & (F.col("next_refresh_at") <= now))
    due = due.orderBy("next_refresh_at", "resource_id")
    return due if k is None else due.limit(k)


def refresh_state(
    runs: DataFrame, interval_seconds: int = 86_400, missing_after: int = 3, enabled: bool = True, strict: bool = False
) -> DataFrame:
    """Current refresh state per resource from its run log.

    runs: resource_id, run_id, at (timestamp), outcome (changed / unchanged / error). An
    error adds to the failure count; a changed run clears it (with ``strict`` an unchanged run
    does as well). Both passes are partial aggregations; the join back is on the key, where
    the adaptive planner splits a resource that owns many runs.
    """
    if interval_seconds < MIN_INTERVAL or missing_after < 1:
        raise ValueError("interval must be at least 300 seconds and missing_after positive")
    when = F.struct("at", "run_id")
    clears = F.col("outcome").isin("changed", "unchanged") if strict else F.col("outcome") == "changed"
    last = runs.groupBy("resource_id").agg(
        F.max_by("outcome", when).alias("last_outcome"),
        F.max("at").alias("last_at"),
        F.max(F.when(F.col("outcome") != "error", F.col("at"))).alias("last_seen_at"),
        F.max(F.when(clears, when)).alias("cleared"),
        F.count("*").alias("runs"),
    )
    failures = (
        runs.where(F.col("outcome") == "error")
        .join(last.select("resource_id", "cleared"), "resource_id")
        .where(F.col("cleared").isNull() | (F.struct("at", "run_id") > F.col("cleared")))
        .groupBy("resource_id")
        .agg(F.count("*").alias("failures"))
    )
    joined = last.join(failures, "resource_id", "left").na.fill(0, ["failures"])
    next_at = F.col("last_at") + F.make_dt_interval(secs=F.lit(interval_seconds))
    return joined.select(
        "resource_id",
        "runs",
        "failures",
        F.when(F.col("last_outcome") != "error", "ready")
        .when(F.col("failures") >= missing_after, "stale")
        .otherwise("refresh_error")
        .alias("status"),
        "last_seen_at",
        (next_at if enabled else F.lit(None).cast("timestamp_ntz")).alias("next_refresh_at"),
    )


def refresh_history(runs: DataFrame, resource_id, k: int | None = None) -> DataFrame:
    """Runs of one resource, newest first; the first ``k`` of them when given."""
    found = runs.where(F.col("resource_id") == resource_id).orderBy(F.desc("at"), F.desc("run_id"))
    return found if k is None else found.limit(k)


def expired_resources(resources: DataFrame, policies: DataFrame, now: Column) -> DataFrame:
    """Resources last seen before their collection's cutoff (policies: collection_id, max_age_days)."""
    checked = policies.withColumn(
        "max_age_days",
        F.when(F.col("max_age_days") < 1, F.raise_error(F.lit("max_age_days must be positive"))).otherwise(
            F.col("max_age_days")
        ),
    )
    cutoff = now - F.make_dt_interval(days=F.col("max_age_days"))
    return resources.join(checked, "collection_id").where(F.col("last_seen_at") < cutoff).drop("max_age_days")


def retention_report(resources: DataFrame, policies: DataFrame, now: Column, dry_run: bool = True) -> DataFrame:
    expired = expired_resources(resources, policies, now).groupBy("collection_id").agg(F.count("*").alias("matched"))
    return policies.join(expired, "collection_id", "left").na.fill(0, ["matched"]).select(
        "collection_id",
        "max_age_days",
        F.col("matched").alias("matched_resources"),
        (F.lit(0).cast("long") if dry_run else F.col("matched")).alias("deleted_resources"),
    )


def retention_prune(resources: DataFrame, children: dict[str, DataFrame], expired: DataFrame) -> dict[str, DataFrame]:
    """Tables without the expired resources and their children (each child has resource_id)."""
    gone = expired.select("resource_id")
    keep = lambda df: df.join(gone, "resource_id", "left_anti")
    return {"resources": keep(resources), **{name: keep(df) for name, df in children.items()}}


def collection_stats(
    resources: DataFrame, documents: DataFrame, chunks: DataFrame, embeddings: DataFrame, runs: DataFrame
) -> DataFrame:
    """Row counts and latest times per collection.

    Children are counted per parent before they are joined upwards, so every join meets
    one row per document or resource instead of raw chunks.
    resources: resource_id, collection_id, first_seen_at, last_seen_at; documents:
    document_id, resource_id; chunks: chunk_id, document_id; embeddings: chunk_id, created_at;
    runs: collection_id, run_type, status, completed_at.
    """
    per_chunk = embeddings.groupBy("chunk_id").agg(F.count("*").alias("e"), F.max("created_at").alias("latest"))
    per_document = (
        chunks.join(per_chunk, "chunk_id", "left")
        .groupBy("document_id")
        .agg(F.count("*").alias("c"), F.sum("e").alias("e"), F.max("latest").alias("latest"))
    )
    per_resource = (
        documents.join(per_document, "document_id", "left")
        .groupBy("resource_id")
        .agg(F.count("*").alias("d"), F.sum("c").alias("c"), F.sum("e").alias("e"), F.max("latest").alias("latest"))
    )
    stats = (
        resources.join(per_resource, "resource_id", "left")
        .groupBy("collection_id")
        .agg(
            F.count("*").alias("resources"),
            F.coalesce(F.sum("d"), F.lit(0)).alias("documents"),
            F.coalesce(F.sum("c"), F.lit(0)).alias("chunks"),
            F.coalesce(F.sum("e"), F.lit(0)).alias("embeddings"),
            F.min("first_seen_at").alias("first_seen_at"),
            F.max("last_seen_at").alias("last_seen_at"),
            F.max("latest").alias("latest_embedding_at"),
        )
    )
    reindex = (
        runs.where((F.col("run_type") == "reindex") & (F.col("status") == "completed"))
        .groupBy("collection_id")
        .agg(F.max("completed_at").alias("latest_reindex_at"))
    )
    return stats.join(reindex, "collection_id", "left")


def delete_preview(stats: DataFrame, requests: DataFrame) -> DataFrame:
    """What a delete request (collection_id, confirm) owns, and whether it is carried out."""
    return requests.join(stats, "collection_id").select(
        "collection_id", "resources", "documents", "chunks", "embeddings", F.col("confirm").alias("deleted")
    )


def delete_collections(table: DataFrame, preview: DataFrame) -> DataFrame:
    """A table (with collection_id) without the collections whose deletion was confirmed."""
    return table.join(preview.where("deleted").select("collection_id"), "collection_id", "left_anti")


def platform_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.lit(name).alias("metric"), F.count("*").alias("rows")) for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
