"""Usage metering on streams: idempotent events and windowed sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.operators.billing import METER, dedupe_usage, usage_event_id
from dossier.session import work_folder
from dossier.streaming.tables import read_versions, run_batches, write_version


def dedupe_stream(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One row per usage event id, with state kept only as long as duplicates may arrive."""
    return (
        events.withColumn("usage_event_id", usage_event_id())
        .withWatermark("created_at", delay)
        .dropDuplicatesWithinWatermark(["usage_event_id"])
        .withColumn("billable", (F.col("status_code") >= 200) & (F.col("status_code") < 400))
    )


def insert_first(events: DataFrame, purpose: str = "usage-insert") -> DataFrame:
    """Idempotent insert: the first arrival of an id is kept, whatever comes later.

    Each batch is deduplicated by arrival, then ids already stored are dropped by an anti join.
    """
    spark = events.sparkSession
    folder = work_folder(spark, purpose)
    path = f"{folder}/table"
    schema = dedupe_usage(spark.createDataFrame([], events.schema)).schema

    def each(batch: DataFrame, batch_id: int) -> None:
        stored = read_versions(batch.sparkSession, path, schema, before=batch_id).select("usage_event_id")
        write_version(dedupe_usage(batch).join(stored, "usage_event_id", "left_anti").select(*schema.names), path, batch_id)

    run_batches(events, each, folder)
    return read_versions(spark, path, schema).drop("version")


def usage_windows(events: DataFrame, size: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Events and quantity per half-open window, tenant and meter; a window is final once emitted."""
    span = F.window("created_at", size, slide) if slide else F.window("created_at", size)
    return (
        events.withWatermark("created_at", delay)
        .groupBy(span.alias("span"), "tenant_id", *METER)
        .agg(F.count("*").alias("events"), F.sum("quantity").alias("quantity"))
        .select(F.col("span.start").alias("window_start"), F.col("span.end").alias("window_end"), "tenant_id", *METER, "events", "quantity")
    )


def usage_sessions(events: DataFrame, gap: str, delay: str = "1 hour") -> DataFrame:
    """Events and quantity per consumer session (no gap longer than ``gap``)."""
    return (
        events.withWatermark("created_at", delay)
        .groupBy(F.session_window("created_at", gap).alias("span"), "consumer_id")
        .agg(F.count("*").alias("events"), F.sum("quantity").alias("quantity"))
        .select(F.col("span.start").alias("session_start"), F.col("span.end").alias("session_end"), "consumer_id", "events", "quantity")
    )
