"""Latency targets of streams.

Exact percentiles need every latency, so the stream is appended to a table by Spark's own file sink, which writes every
row exactly once, and the batch operator reads that table. Windows are aggregated by the stream itself.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.operators.blocks import top_k
from dossier.operators.metrics import SLO_P95_MS, slo_status
from dossier.streaming.tables import run_to_table


def stream_slo(ops: DataFrame, keep: int | None = None, targets: Mapping[str, int] = SLO_P95_MS) -> DataFrame:
    """SLO status per operation over all operations, or the latest ``keep`` of each kind.

    ops: operation, op_id, at, latency_ms, failed.
    """
    log = run_to_table(ops.select("operation", "op_id", "at", "latency_ms", "failed"), "slo-log")
    if keep is not None:
        log = top_k(log, "operation", [F.desc("at"), F.desc("op_id")], keep, "__n").drop("__n")
    return slo_status(log, targets)


def slo_windows(ops: DataFrame, size: str = "6 hours", slide: str = "3 hours", delay: str = "1 hour") -> DataFrame:
    """Approximate p95 and error rate per operation and sliding window."""
    return (
        ops.withWatermark("at", delay)
        .groupBy(F.window("at", size, slide).alias("span"), "operation")
        .agg(
            F.count("*").alias("requests"),
            F.count_if("failed").alias("errors"),
            F.percentile_approx("latency_ms", 0.95, 10_000).alias("p95_ms"),
        )
        .select(F.col("span.start").alias("window_start"), F.col("span.end").alias("window_end"), "operation", "requests", "errors", "p95_ms")
    )
