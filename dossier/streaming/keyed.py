"""Refresh state and review leases as keyed state of a stream, kept by Spark's state store.

Every key owns a summary and a short list of events that may still change it; a batch touches the keys it has rows for
and no others, and a later run goes on from the checkpoint with new rows only. The current state of all keys is read
from the state store itself. Summaries do not depend on the order of arrival: an event that ends what came before it
removes older events from the list whenever it arrives.

The lists are bounded by what they hold: errors since the last cleared run of a resource; events of a lease that are
newer than the watermark (older ones are folded into the summary, since no event before them is accepted any more).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from dossier.operators.results import ITEM
from dossier.operators.sync import MIN_INTERVAL
from dossier.session import work_folder

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# The process that sets up state variables on the driver does not get the files a session ships to its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def newest(*moments: tuple | None) -> tuple | None:
    """The latest (time, id); None is earlier than all."""
    return max((m for m in moments if m is not None), default=None)


def process(stream: DataFrame, folder: str) -> DataFrame:
    """Process what is available, append the changes of state to a table, and read it."""
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        query = (
            stream.writeStream.format("parquet")
            .outputMode("append")
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .start(f"{folder}/changes")
        )
        query.awaitTermination()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/changes")


def stored_state(spark: SparkSession, folder: str, name: str, changes: DataFrame, schema: str) -> DataFrame:
    """The state variable ``name`` of every key, as of the last batch."""
    if changes.isEmpty():
        return spark.createDataFrame([], schema)
    store = spark.read.format("statestore").option("path", f"{folder}/checkpoint").option("stateVarName", name)
    return store.load().select("key.*", "value.*")


class RefreshState(StatefulProcessor):
    """Runs of one resource: the last one, the last that was seen and that cleared, and the errors since."""

    def __init__(self, run_kind: str, clears: list[str]) -> None:
        self.run_kind, self.clears = run_kind, clears

    SUMMARY = (
        "runs bigint, last_at bigint, last_run {run}, last_outcome string, seen_at bigint, "
        "cleared_at bigint, cleared_run {run}, failures bigint"
    )

    def init(self, handle) -> None:
        summary = self.SUMMARY.format(run=self.run_kind)
        self.summary = handle.getValueState("summary", summary)
        self.errors = handle.getListState("errors", f"at bigint, run {self.run_kind}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        runs, last, seen, cleared, known = 0, None, None, None, 0
        if self.summary.exists():
            runs, *at, seen, cleared_at, cleared_run, known = self.summary.get()
            last = tuple(at)
            cleared = None if cleared_at is None else (cleared_at, cleared_run)
        before, fresh = cleared, []
        for batch in rows:
            runs += len(batch)
            moments = list(zip(batch["at"].tolist(), batch["run_id"].tolist(), batch["outcome"].tolist()))
            last = newest(last, *moments)
            seen = max([t for t, _, how in moments if how != "error"] + ([] if seen is None else [seen]), default=None)
            cleared = newest(cleared, *[(t, run) for t, run, how in moments if how in self.clears])
            fresh += [(t, run) for t, run, how in moments if how == "error"]
        if cleared != before:
            kept = [tuple(e) for e in self.errors.get()] if known else []
            kept = [e for e in kept + fresh if e > cleared]
            self.errors.put(kept) if kept else self.errors.clear()
            failures = len(kept)
        else:
            fresh = [e for e in fresh if cleared is None or e > cleared]
            if fresh:
                self.errors.appendList(fresh)
            failures = known + len(fresh)
        self.summary.update((runs, *last, seen, *(cleared or (None, None)), failures))
        yield pd.DataFrame({"resource_id": [key[0]], "runs": [runs], "failures": [failures], "last_outcome": [last[2]]})

    def close(self) -> None:
        pass


def stream_refresh_state(
    runs: DataFrame,
    interval_seconds: int = 86_400,
    missing_after: int = 3,
    strict: bool = False,
    folder: str | None = None,
) -> DataFrame:
    """Failure count, status and next due time per resource from a stream of refresh runs.

    With the ``folder`` of an earlier call the run goes on from there and reads new rows only. State has no time to live:
    Spark ties that to processing time, in which a run over what is available never ends.
    """
    if interval_seconds < MIN_INTERVAL or missing_after < 1:
        raise ValueError("interval must be at least 300 seconds and missing_after positive")
    spark, kinds = runs.sparkSession, {f.name: f.dataType.simpleString() for f in runs.schema}
    folder = folder or work_folder(spark, "refresh-state")
    clears = ["changed", "unchanged"] if strict else ["changed"]
    stream = runs.select("resource_id", "run_id", F.unix_micros(F.col("at").cast("timestamp")).alias("at"), "outcome")
    changes = process(
        stream.groupBy("resource_id").transformWithStateInPandas(
            RefreshState(kinds["run_id"], clears),
            outputStructType=f"resource_id {kinds['resource_id']}, runs bigint, failures bigint, last_outcome string",
            outputMode="append",
            timeMode="none",
        ),
        folder,
    )
    summary = RefreshState.SUMMARY.format(run=kinds["run_id"])
    state = stored_state(spark, folder, "summary", changes, f"resource_id {kinds['resource_id']}, {summary}")
    time = lambda micros: F.timestamp_micros(micros).cast(kinds["at"])
    status = (
        F.when(F.col("last_outcome") != "error", "ready")
        .when(F.col("failures") >= missing_after, "stale")
        .otherwise("refresh_error")
    )
    return state.select(
        "resource_id",
        "runs",
        "failures",
        status.alias("status"),
        time(F.col("seen_at")).alias("last_seen_at"),
        (time(F.col("last_at")) + F.make_dt_interval(secs=F.lit(interval_seconds))).alias("next_refresh_at"),
    )


class Lease(StatefulProcessor):
    """The lease of one review item; a timer at its end tells that it ran out."""

    STATE = (
        "last_at bigint, last_event {event}, last_action string, ended_at bigint, ended_event {event}, "
        "reviewer_id string, revision bigint, claimed_at bigint, expires_at bigint, "
        "old bigint, old_taken bigint, old_first bigint, top_at bigint, top_event {event}"
    )
    LIVE = "at bigint, event {event}, action string, reviewer_id string, ttl bigint"

    def __init__(self, event_kind: str) -> None:
        self.event_kind = event_kind

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("lease", self.STATE.format(event=self.event_kind))
        self.live = handle.getListState("live", self.LIVE.format(event=self.event_kind))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, ended, holder, old, top = None, None, (None, None), (0, None, None), None
        if self.state.exists():
            s = self.state.get()
            last, holder, old = tuple(s[0:3]), (s[5], s[8]), tuple(s[9:12])
            ended = None if s[3] is None else (s[3], s[4])
            top = None if s[12] is None else (s[12], s[13])
        live = [tuple(e) for e in self.live.get()] if self.state.exists() else []
        for batch in rows:
            columns = (batch[c].tolist() for c in ("at", "event_id", "action", "reviewer_id", "ttl"))
            for at, event, action, reviewer, ttl in zip(*columns):
                last = newest(last, (at, event, action))
                if action in ("released", "completed"):
                    ended = newest(ended, (at, event))
                else:
                    live.append((at, event, action, reviewer, ttl))
        if ended is not None:
            live = [e for e in live if e[:2] > ended]
            if top is not None and top < ended:
                old, top, holder = (0, None, None), None, (None, None)
        # The latest event names the holder, and the end counts from it.
        latest = max(live, key=lambda e: e[:2], default=None)
        if latest is not None and (top is None or latest[:2] > top):
            top, holder = latest[:2], (latest[3], latest[0] + latest[4])
        revision = old[0] + len(live)
        taken = [e[0] for e in live if e[2] in ("claimed", "taken_over")] + [t for t in old[1:2] if t is not None]
        first = [e[0] for e in live] + [t for t in old[2:3] if t is not None]
        claimed = max(taken, default=None) if taken else min(first, default=None)
        # No event before the watermark is accepted any more: what lies before it cannot be cut in two.
        mark = 1000 * timerValues.getCurrentWatermarkInMs()
        past, live = [e for e in live if e[0] < mark], [e for e in live if e[0] >= mark]
        if past:
            old_taken = [e[0] for e in past if e[2] in ("claimed", "taken_over")] + [t for t in old[1:2] if t is not None]
            old_first = [e[0] for e in past] + [t for t in old[2:3] if t is not None]
            old = (old[0] + len(past), max(old_taken, default=None), min(old_first))
        self.live.put(live) if live else self.live.clear()
        row = (*last, *(ended or (None, None)), holder[0], revision, claimed, holder[1], *old, *(top or (None, None)))
        self.state.update(row)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if holder[1] is not None:
            self.handle.registerTimer(-(-holder[1] // 1000))
        yield self.change(key, "lease", last[2], holder, revision)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = self.state.get()
        yield self.change(key, "expired", s[2], (s[5], s[8]), s[6])

    def change(self, key, kind: str, action: str, holder: tuple, revision: int) -> pd.DataFrame:
        names = [*ITEM, "change", "last_action", "reviewer_id", "revision", "expires_at"]
        row = pd.DataFrame([(*key, kind, action, holder[0], revision, holder[1])], columns=names)
        return row.astype({"expires_at": "Int64"})

    def close(self) -> None:
        pass


def lease_changes(events: DataFrame) -> str:
    """Columns of the changes of leases."""
    key = ", ".join(f"{c} {events.schema[c].dataType.simpleString()}" for c in ITEM)
    return f"{key}, change string, last_action string, reviewer_id string, revision bigint, expires_at bigint"


def stream_leases(events: DataFrame, now: Column, delay: str = "1 hour", folder: str | None = None) -> DataFrame:
    """Current lease per item from a stream of review events; ``now`` decides expiry.

    events: job_id, item_id, event_id, at (microseconds), action, reviewer_id, ttl (microseconds). Events that arrive
    more than ``delay`` after the newest one are dropped by the watermark. With the ``folder`` of an earlier call the
    run goes on from there.
    """
    spark = events.sparkSession
    folder = folder or work_folder(spark, "leases")
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    changed = lease_changes(events)
    timed = events.select(*ITEM, "event_id", "at", "action", "reviewer_id", "ttl", F.timestamp_micros("at").alias("event_time"))
    key = ", ".join(f"{c} {kinds[c]}" for c in ITEM)
    changes = process(
        timed.withWatermark("event_time", delay)
        .groupBy(*ITEM)
        .transformWithStateInPandas(
            Lease(kinds["event_id"]),
            outputStructType=changed,
            outputMode="append",
            timeMode="eventTime",
        ),
        folder,
    )
    state = stored_state(spark, folder, "lease", changes, f"{key}, {Lease.STATE.format(event=kinds['event_id'])}")
    active = F.coalesce(now < F.col("expires_at"), F.lit(False))
    return state.select(*ITEM, "last_action", "reviewer_id", "revision", "claimed_at", "expires_at", active.alias("active"))


def lease_expiries(events: DataFrame, delay: str = "1 hour", folder: str | None = None) -> DataFrame:
    """Leases that ran out as event time passed their end, without a further event of the item.

    Returns job_id, item_id, reviewer_id, revision, expires_at of every expiry reported so far.
    """
    folder = folder or work_folder(events.sparkSession, "leases")
    stream_leases(events, F.lit(0), delay, folder)
    changes = events.sparkSession.read.schema(lease_changes(events)).parquet(f"{folder}/changes")
    return changes.where("change = 'expired'").select(*ITEM, "reviewer_id", "revision", "expires_at")
