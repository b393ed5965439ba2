"""Streams over several files, batch by batch, equal their batch twins."""

import pytest
from pyspark.sql import functions as F

from dossier.operators import results as r
from dossier.operators import sync as s
from dossier.operators.blocks import top_k
from dossier.operators.billing import dedupe_usage
from dossier.operators.metrics import slo_status
from dossier.plans.billing import usage_log
from dossier.plans.ingest import ingested_documents
from dossier.plans.registry import Tables
from dossier.plans.results import NOW, lease_events
from dossier.plans.streams import _ingest, _ops
from dossier.plans.sync import refresh_runs
from dossier.streaming import ingest as si
from dossier.streaming import keyed
from dossier.streaming import state as st
from dossier.streaming import tables as tb
from dossier.streaming import usage as us

FOLDER = "/root/testdata/sf0.001"


class Parts:
    """A table folder whose events and documents are streamed one file per batch."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name):
        return tb.stream_table(self.spark, self.folder, name, files_per_batch=1)


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """events in five files by time, documents in three with some rows repeated."""
    folder = tmp_path_factory.mktemp("parts")
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    for i in range(5):
        piece = events.where((F.col("event_id") >= i * 200) & (F.col("event_id") < (i + 1) * 200))
        _single(piece, folder, f"events{i}")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for i in range(3):
        _single(docs.where((F.col("doc_id") % 3 == i) | (F.col("doc_id") < 20)), folder, f"documents{i}")
    return Parts(spark, str(folder))


def _single(df, folder, name):
    import os
    import time

    out = folder / f"_{name}"
    df.coalesce(1).write.parquet(str(out))
    (file,) = [f for f in os.listdir(out) if f.endswith(".parquet")]
    os.link(out / file, folder / f"{name}.parquet")
    time.sleep(1.1)  # file streams read in order of modification time


def test_refresh_state(spark, parts, rows):
    cols = ["resource_id", "runs", "failures", "status", "last_seen_at", "next_refresh_at"]
    batch = s.refresh_state(refresh_runs(Tables(spark, FOLDER)), 3600, 3)
    assert rows(keyed.stream_refresh_state(refresh_runs(parts), 3600, 3).select(cols)) == rows(batch.select(cols))


def test_leases(spark, parts, rows):
    batch = r.lease_state(lease_events(Tables(spark, FOLDER)), F.lit(NOW))
    assert rows(keyed.stream_leases(lease_events(parts), F.lit(NOW)).select(batch.columns)) == rows(batch)


def test_state_of_batches_in_reverse_order(spark, tmp_path, rows):
    """Late batches give the state of the whole log."""
    import os
    import time

    schema = "resource_id int, run_id int, at timestamp, outcome string"
    log = [(1, 1, "10:00", "changed"), (1, 2, "11:00", "error"), (1, 3, "12:00", "changed"), (1, 4, "13:00", "error"), (1, 5, "14:00", "error"),
           (2, 6, "10:00", "error"), (2, 7, "11:00", "unchanged")]
    now = int(time.time())
    for place, row in enumerate(reversed(log)):
        df = spark.createDataFrame([row], "resource_id int, run_id int, t string, outcome string")
        df = df.select("resource_id", "run_id", F.to_timestamp(F.concat(F.lit("2024-01-01 "), "t")).alias("at"), "outcome")
        _single(df, tmp_path, f"part{place}")
        os.utime(tmp_path / f"part{place}.parquet", (now + place, now + place))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "part*.parquet").parquet(str(tmp_path))
    whole = spark.read.schema(schema).option("pathGlobFilter", "part*.parquet").parquet(str(tmp_path))
    got = keyed.stream_refresh_state(stream, 3600, 2)
    assert rows(got) == rows(s.refresh_state(whole, 3600, 2))
    assert {(r.resource_id, r.failures, r.status) for r in got.collect()} == {(1, 2, "stale"), (2, 1, "ready")}


def test_latest_latencies(spark, parts, rows):
    ops = _ops_of(parts.events)
    flat = _ops_of(spark.read.parquet(f"{FOLDER}/events.parquet"))
    latest = top_k(flat, "operation", [F.desc("at"), F.desc("op_id")], 40)
    assert rows(st.stream_slo(ops, 40)) == rows(slo_status(latest))


def _ops_of(events):
    kind = F.when(F.col("event_type") == "click", "search").otherwise("ingest")
    return events.select(
        kind.alias("operation"), F.col("event_id").alias("op_id"), F.col("ts").cast("timestamp").alias("at"),
        (F.col("value") * 30).cast("long").alias("latency_ms"), (F.col("event_id") % 97 == 0).alias("failed"),
    )


def _usage(t):
    return usage_log(t, replay=False).withColumn("created_at", F.col("created_at").cast("timestamp"))


def test_first_insert_wins_across_batches(spark, parts, rows):
    batch = dedupe_usage(_usage(Tables(spark, FOLDER)))
    assert rows(us.insert_first(_usage(parts)).select(batch.columns)) == rows(batch)


def test_dedupe_within_watermark(spark, parts, rows):
    batch = dedupe_usage(_usage(Tables(spark, FOLDER))).select("usage_event_id")
    assert rows(tb.run_to_table(us.dedupe_stream(_usage(parts)), "t").select("usage_event_id")) == rows(batch)


def test_windows_are_final(spark, parts, rows):
    events = _usage(Tables(spark, FOLDER))
    mark = events.agg(F.max("created_at") - F.expr("INTERVAL 1 HOUR")).first()[0]
    batch = events.groupBy(F.window("created_at", "1 day").alias("w"), "tenant_id", "operation").agg(F.count("*").alias("events"), F.sum("quantity").alias("quantity"))
    closed = batch.where(F.col("w.end") <= F.lit(mark)).select(F.col("w.start").alias("window_start"), "tenant_id", "operation", "events", "quantity")
    got = tb.run_to_table(us.usage_windows(_usage(parts), "1 day"), "t").select(closed.columns)
    assert rows(got) == rows(closed)


def test_late_rows_are_counted(spark, tmp_path, rows):
    import os

    for i, (name, times) in enumerate([("a", ["10:00", "12:00"]), ("b", ["10:30", "11:30", "13:00"])]):
        df = spark.createDataFrame([(j, f"2024-01-01 {t}:00") for j, t in enumerate(times)], "id int, s string").select("id", F.col("s").cast("timestamp").alias("t"))
        df.coalesce(1).write.parquet(str(tmp_path / f"_{name}"))
        (file,) = [f for f in os.listdir(tmp_path / f"_{name}") if f.endswith(".parquet")]
        os.link(tmp_path / f"_{name}" / file, tmp_path / f"{name}.parquet")
        os.utime(tmp_path / f"{name}.parquet", (1_700_000_000 + i * 10,) * 2)
    stream = spark.readStream.schema("id int, t timestamp").option("maxFilesPerTrigger", 1).option("pathGlobFilter", "?.parquet").parquet(str(tmp_path))
    assert rows(tb.lateness(stream, "t", 3600, "late").select("version", "rows", "late_rows")) == [(0, 2, 0), (1, 3, 1)]


def test_ingest_equals_batch(spark, parts, rows):
    out = ingested_documents(Tables(spark, FOLDER))
    got = si.stream_ingest(parts.documents, _ingest)
    for name, key in (("resources", "resource_id"), ("chunks", "chunk_id"), ("provenance", "chunk_id")):
        assert rows(got[name].select(key)) == rows(getattr(out, name).select(key))


def test_operations_fixture(spark):
    assert _ops(spark, FOLDER).isStreaming


def _log_files(spark, tmp_path, name, rows, schema, start):
    """One file per row, so one batch per row, in the order given."""
    import os
    import time

    now = int(time.time()) - 1000 + start
    for place, row in enumerate(rows):
        _single(spark.createDataFrame([row], schema), tmp_path, f"{name}{start + place}")
        os.utime(tmp_path / f"{name}{start + place}.parquet", (now + place, now + place))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", f"{name}*.parquet").parquet(str(tmp_path))


def test_second_run_reads_only_new_rows(spark, tmp_path, rows):
    schema = "resource_id int, run_id int, at timestamp_ntz, outcome string"
    at = lambda hour: __import__("datetime").datetime(2024, 1, 1, hour)
    first = [(1, 1, at(10), "error"), (2, 2, at(10), "changed")]
    stream = _log_files(spark, tmp_path, "run", first, schema, 0)
    folder = str(tmp_path / "state")
    keyed.stream_refresh_state(stream, 3600, 2, folder=folder)
    changes = lambda: spark.read.parquet(f"{folder}/changes").count()
    assert changes() == 2
    # An error after the first, and a clearing run that arrives late but lies before both.
    _log_files(spark, tmp_path, "run", [(1, 3, at(12), "error"), (1, 4, at(9), "changed")], schema, 2)
    got = keyed.stream_refresh_state(stream, 3600, 2, folder=folder)
    assert changes() == 4
    whole = spark.read.schema(schema).option("pathGlobFilter", "run*.parquet").parquet(str(tmp_path))
    assert rows(got) == rows(s.refresh_state(whole, 3600, 2))
    assert {(r.resource_id, r.failures, r.status) for r in got.collect()} == {(1, 2, "stale"), (2, 0, "ready")}
    assert rows(keyed.stream_refresh_state(stream, 3600, 2, folder=folder)) == rows(got) and changes() == 4


def test_lease_runs_out_by_time_alone(spark, tmp_path, rows):
    schema = "job_id string, item_id int, event_id int, action string, reviewer_id string, at long, ttl long"
    minute = 60_000_000
    log = [
        ("j", 1, 1, "claimed", "ann", 100 * minute, 30 * minute),
        ("j", 2, 2, "claimed", "bob", 101 * minute, 30 * minute),
        ("j", 2, 3, "renewed", "bob", 125 * minute, 300 * minute),
        ("j", 3, 4, "claimed", "eve", 126 * minute, 10 * minute),
        ("j", 3, 5, "completed", "eve", 130 * minute, 10 * minute),
        ("j", 9, 6, "claimed", "kim", 200 * minute, 500 * minute),  # no event of item 1 after its end
        ("j", 9, 7, "renewed", "kim", 190 * minute, 500 * minute),  # late, within the delay
        ("j", 2, 8, "taken_over", "zoe", 220 * minute, 500 * minute),
    ]
    stream = _log_files(spark, tmp_path, "lease", log, schema, 0)
    folder = str(tmp_path / "state")
    gone = keyed.lease_expiries(stream, "20 minutes", folder)
    assert [(r.item_id, r.reviewer_id, r.expires_at) for r in gone.collect()] == [(1, "ann", 130 * minute)]
    whole = spark.createDataFrame(log, schema)
    now = F.lit(210 * minute)
    got = keyed.stream_leases(stream, now, "20 minutes", folder)
    batch = r.lease_state(whole, now)
    assert rows(got.select(batch.columns)) == rows(batch)


def test_lease_events_in_any_order(spark, tmp_path, rows):
    schema = "job_id string, item_id int, event_id int, action string, reviewer_id string, at long, ttl long"
    actions = ["claimed", "renewed", "released", "claimed", "renewed", "taken_over", "renewed"]
    log = [("j", i % 2, i, a, f"r{i}", 1_000_000 * (i + 1), 10_000_000) for i, a in enumerate(actions + actions[:3])]
    stream = _log_files(spark, tmp_path, "any", log[::-1], schema, 0)
    batch = r.lease_state(spark.createDataFrame(log, schema), F.lit(0))
    assert rows(keyed.stream_leases(stream, F.lit(0), "1 day").select(batch.columns)) == rows(batch)


def test_state_of_an_empty_stream(spark, tmp_path):
    schema = "resource_id int, run_id int, at timestamp, outcome string"
    none = spark.readStream.schema(schema).parquet(str(tmp_path))
    assert keyed.stream_refresh_state(none, 3600, 2).count() == 0
