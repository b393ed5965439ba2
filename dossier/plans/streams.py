"""Streaming jobs run over the given tables as file streams, to completion."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.operators import ingest as ing
from dossier.operators import vectors as v
from dossier.plans import sqltext as q
from dossier.plans.billing import USAGE_SQL, usage_log
from dossier.plans.evaluation import OPERATIONS
from dossier.plans.ingest import DOC_IDS_SQL, doc_uri
from dossier.plans.registry import Tables, query
from dossier.plans.results import LEASES_SQL, NOW, lease_events
from dossier.plans.sync import micros, refresh_runs, state_sql
from dossier.streaming import ingest as si
from dossier.streaming import keyed
from dossier.streaming import state as st
from dossier.streaming import usage as us
from dossier.streaming.tables import lateness, run_to_table, stream_table


class StreamTables(Tables):
    """The same tables, read as file streams."""

    def __getattr__(self, name):
        return stream_table(self._spark, self._folder, name)


def _usage(spark, d):
    log = usage_log(StreamTables(spark, d), replay=False)
    return log.withColumn("created_at", F.col("created_at").cast("timestamp"))


@query(
    "stream_usage_dedupe",
    "M1",
    f"WITH {USAGE_SQL} SELECT usage_event_id, tenant_id, consumer_id, operation, unit FROM usage",
)
def stream_usage_dedupe(spark, d):
    # One file is one batch: every duplicate lies inside the watermark.
    out = run_to_table(us.dedupe_stream(_usage(spark, d), "1 hour"), "usage-dedupe")
    return out.select("usage_event_id", "tenant_id", "consumer_id", "operation", "unit")


@query(
    "stream_usage_insert",
    "M1",
    f"WITH {USAGE_SQL} SELECT usage_event_id, tenant_id, consumer_id, operation, quantity, status_code, arrival, billable FROM usage",
)
def stream_usage_insert(spark, d):
    return us.insert_first(_usage(spark, d)).select(
        "usage_event_id", "tenant_id", "consumer_id", "operation", "quantity", "status_code", "arrival", "billable"
    )


CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query(
    "stream_usage_windows",
    "M2",
    f"""SELECT epoch_us(date_trunc('day', ts)) AS window_start, 't' || (user_id % 7) AS tenant_id, event_type AS operation, count(*) AS events,
      CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS quantity FROM events
    WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= {CLOSED} GROUP BY ALL""",
)
def stream_usage_windows(spark, d):
    out = run_to_table(us.usage_windows(_usage(spark, d), "1 day"), "usage-windows")
    return out.select(micros("window_start"), "tenant_id", "operation", "events", "quantity")


@query(
    "stream_usage_sliding",
    "M2",
    f"""WITH e AS (SELECT *, time_bucket(INTERVAL 3 HOUR, ts) AS b FROM events),
    w AS (SELECT b AS s, * FROM e UNION ALL SELECT b - INTERVAL 3 HOUR, * FROM e)
    SELECT epoch_us(s) AS window_start, 't' || (user_id % 7) AS tenant_id, event_type AS operation, count(*) AS events,
      CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS quantity FROM w WHERE s + INTERVAL 6 HOUR <= {CLOSED} GROUP BY ALL""",
)
def stream_usage_sliding(spark, d):
    out = run_to_table(us.usage_windows(_usage(spark, d), "6 hours", "3 hours"), "usage-sliding")
    return out.select(micros("window_start"), "tenant_id", "operation", "events", "quantity")


@query(
    "stream_usage_sessions",
    "M2",
    f"""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS first FROM events),
    n AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g),
    s AS (SELECT user_id, session, min(ts) AS a, max(ts) + INTERVAL 6 HOUR AS b, count(*) AS events, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS quantity
      FROM n GROUP BY ALL)
    SELECT epoch_us(a) AS session_start, epoch_us(b) AS session_end, 'u' || user_id AS consumer_id, events, quantity FROM s WHERE b <= {CLOSED}""",
)
def stream_usage_sessions(spark, d):
    out = run_to_table(us.usage_sessions(_usage(spark, d), "6 hours"), "usage-sessions")
    return out.select(micros("session_start"), micros("session_end"), "consumer_id", "events", "quantity")


@query("stream_lateness", "M2", "SELECT count(*) AS rows, epoch_us(max(ts)) AS newest, CAST(0 AS BIGINT) AS late_rows FROM events")
def stream_lateness(spark, d):
    out = lateness(_usage(spark, d), "created_at", 3600, "late")
    return out.select("rows", micros("newest"), "late_rows")


@query("stream_refresh_state", "M3", state_sql("'changed'", 3))
def stream_refresh_state(spark, d):
    out = keyed.stream_refresh_state(refresh_runs(StreamTables(spark, d)), 3600, 3)
    return out.select("resource_id", "runs", "failures", "status", micros("last_seen_at"), micros("next_refresh_at"))


@query("stream_leases", "M4", f"WITH {LEASES_SQL} SELECT *, coalesce({NOW} < expires_at, false) AS active FROM leases")
def stream_leases(spark, d):
    return keyed.stream_leases(lease_events(StreamTables(spark, d)), F.lit(NOW))


@query(
    "stream_lease_expiries",
    "M4",
    f"""WITH {LEASES_SQL}, mark AS (SELECT epoch_us(max(ts)) // 1000 - 3600000 AS ms FROM events)
    SELECT job_id, item_id, reviewer_id, revision, expires_at FROM leases, mark
    WHERE expires_at IS NOT NULL AND (expires_at + 999) // 1000 <= ms""",
)
def stream_lease_expiries(spark, d):
    return keyed.lease_expiries(lease_events(StreamTables(spark, d)))


def _ops(spark, d):
    names = F.create_map(*[F.lit(x) for pair in OPERATIONS.items() for x in pair])
    return StreamTables(spark, d).events.select(
        names[F.col("event_type")].alias("operation"),
        F.col("event_id").alias("op_id"),
        F.col("ts").cast("timestamp").alias("at"),
        (F.col("value") * 30).cast("long").alias("latency_ms"),
        (F.get_json_object("props", "$.k").cast("int") % 97 == 0).alias("failed"),
    )


OPS_SQL = """
    ops AS (SELECT CASE event_type WHEN 'click' THEN 'search' WHEN 'view' THEN 'process' WHEN 'purchase' THEN 'ingest'
        WHEN 'error' THEN 'answer' ELSE 'extract' END AS operation, CAST(trunc(value * 30) AS BIGINT) AS ms,
      CAST(json_extract(props, '$.k') AS INT) % 97 = 0 AS failed, event_id, ts FROM events)"""


@query(
    "stream_slo",
    "M5",
    f"""WITH {OPS_SQL}, latest AS (SELECT * FROM ops)
    SELECT operation, count(*) AS requests, count_if(failed) AS errors, CAST(round_even(quantile_cont(CAST(ms AS DOUBLE), 0.95), 0) AS BIGINT) AS p95_ms,
      CASE WHEN count(*) < 20 THEN 'insufficient-data' WHEN count_if(failed) / count(*) <= 0.01 AND round_even(quantile_cont(CAST(ms AS DOUBLE), 0.95), 0) <=
        CASE operation WHEN 'search' THEN 1500 WHEN 'answer' THEN 20000 ELSE 10000 END THEN 'green' ELSE 'red' END AS status
    FROM latest GROUP BY operation""",
)
def stream_slo(spark, d):
    return st.stream_slo(_ops(spark, d)).select("operation", "requests", "errors", "p95_ms", "status")


@query(
    "stream_slo_windows",
    "M5",
    f"""WITH {OPS_SQL}, e AS (SELECT *, time_bucket(INTERVAL 3 HOUR, ts) AS b FROM ops),
    w AS (SELECT b AS s, * FROM e UNION ALL SELECT b - INTERVAL 3 HOUR, * FROM e)
    SELECT epoch_us(s) AS window_start, operation, count(*) AS requests, count_if(failed) AS errors, quantile_disc(ms, 0.95) AS p95_ms FROM w WHERE s + INTERVAL 6 HOUR <= {CLOSED} GROUP BY ALL""",
)
def stream_slo_windows(spark, d):
    out = run_to_table(st.slo_windows(_ops(spark, d)), "slo-windows")
    return out.select(micros("window_start"), "operation", "requests", "errors", "p95_ms")


def _ingest(batch):
    return ing.ingest_texts(batch, F.col("source"), doc_uri(), F.col("text"), "file")


STREAM_CHUNKS_SQL = f"""WITH RECURSIVE {DOC_IDS_SQL}, {q.chunk_ctes("docs", "document_id", "text")},
    ided AS (SELECT {q.sid("'chunk'", "document_id", "content_hash", "CAST(ordinal AS VARCHAR)")} AS chunk_id, document_id, ordinal, content_hash FROM chunks)"""


@query("stream_ingest", "M6", f"{STREAM_CHUNKS_SQL} SELECT * FROM ided")
def stream_ingest(spark, d):
    tables = si.stream_ingest(stream_table(spark, d, "documents"), _ingest)
    return tables["chunks"].select("chunk_id", "document_id", "ordinal", "content_hash")


@query(
    "stream_pending_embeddings",
    "M6",
    f"{STREAM_CHUNKS_SQL} SELECT chunk_id FROM ided WHERE ordinal > 0",
)
def stream_pending_embeddings(spark, d):
    chunks = si.stream_ingest(stream_table(spark, d, "documents"), _ingest)["chunks"]
    vectors = chunks.where("ordinal = 0").select("chunk_id", F.lit("hash").alias("provider"), F.lit("m1").alias("model"))
    return v.pending_chunks(chunks, vectors, "hash", "m1").select("chunk_id")
