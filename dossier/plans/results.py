"""Result-store, review-queue and job-run queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.operators import results as r
from dossier.plans.registry import Tables, query


def _results(t: Tables):
    """Documents as durable results: job = source, definition = language."""
    return t.documents.select(
        F.col("source").alias("job_id"), F.col("doc_id").alias("item_id"), "lang", F.col("lang").alias("definition_hash"), F.sha2("text", 256).alias("payload_hash")
    )


@query(
    "classify_writes",
    "J1",
    """SELECT source AS job_id, doc_id AS item_id, CASE WHEN lang = 'fr' THEN 'new' WHEN lang = 'de' THEN 'definition_mismatch'
      WHEN doc_id % 4 = 0 THEN 'conflict' ELSE 'identical' END AS outcome FROM documents""",
)
def classify_writes(spark, d):
    rows = _results(Tables(spark, d))
    store = rows.where("lang <> 'fr'").withColumn("definition_hash", F.when(F.col("lang") == "de", "old").otherwise(F.col("lang")))
    incoming = rows.withColumn("payload_hash", F.when(F.col("item_id") % 4 == 0, "other").otherwise(F.col("payload_hash")))
    return r.classify_writes(store, incoming)


def _revised(spark, d):
    rows = _results(Tables(spark, d))
    n = F.col("item_id")
    store = rows.where("lang <> 'fr'").withColumn("revision", (n % 5 + 1).cast("int")).drop("lang")
    updates = rows.where("lang <> 'es'").select(
        "job_id",
        "item_id",
        F.when(n % 6 == 0, "other").otherwise(F.col("definition_hash")).alias("definition_hash"),
        F.lit("new").alias("payload_hash"),
        F.when(n % 3 == 0, n % 5 + 2).otherwise(n % 5 + 1).cast("int").alias("expected_revision"),
    )
    return r.apply_revisions(store, updates)


@query(
    "apply_revisions",
    "J2",
    """SELECT source AS job_id, doc_id AS item_id, CASE WHEN lang <> 'es' AND doc_id % 3 <> 0 THEN 'new' ELSE sha256(text) END AS payload_hash,
      doc_id % 5 + 1 + CASE WHEN lang <> 'es' AND doc_id % 3 <> 0 THEN 1 ELSE 0 END AS revision FROM documents WHERE lang <> 'fr'""",
)
def apply_revisions(spark, d):
    return _revised(spark, d)[0].select("job_id", "item_id", "payload_hash", F.col("revision").cast("long"))


@query(
    "revision_outcomes",
    "J2",
    """SELECT source AS job_id, doc_id AS item_id, CASE WHEN lang = 'fr' THEN 'not_found' WHEN doc_id % 3 = 0 THEN 'revision_conflict' ELSE 'applied' END AS outcome
    FROM documents WHERE lang <> 'es'""",
)
def revision_outcomes(spark, d):
    return _revised(spark, d)[1]


@query("verify_payload_hash", "J3", "SELECT o_orderkey AS item_id, o_orderkey % 9 <> 0 AS intact FROM orders")
def verify_payload_hash(spark, d):
    orders = Tables(spark, d).orders
    payload = F.struct(F.col("o_orderpriority").alias("a_priority"), F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status"))
    text = F.concat(
        F.lit('{"a_priority":"'), "o_orderpriority", F.lit('","customer":'), F.col("o_custkey"), F.lit(',"status":"'), "o_orderstatus", F.lit('"}')
    )
    stored = orders.select(
        F.lit("job").alias("job_id"),
        F.col("o_orderkey").alias("item_id"),
        payload.alias("payload"),
        F.when(F.col("o_orderkey") % 9 == 0, "bad").otherwise(F.sha2(text, 256)).alias("payload_hash"),
    )
    return r.verify_payload_hash(stored).select("item_id", "intact")


def lease_events(t: Tables):
    """events as a review log: the user is the item, the event type the action."""
    action = (
        F.when(F.col("event_type") == "signup", "claimed")
        .when(F.col("event_type") == "click", "taken_over")
        .when(F.col("event_type") == "view", "renewed")
        .when(F.col("event_type") == "error", "released")
        .otherwise("completed")
    )
    return t.events.select(
        F.concat(F.lit("job"), F.col("user_id") % 4).alias("job_id"),
        F.col("user_id").alias("item_id"),
        "event_id",
        action.alias("action"),
        F.concat(F.lit("r"), F.get_json_object("props", "$.k")).alias("reviewer_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        F.lit(3_600_000_000).alias("ttl"),
    )


NOW = 1_706_500_000_000_000
LEASES_SQL = f"""
    log AS (SELECT 'job' || (user_id % 4) AS job_id, user_id AS item_id, event_id, epoch_us(ts) AS seen, 'r' || json_extract_string(props, '$.k') AS reviewer_id,
      CASE event_type WHEN 'signup' THEN 'claimed' WHEN 'click' THEN 'taken_over' WHEN 'view' THEN 'renewed' WHEN 'error' THEN 'released' ELSE 'completed' END AS action FROM events),
    marked AS (SELECT *, count_if(action IN ('released', 'completed')) OVER (PARTITION BY item_id ORDER BY seen DESC, event_id DESC) AS ended FROM log),
    leases AS (
      SELECT job_id, item_id, arg_max(action, (seen, event_id)) AS last_action, arg_max(reviewer_id, (seen, event_id)) FILTER (ended = 0) AS reviewer_id,
        count_if(ended = 0) AS revision, coalesce(max(seen) FILTER (ended = 0 AND action IN ('claimed', 'taken_over')), min(seen) FILTER (ended = 0)) AS claimed_at,
        max(seen) FILTER (ended = 0) + 3600000000 AS expires_at FROM marked GROUP BY ALL)"""


@query(
    "lease_state",
    "J5",
    f"WITH {LEASES_SQL} SELECT *, coalesce({NOW} < expires_at, false) AS active FROM leases",
)
def lease_state(spark, d):
    return r.lease_state(lease_events(Tables(spark, d)), F.lit(NOW))


@query(
    "pending_reviews",
    "J4",
    f"""WITH {LEASES_SQL} SELECT 'job' || (c_custkey % 4) AS job_id, c_custkey AS item_id, NOT coalesce({NOW} < expires_at, false) AS available
    FROM customer LEFT JOIN leases ON item_id = c_custkey WHERE c_mktsegment IN ('HOUSEHOLD', 'MACHINERY')""",
)
def pending_reviews(spark, d):
    t = Tables(spark, d)
    n = F.col("c_custkey")
    results = t.customer.select(
        F.concat(F.lit("job"), n % 4).alias("job_id"),
        n.alias("item_id"),
        F.when(F.col("c_mktsegment").isin("HOUSEHOLD", "MACHINERY"), "review_required").otherwise("ready").alias("status"),
    )
    leases = r.lease_state(lease_events(t), F.lit(NOW))
    return r.pending_reviews(results, leases, include_claimed=True).select("job_id", "item_id", "available")


@query(
    "review_history",
    "J6",
    f"WITH {LEASES_SQL} SELECT event_id, action, seen AS at FROM log WHERE job_id = 'job2'",
)
def review_history(spark, d):
    return r.review_history(lease_events(Tables(spark, d)), "job2").select("event_id", "action", "at")


@query("duplicate_events", "J6", "SELECT l_suppkey AS event_id, count(*) AS times FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_events(spark, d):
    return r.duplicate_events(Tables(spark, d).lineitem.select(F.col("l_suppkey").alias("event_id")))


def _job(t: Tables):
    """Orders as job items: job = customer, status by order status and key."""
    status = (
        F.when(F.col("o_orderstatus") == "F", F.when(F.col("o_orderkey") % 10 == 0, "failed").otherwise("succeeded"))
        .when(F.col("o_orderkey") % 6 == 0, "running")
        .when(F.col("o_orderkey") % 6 == 1, "pending")
        .when(F.col("o_orderkey") % 6 == 2, "incomplete")
        .otherwise("review_required")
    )
    return t.orders.select(
        F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("item_id"), F.lit("v1").alias("definition_hash"), status.alias("status")
    )


JOB_SQL = """
    job AS (SELECT o_custkey AS job_id, o_orderkey AS item_id, CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 10 = 0 THEN 'failed' ELSE 'succeeded' END
      WHEN o_orderkey % 6 = 0 THEN 'running' WHEN o_orderkey % 6 = 1 THEN 'pending' WHEN o_orderkey % 6 = 2 THEN 'incomplete' ELSE 'review_required' END AS status FROM orders)"""


@query(
    "resume_items",
    "J7",
    f"""WITH {JOB_SQL} SELECT job_id, item_id, 'pending' AS status, CASE WHEN item_id % 7 = 0 THEN 'pending' ELSE status END AS stored_status
    FROM job WHERE item_id % 7 = 0 OR status IN ('running', 'pending')""",
)
def resume_items(spark, d):
    job = _job(Tables(spark, d))
    return r.resume_items(job.select("job_id", "item_id"), job.where("item_id % 7 <> 0"))


@query(
    "checkpoint_mismatch",
    "J7",
    f"""WITH {JOB_SQL}, c AS (SELECT job_id, item_id, CASE WHEN item_id % 50 = 1 THEN 'v0' ELSE 'v1' END AS v FROM job WHERE item_id % 40 <> 0),
    j AS (SELECT job.job_id, count_if(c.item_id IS NULL) AS different_items, count_if(v = 'v0') AS different_definitions FROM job
      LEFT JOIN c ON c.job_id = job.job_id AND c.item_id = job.item_id WHERE job.job_id IN (SELECT job_id FROM c) GROUP BY 1)
    SELECT * FROM j WHERE different_items > 0 OR different_definitions > 0""",
)
def checkpoint_mismatch(spark, d):
    job = _job(Tables(spark, d)).drop("status")
    stored = job.where("item_id % 40 <> 0").withColumn("definition_hash", F.when(F.col("item_id") % 50 == 1, "v0").otherwise("v1"))
    return r.checkpoint_mismatch(job, stored)


@query(
    "job_summary",
    "J8",
    f"""WITH {JOB_SQL} SELECT job_id, count(*) AS items, count_if(status IN ('running', 'pending')) AS pending, count_if(status = 'succeeded') AS succeeded,
      count_if(status = 'failed') AS failed, count_if(status = 'review_required') AS review_required, count_if(status = 'incomplete') AS incomplete,
      CASE WHEN count_if(status IN ('running', 'pending')) > 0 THEN 'partial' WHEN count_if(status = 'failed') > 0 THEN 'completed_with_failures'
        WHEN count_if(status IN ('review_required', 'incomplete')) > 0 THEN 'needs_attention' ELSE 'succeeded' END AS job_status FROM job GROUP BY job_id""",
)
def job_summary(spark, d):
    return r.job_summary(_job(Tables(spark, d)))


@query(
    "record_set_completeness",
    "J9",
    """WITH m AS (SELECT l_orderkey AS k, l_linenumber AS n, count(*) AS c FROM lineitem GROUP BY ALL),
    p AS (SELECT k, sum(c) AS expected, count_if(c > 1) AS repeated, sum(CASE WHEN n = 7 THEN c ELSE 0 END) AS missing FROM m GROUP BY 1)
    SELECT k AS item_id, CAST(expected AS BIGINT) AS expected, repeated, CAST(missing AS BIGINT) AS missing, repeated = 0 AND missing = 0 AS complete FROM p""",
)
def record_set_completeness(spark, d):
    lines = Tables(spark, d).lineitem.select(F.lit("job").alias("job_id"), F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").alias("record_id"))
    manifests = lines.groupBy("job_id", "item_id").agg(F.collect_list("record_id").alias("record_ids"))
    out = r.record_set_completeness(manifests, lines.where("record_id <> 7"))
    return out.select("item_id", F.col("expected").cast("long"), "repeated", "missing", "complete")
