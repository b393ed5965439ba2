"""Refresh, retention, statistics and memory queries over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.operators import memory as mem
from dossier.operators import sync as s
from dossier.plans.registry import Tables, query


@query(
    "detect_changes",
    "K1",
    """SELECT doc_id AS resource_id, CASE WHEN lang = 'fr' THEN 'new' WHEN lang = 'es' THEN 'missing'
      WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'unchanged' END AS outcome,
      CASE WHEN lang <> 'fr' THEN sha256(text) END AS previous_hash,
      CASE WHEN lang = 'es' THEN NULL WHEN doc_id % 7 = 0 THEN sha256(text || '.') ELSE sha256(text) END AS current_hash FROM documents""",
)
def detect_changes(spark, d):
    docs = Tables(spark, d).documents
    n = F.col("doc_id")
    old = docs.where("lang <> 'fr'").select(n.alias("resource_id"), F.sha2("text", 256).alias("content_hash"))
    edited = F.when(n % 7 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    new = docs.where("lang <> 'es'").select(n.alias("resource_id"), F.sha2(edited, 256).alias("content_hash"))
    return s.detect_changes(old, new)


def _ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


@query(
    "due_resources",
    "K2",
    """SELECT o_orderkey AS resource_id, strftime(o_orderdate, '%Y-%m-%d') AS next_refresh_at FROM orders
    WHERE o_orderstatus <> 'P' AND o_orderdate <= TIMESTAMP '1998-08-02' ORDER BY o_orderdate, o_orderkey LIMIT 120""",
)
def due_resources(spark, d):
    resources = Tables(spark, d).orders.select(
        F.col("o_orderkey").alias("resource_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("next_refresh_at")
    )
    return s.due_resources(resources, _ntz("1998-08-02"), 120).withColumn(
        "next_refresh_at", F.date_format("next_refresh_at", "yyyy-MM-dd")
    )


def refresh_runs(t: Tables) -> DataFrame:
    """events as refresh runs of the user's resource."""
    outcome = (
        F.when(F.col("event_type").isin("error", "view"), "error").when(F.col("event_type") == "purchase", "changed").otherwise("unchanged")
    )
    return t.events.select(F.col("user_id").alias("resource_id"), F.col("event_id").alias("run_id"), F.col("ts").alias("at"), outcome.alias("outcome"))


def state_sql(clears: str, missing_after: int) -> str:
    return f"""WITH runs AS (SELECT user_id AS resource_id, event_id AS run_id, ts AS seen_at, CASE WHEN event_type IN ('error', 'view') THEN 'error'
        WHEN event_type = 'purchase' THEN 'changed' ELSE 'unchanged' END AS outcome FROM events),
    w AS (SELECT *, count_if(outcome IN ({clears})) OVER (PARTITION BY resource_id ORDER BY seen_at DESC, run_id DESC) AS clears_after FROM runs),
    a AS (SELECT resource_id, count(*) AS runs, count_if(outcome = 'error' AND clears_after = 0) AS failures,
      arg_max(outcome, (seen_at, run_id)) AS last_outcome, max(seen_at) AS last_at, max(seen_at) FILTER (outcome <> 'error') AS seen FROM w GROUP BY 1)
    SELECT resource_id, runs, failures, CASE WHEN last_outcome <> 'error' THEN 'ready' WHEN failures >= {missing_after} THEN 'stale' ELSE 'refresh_error' END AS status,
      epoch_us(seen) AS last_seen_at, epoch_us(last_at + INTERVAL 3600 SECOND) AS next_refresh_at FROM a"""


def micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp")).alias(column)


@query("refresh_state", "K3", state_sql("'changed'", 3))
def refresh_state(spark, d):
    out = s.refresh_state(refresh_runs(Tables(spark, d)), 3600, 3)
    return out.select("resource_id", "runs", "failures", "status", micros("last_seen_at"), micros("next_refresh_at"))


@query("refresh_state_strict", "K3", state_sql("'changed', 'unchanged'", 2))
def refresh_state_strict(spark, d):
    out = s.refresh_state(refresh_runs(Tables(spark, d)), 3600, 2, strict=True)
    return out.select("resource_id", "runs", "failures", "status", micros("last_seen_at"), micros("next_refresh_at"))


def _order_resources(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("resource_id"), F.col("o_orderpriority").alias("collection_id"), F.col("o_orderdate").alias("last_seen_at")
    )


def _policies(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderpriority").alias("collection_id")).distinct().withColumn(
        "max_age_days", (F.substring("collection_id", 1, 1).cast("int") * 200)
    )


RETENTION_SQL = """
    res AS (SELECT o_orderkey AS resource_id, o_orderpriority AS collection_id, CAST(o_orderpriority[1] AS INT) * 200 AS max_age_days,
      o_orderdate < TIMESTAMP '2000-01-01' - to_days(CAST(o_orderpriority[1] AS INT) * 200) AS expired FROM orders)"""


@query(
    "retention_report",
    "K4",
    f"""WITH {RETENTION_SQL} SELECT collection_id, max_age_days, count_if(expired) AS matched_resources, count_if(expired) AS deleted_resources
    FROM res GROUP BY ALL""",
)
def retention_report(spark, d):
    t = Tables(spark, d)
    return s.retention_report(_order_resources(t), _policies(t), _ntz("2000-01-01"), dry_run=False)


@query(
    "retention_prune",
    "K4",
    f"""WITH {RETENTION_SQL} SELECT 'resources' AS table_name, count(*) AS rows FROM res WHERE NOT expired
    UNION ALL SELECT 'chunks', count(*) FROM lineitem JOIN res ON resource_id = l_orderkey WHERE NOT expired""",
)
def retention_prune(spark, d):
    t = Tables(spark, d)
    resources = _order_resources(t)
    gone = s.expired_resources(resources, _policies(t), _ntz("2000-01-01"))
    kept = s.retention_prune(resources, {"chunks": t.lineitem.withColumnRenamed("l_orderkey", "resource_id")}, gone)
    return s.platform_counts(kept).withColumnRenamed("metric", "table_name")


def _stats(t: Tables) -> DataFrame:
    n = F.col("doc_id")
    text = lambda p: F.concat(F.lit(p), n)
    docs = t.documents
    resources = docs.select(text("r").alias("resource_id"), F.col("source").alias("collection_id"), n.alias("first_seen_at"), (n + 10).alias("last_seen_at"))
    documents = docs.where("lang <> 'de'").select(text("d").alias("document_id"), text("r").alias("resource_id"))
    lines = docs.select(n, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    chunks = lines.select(F.concat(text("c"), F.lit("-"), "pos").alias("chunk_id"), text("d").alias("document_id"))
    vectors = t.embeddings.select(F.concat(F.lit("c"), "vec_id", F.lit("-0")).alias("chunk_id"), (F.col("vec_id") * 2).alias("created_at"))
    runs = t.events.select(
        F.concat(F.lit("src"), F.col("user_id") % 20).alias("collection_id"),
        F.when(F.col("event_type") == "view", "reindex").otherwise("ingest").alias("run_type"),
        F.when(F.col("event_id") % 3 == 0, "completed").otherwise("failed").alias("status"),
        F.col("event_id").alias("completed_at"),
    )
    return s.collection_stats(resources, documents, chunks, vectors, runs)


STATS_SQL = """
    docs AS (SELECT doc_id, source, lang <> 'de' AS kept, len(string_split(text, chr(10))) AS n, vec_id FROM documents LEFT JOIN embeddings ON vec_id = doc_id),
    stats AS (SELECT source AS collection_id, count(*) AS resources, count_if(kept) AS documents,
        CAST(coalesce(sum(n) FILTER (kept), 0) AS BIGINT) AS chunks, count(vec_id) FILTER (kept) AS embeddings, min(doc_id) AS first_seen_at,
        max(doc_id) + 10 AS last_seen_at, max(vec_id * 2) FILTER (kept) AS latest_embedding_at FROM docs GROUP BY source)"""


@query(
    "collection_stats",
    "K5",
    f"""WITH {STATS_SQL}, runs AS (SELECT 'src' || (user_id % 20) AS collection_id, max(event_id) AS latest_reindex_at FROM events
      WHERE event_type = 'view' AND event_id % 3 = 0 GROUP BY 1)
    SELECT * FROM stats LEFT JOIN runs USING (collection_id)""",
)
def collection_stats(spark, d):
    return _stats(Tables(spark, d))


@query(
    "delete_preview",
    "K6",
    f"""WITH {STATS_SQL} SELECT collection_id, resources, documents, chunks, embeddings, collection_id IN ('src1', 'src2') AS deleted FROM stats""",
)
def delete_preview(spark, d):
    t = Tables(spark, d)
    requests = t.documents.select(F.col("source").alias("collection_id")).distinct().withColumn("confirm", F.col("collection_id").isin("src1", "src2"))
    return s.delete_preview(_stats(t), requests)


@query("delete_collections", "K6", "SELECT doc_id, source AS collection_id FROM documents WHERE source NOT IN ('src1', 'src2')")
def delete_collections(spark, d):
    docs = Tables(spark, d).documents.select("doc_id", F.col("source").alias("collection_id"))
    preview = docs.select("collection_id").distinct().withColumn("deleted", F.col("collection_id").isin("src1", "src2"))
    return s.delete_collections(docs, preview).select("doc_id", "collection_id")


# Conversations as memory writes: the speaking role is the producer; a write cites documents.
def _writes(t: Tables) -> DataFrame:
    n, turn = F.col("conv_id"), F.col("turn")
    kind = F.when(turn % 4 == 0, "source_evidence").when(turn % 4 == 1, "agent_observation").when(turn % 4 == 2, "user_memory").otherwise("agent_note")
    return t.conversations.select(
        (n * 1000 + turn).alias("write_id"),
        F.concat(F.lit("m"), n % 3).alias("collection_id"),
        F.col("role").alias("consumer"),
        F.when(n % 13 == 0, "other").otherwise(F.col("role")).alias("producer"),
        kind.alias("kind"),
        n,
        turn,
        "text",
    )


def _memory_sources(t: Tables) -> DataFrame:
    n, turn = F.col("conv_id"), F.col("turn")
    rows = t.conversations.where(turn % 8 != 5)
    own = rows.select((n * 1000 + turn).alias("write_id"), F.when(n % 17 == 0, F.lit(-1)).otherwise(n * 1000 + turn - n % 2).alias("chunk_id"))
    return own.unionByName(rows.where(turn > 0).select((n * 1000 + turn).alias("write_id"), (n * 1000 + turn - 1).alias("chunk_id")))


def _memory_chunks(t: Tables) -> DataFrame:
    return t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), F.concat(F.lit("> "), "text").alias("text"))


MEMORY_SQL = r"""
    writes AS (SELECT conv_id * 1000 + turn AS write_id, conv_id AS n, turn, role AS consumer, CASE WHEN conv_id % 13 = 0 THEN 'other' ELSE role END AS producer,
      CASE turn % 4 WHEN 0 THEN 'source_evidence' WHEN 1 THEN 'agent_observation' WHEN 2 THEN 'user_memory' ELSE 'agent_note' END AS kind, text FROM conversations),
    sources AS (SELECT DISTINCT * FROM (
      SELECT conv_id * 1000 + turn AS write_id, CASE WHEN conv_id % 17 = 0 THEN -1 ELSE conv_id * 1000 + turn - conv_id % 2 END AS chunk_id
        FROM conversations WHERE turn % 8 <> 5
      UNION ALL SELECT conv_id * 1000 + turn, conv_id * 1000 + turn - 1 FROM conversations WHERE turn % 8 <> 5 AND turn > 0)),
    chunks AS (SELECT conv_id * 1000 + turn AS chunk_id, '> ' || text AS text FROM conversations)"""


@query(
    "validate_memories",
    "K7",
    rf"""WITH {MEMORY_SQL},
    checked AS (SELECT s.write_id, count(*) AS cited, count_if(c.chunk_id IS NULL) AS unknown,
      bool_or(coalesce(contains(c.text, regexp_replace(w.text, '^\s+|\s+$', '', 'g')), false)) AS verbatim
      FROM sources s JOIN writes w USING (write_id) LEFT JOIN chunks c ON c.chunk_id = s.chunk_id GROUP BY 1)
    SELECT write_id, kind, coalesce(cited, 0) AS cited,
      CASE WHEN kind = 'user_memory' AND consumer <> 'user' THEN 'writer_not_allowed'
        WHEN kind <> 'user_memory' AND n % 3 = 2 AND consumer = 'user' THEN 'writer_not_allowed'
        WHEN producer <> consumer THEN 'producer_mismatch' WHEN unknown > 0 THEN 'unknown_source'
        WHEN kind IN ('source_evidence', 'agent_observation') AND cited IS NULL THEN 'sources_required'
        WHEN kind = 'source_evidence' AND NOT coalesce(verbatim, false) THEN 'not_an_excerpt' ELSE 'ok' END AS code
    FROM writes LEFT JOIN checked USING (write_id)""",
)
def validate_memories(spark, d):
    t = Tables(spark, d)
    both = F.array(F.lit("user"), F.lit("assistant"), F.lit("system"))
    policies = t.conversations.select(F.concat(F.lit("m"), F.col("conv_id") % 3).alias("collection_id")).distinct().select(
        "collection_id",
        F.when(F.col("collection_id") == "m2", F.array(F.lit("assistant"), F.lit("system"))).otherwise(both).alias("memory_writers"),
        F.array(F.lit("user")).alias("user_memory_writers"),
    )
    return mem.validate_memories(_writes(t), _memory_sources(t), _memory_chunks(t), policies)


@query(
    "memory_conflicts",
    "K8",
    """WITH RECURSIVE w AS (SELECT conv_id * 1000 + turn AS write_id, conv_id % 20 AS subj, turn AS t_at,
        CASE WHEN (conv_id + turn) % 5 = 0 THEN 'reject' WHEN (conv_id + turn) % 5 < 3 THEN 'append' ELSE 'supersede' END AS policy
      FROM conversations),
    o AS (SELECT *, row_number() OVER (PARTITION BY subj ORDER BY t_at, write_id) AS i FROM w),
    fold AS (
      SELECT subj, i, CASE WHEN true THEN [write_id] END AS active, CAST([] AS BIGINT[]) AS closed, CAST([] AS BIGINT[]) AS refused FROM o WHERE i = 1
      UNION ALL
      SELECT f.subj, o.i,
        CASE WHEN policy = 'append' THEN list_append(active, write_id)
             WHEN policy = 'supersede' THEN list_append(active[:-2], write_id)
             WHEN len(active) > 0 THEN active ELSE list_append(active, write_id) END,
        CASE WHEN policy = 'supersede' AND len(active) > 0 THEN list_append(closed, active[-1]) ELSE closed END,
        CASE WHEN policy = 'reject' AND len(active) > 0 THEN list_append(refused, write_id) ELSE refused END
      FROM fold f JOIN o ON o.subj = f.subj AND o.i = f.i + 1),
    final AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY subj ORDER BY i DESC) = 1)
    SELECT unnest(active) AS write_id, 'active' AS status FROM final
    UNION ALL SELECT unnest(closed), 'superseded' FROM final UNION ALL SELECT unnest(refused), 'rejected' FROM final""",
)
def memory_conflicts(spark, d):
    n, turn = F.col("conv_id"), F.col("turn")
    writes = Tables(spark, d).conversations.select(
        (n * 1000 + turn).alias("write_id"),
        F.lit("m").alias("collection_id"),
        F.concat(F.lit("subject-"), n % 20).alias("subject_key"),
        turn.alias("at"),
        F.when((n + turn) % 5 == 0, "reject").when((n + turn) % 5 < 3, "append").otherwise("supersede").alias("policy"),
    )
    return mem.memory_conflicts(writes, F.floor(F.col("at") / 2)).select("write_id", "status")


@query(
    "memory_provenance",
    "K9",
    f"""WITH {MEMORY_SQL} SELECT 'memory:' || write_id AS record_id, 'chunk:' || s.chunk_id AS source_ref, 'derived_from' AS relation,
      c.text AS excerpt FROM sources s JOIN chunks c ON c.chunk_id = s.chunk_id""",
)
def memory_provenance(spark, d):
    t = Tables(spark, d)
    return mem.memory_provenance(_writes(t), _memory_sources(t), _memory_chunks(t)).drop("chunk_id")


@query(
    "refresh_history",
    "K10",
    """SELECT event_id AS run_id, epoch_us(ts) AS at FROM events WHERE user_id = 8 ORDER BY ts DESC, event_id DESC LIMIT 50""",
)
def refresh_history(spark, d):
    return s.refresh_history(refresh_runs(Tables(spark, d)), 8, 50).select("run_id", micros("at"))


@query(
    "platform_counts",
    "K11",
    """SELECT 'collections' AS metric, count(DISTINCT source) AS rows FROM documents
    UNION ALL SELECT 'resources', count(*) FROM pages UNION ALL SELECT 'documents', count(*) FROM documents
    UNION ALL SELECT 'chunks', CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) FROM documents
    UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'index_jobs', count(*) FROM events""",
)
def platform_counts(spark, d):
    t = Tables(spark, d)
    return s.platform_counts(
        {
            "collections": t.documents.select("source").distinct(),
            "resources": t.pages,
            "documents": t.documents,
            "chunks": t.documents.select(F.explode(F.split("text", "\n"))),
            "embeddings": t.embeddings,
            "index_jobs": t.events,
        }
    )
