"""Agent memory: write validation, conflict policies and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.text import strip
from dossier.operators.ordered import with_next

EVIDENCE_KINDS = ("source_evidence", "agent_observation")


def validate_memories(writes: DataFrame, sources: DataFrame, chunks: DataFrame, policies: DataFrame) -> DataFrame:
    """Code per write: writer lists, producer, required sources, verbatim evidence.

    writes: write_id, collection_id, consumer, producer, kind, text; sources: write_id,
    chunk_id; chunks: chunk_id, text; policies: collection_id, memory_writers,
    user_memory_writers (arrays).
    """
    cited = sources.where(F.coalesce(F.col("chunk_id").cast("string"), F.lit("")) != "").select("write_id", "chunk_id").distinct()
    texts = chunks.select("chunk_id", F.col("text").alias("source_text"), F.lit(True).alias("known"))
    checked = (
        cited.join(texts, "chunk_id", "left")
        .join(writes.select("write_id", strip(F.col("text")).alias("needle")), "write_id")
        .groupBy("write_id")
        .agg(
            F.count("*").alias("cited"),
            F.count_if(F.col("known").isNull()).alias("unknown"),
            F.bool_or(F.coalesce(F.contains("source_text", "needle"), F.lit(False))).alias("verbatim"),
        )
    )
    joined = writes.join(policies, "collection_id", "left").join(checked, "write_id", "left")
    listed = lambda c: F.coalesce(F.array_contains(c, F.col("consumer")), F.lit(False))
    may_write = F.when(F.col("kind") == "user_memory", listed("user_memory_writers")).otherwise(listed("memory_writers"))
    none = F.coalesce("cited", F.lit(0)) == 0
    code = (
        F.when(~may_write, "writer_not_allowed")
        .when(F.col("producer") != F.col("consumer"), "producer_mismatch")
        .when(F.coalesce("unknown", F.lit(0)) > 0, "unknown_source")
        .when(F.col("kind").isin(*EVIDENCE_KINDS) & none, "sources_required")
        .when((F.col("kind") == "source_evidence") & ~F.coalesce("verbatim", F.lit(False)), "not_an_excerpt")
        .otherwise("ok")
    )
    return joined.select("write_id", "kind", F.coalesce("cited", F.lit(0)).alias("cited"), code.alias("code"))


def memory_conflicts(writes: DataFrame, bucket: Column) -> DataFrame:
    """Outcome per write of a subject under its conflict policy, in order of (at, write_id).

    append keeps everything; reject refuses when the subject already has an active memory;
    supersede closes the newest active one. The newest active memory of a subject is always
    the last accepted write, and a subject stays active once written, so the ordered fold has
    a closed form: a reject is accepted only as the first write, and an accepted write is
    superseded exactly when the next accepted one supersedes. ``bucket`` (non-decreasing in
    ``at``) spreads a busy subject; writes without a subject never conflict.
    """
    subject = ["collection_id", "subject_key"]
    when = F.struct("at", "write_id")
    free = writes.where(F.coalesce("subject_key", F.lit("")) == "").withColumn("status", F.lit("active"))
    keyed = writes.where(F.coalesce("subject_key", F.lit("")) != "")
    firsts = keyed.groupBy(*subject).agg(F.min(when).alias("__first"))
    marked = keyed.join(firsts, subject).withColumn(
        "__refused", (F.col("policy") == "reject") & (when > F.col("__first"))
    )
    accepted = with_next(
        marked.where(~F.col("__refused")), subject, ["at", "write_id"], bucket, ["policy"], "__next"
    ).withColumn(
        "status",
        F.when(F.coalesce(F.col("__next.policy") == "supersede", F.lit(False)), "superseded").otherwise("active"),
    )
    refused = marked.where("__refused").withColumn("status", F.lit("rejected"))
    cols = [*writes.columns, "status"]
    return accepted.select(cols).unionByName(refused.select(cols)).unionByName(free.select(cols))


def memory_provenance(
    memories: DataFrame, sources: DataFrame, chunks: DataFrame, excerpt_chars: int | None = None
) -> DataFrame:
    """One derived_from edge per memory and source chunk, with its text (or the first ``excerpt_chars``)."""
    return (
        memories.select("write_id")
        .join(sources.select("write_id", "chunk_id").distinct(), "write_id")
        .join(chunks.select("chunk_id", "text"), "chunk_id")
        .select(
            F.concat(F.lit("memory:"), F.col("write_id").cast("string")).alias("record_id"),
            "chunk_id",
            F.concat(F.lit("chunk:"), F.col("chunk_id").cast("string")).alias("source_ref"),
            F.lit("derived_from").alias("relation"),
            (F.col("text") if excerpt_chars is None else F.substring("text", 1, excerpt_chars)).alias("excerpt"),
        )
    )
