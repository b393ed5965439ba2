"""Access decisions, relevance feedback, claim checks and research source outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.text import strip

# The three feedback labels.
LABELS = ("relevant", "partially_relevant", "not_relevant")


def consumer_tenants(keys: DataFrame, now: Column) -> DataFrame:
    """consumer_id -> tenant from active, unexpired keys; several tenants are ambiguous."""
    live = keys.where(
        (F.col("status") == "active")
        & (F.coalesce("tenant_id", F.lit("")) != "")
        & (F.col("expires_at").isNull() | (F.col("expires_at") > now))
    )
    # min and max tell one tenant from several with a plain partial aggregation.
    return live.groupBy("consumer_id").agg(
        F.min("tenant_id").alias("tenant_id"), (F.min("tenant_id") != F.max("tenant_id")).alias("ambiguous")
    )


def authorize(requests: DataFrame, policies: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """Decision per (consumer_id, collection_id) request.

    policies: collection_id, tenant_id, allowed_consumers array. A tenant policy must match
    the consumer's tenant; an allow-list, if present, must name the consumer.
    """
    tenants = consumer_tenants(keys, now).withColumnRenamed("tenant_id", "own_tenant")
    joined = requests.join(policies, "collection_id", "left").join(tenants, "consumer_id", "left")
    policy_tenant = strip(F.coalesce("tenant_id", F.lit("")))
    allowed = F.filter(F.coalesce("allowed_consumers", F.array().cast("array<string>")), lambda c: c != "")
    wrong_tenant = (policy_tenant != "") & (F.coalesce("own_tenant", F.lit("")) != policy_tenant)
    not_listed = (F.size(allowed) > 0) & ~F.array_contains(allowed, F.col("consumer_id"))
    return joined.select(
        "consumer_id",
        "collection_id",
        F.when((policy_tenant != "") & F.coalesce("ambiguous", F.lit(False)), "ambiguous")
        .when(wrong_tenant | not_listed, "denied")
        .otherwise("allowed")
        .alias("decision"),
    )


def validate_feedback(feedback: DataFrame, chunks: DataFrame, documents: DataFrame, resources: DataFrame) -> DataFrame:
    """Check label and the chunk → document → resource → collection chain; hash the query."""
    chain = (
        feedback.join(chunks.select("chunk_id", F.col("document_id").alias("__doc")), "chunk_id", "left")
        .join(documents.select("document_id", F.col("resource_id").alias("__res")), "document_id", "left")
        .join(resources.select("resource_id", F.col("collection_id").alias("__col")), "resource_id", "left")
    )
    code = (
        F.when(~F.col("label").isin(*LABELS), "invalid_label")
        .when(F.col("__doc").isNull() | F.col("__res").isNull() | F.col("__col").isNull(), "missing_target")
        .when(F.col("__doc") != F.col("document_id"), "chunk_document_mismatch")
        .when(F.col("__res") != F.col("resource_id"), "document_resource_mismatch")
        .when(F.col("__col") != F.col("collection_id"), "outside_collection")
        .otherwise("ok")
    )
    return (
        chain.withColumn("code", code)
        .withColumn("query_hash", F.sha2(strip(F.col("query")), 256))
        .drop("query", "__doc", "__res", "__col")
    )


def feedback_summary(feedback: DataFrame) -> DataFrame:
    """Counts per label and in total, absent labels as 0."""
    return feedback.groupBy("collection_id").agg(
        F.count_if(F.col("label").isin(*LABELS)).alias("total"),
        *[F.count_if(F.col("label") == label).alias(label) for label in LABELS],
    )


def feedback_latest(feedback: DataFrame, collection_id: str, k: int | None = None) -> DataFrame:
    """Newest feedback first, ties by id descending; the first ``k`` rows when given."""
    found = feedback.where(F.col("collection_id") == collection_id).orderBy(F.desc("created_at"), F.desc("feedback_id"))
    return found if k is None else found.limit(k)


def validate_claims(answers: DataFrame, claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Verdict per answer: each claim cites something, all of it supplied as evidence.

    answers: answer_id, answer, abstained; claims: answer_id, claim_no, chunk_ids;
    evidence: answer_id, chunk_id.
    """
    cited = claims.select("answer_id", "claim_no", F.explode(F.array_distinct("chunk_ids")).alias("chunk_id"))
    outside = (
        cited.join(evidence.select("answer_id", "chunk_id"), ["answer_id", "chunk_id"], "left_anti")
        .groupBy("answer_id")
        .agg(F.count("*").alias("outside"))
    )
    per_answer = claims.groupBy("answer_id").agg(
        F.count("*").alias("claims"), F.count_if(F.coalesce(F.size("chunk_ids"), F.lit(0)) < 1).alias("uncited")
    )
    joined = answers.join(per_answer, "answer_id", "left").join(outside, "answer_id", "left")
    joined = joined.na.fill(0, ["claims", "uncited", "outside"])
    code = (
        F.when(F.col("uncited") > 0, "uncited_claim")
        .when(F.col("outside") > 0, "outside_evidence")
        .when((F.coalesce("answer", F.lit("")) != "") & (F.col("claims") == 0) & ~F.col("abstained"), "no_claims")
        .otherwise("ok")
    )
    return joined.select("answer_id", "claims", "uncited", "outside", code.alias("code"))


def research_sources(discovered: DataFrame, ingest_log: DataFrame) -> DataFrame:
    """Discovered URIs once each, at their best rank, with their ingestion outcome.

    discovered: run_id, rank, uri, title; ingest_log: uri, error (null when it went well).
    """
    firsts = (
        discovered.withColumn("uri", strip(F.coalesce("uri", F.lit(""))))
        .where("uri <> ''")
        .groupBy("run_id", "uri")
        .agg(F.min("rank").alias("rank"), F.min_by("title", "rank").alias("title"))
    )
    log = ingest_log.select("uri", "error", F.lit(True).alias("__tried")).dropDuplicates(["uri"])
    return firsts.join(log, "uri", "left").select(
        "run_id",
        "uri",
        "rank",
        "title",
        (F.coalesce("__tried", F.lit(False)) & F.col("error").isNull()).alias("ingested"),
        F.when(F.col("__tried").isNull(), F.lit("NotAttempted")).otherwise(F.col("error")).alias("error"),
    )


def research_summary(sources: DataFrame) -> DataFrame:
    return sources.groupBy("run_id").agg(
        F.count("*").alias("attempted"),
        F.count_if("ingested").alias("ingested"),
        F.count_if(~F.col("ingested")).alias("failed"),
        F.when(F.count_if(~F.col("ingested")) > 0, "partial").otherwise("executed").alias("status"),
    )
