"""Integrity audits of exported chunks and stored originals, and fact preservation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions import ids
from dossier.functions.text import normalize_text, strip


def _codes(pairs: list[tuple[Column, str]]) -> Column:
    """Sorted array of the codes whose condition holds."""
    flags = [F.when(F.coalesce(cond, F.lit(True)), F.lit(code)) for cond, code in pairs]
    return F.array_sort(F.array_compact(F.array(*flags)))


def audit_chunk_export(documents: DataFrame, chunks: DataFrame, group: str) -> DataFrame:
    """Recompute chunk hashes and offsets of an export, one verdict per ``group``.

    documents: group, resource_id, document_id, text; chunks: document_id, chunk_id,
    chunk_text, content_hash, char_start, char_end. Document and chunk findings are
    reduced per group before they meet, so no text is shuffled twice.
    """
    doc_codes = _codes(
        [
            (F.coalesce("resource_id", F.lit("")) == "", "MISSING_RESOURCE_ID"),
            (F.coalesce("document_id", F.lit("")) == "", "MISSING_DOCUMENT_ID"),
            (F.col("text").isNull(), "MISSING_DOCUMENT_TEXT"),
        ]
    )
    docs = documents.groupBy(group).agg(
        F.count_distinct("resource_id").alias("resources"),
        F.count("*").alias("documents"),
        F.flatten(F.collect_set(doc_codes)).alias("__doc_codes"),
    )
    norm = documents.select(group, "document_id", normalize_text(F.col("text")).alias("__norm"))
    # Chunks of a document that is not exported have no group: they are one row of their own.
    joined = chunks.join(norm, "document_id", "left")
    hash_ok = F.coalesce(
        F.sha2("chunk_text", 256) == F.lower("content_hash"), F.lit(False)
    )
    offset_ok = F.coalesce(
        (F.col("char_start") >= 0)
        & (F.col("char_start") < F.col("char_end"))
        & (F.col("char_end") <= F.char_length("__norm"))
        & (
            F.trim(F.substring(F.col("__norm"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start")))
            == F.col("chunk_text")
        ),
        F.lit(False),
    )
    checked = joined.select(
        group,
        hash_ok.alias("hash_ok"),
        offset_ok.alias("offset_ok"),
        (F.coalesce("chunk_id", F.lit("")) == "").alias("no_id"),
    )
    found = checked.groupBy(group).agg(
        F.count("*").alias("chunks"),
        F.count_if("hash_ok").alias("matching_chunk_hashes"),
        F.count_if("offset_ok").alias("matching_normalized_offsets"),
        F.bool_or("no_id").alias("__no_id"),
    )
    merged = docs.join(found, group, "full_outer").na.fill(
        0, ["resources", "documents", "chunks", "matching_chunk_hashes", "matching_normalized_offsets"]
    )
    codes = F.array_sort(
        F.array_distinct(
            F.concat(
                F.coalesce("__doc_codes", F.array().cast("array<string>")),
                _codes(
                    [
                        (F.col("documents") == 0, "ORPHAN_CHUNK"),
                        (F.coalesce("__no_id", F.lit(False)), "MISSING_CHUNK_ID"),
                        (F.col("matching_chunk_hashes") < F.col("chunks"), "CHUNK_HASH_MISMATCH_OR_MISSING_TEXT"),
                        (F.col("matching_normalized_offsets") < F.col("chunks"), "NORMALIZED_OFFSET_MISMATCH"),
                        (F.col("chunks") == 0, "NO_CHUNKS"),
                    ]
                ),
            )
        )
    )
    return merged.select(
        group,
        "resources",
        "documents",
        "chunks",
        "matching_chunk_hashes",
        "matching_normalized_offsets",
        codes.alias("error_codes"),
    ).withColumn("verified", (F.size("error_codes") == 0) & (F.col("chunks") > 0))


def audit_binary_identity(files: DataFrame, exported: DataFrame, exported_documents: DataFrame) -> DataFrame:
    """Compare original bytes with the stored resource and document ids and hashes.

    files: file_key, content, expected_collection, expected_source_type, expected_uri,
    expected_revision; exported: file_key, resource_id, source_type, canonical_uri,
    content_hash, notice_revision; exported_documents: file_key, document_id, content_hash.
    """
    expected = files.select(
        "file_key",
        "expected_source_type",
        "expected_uri",
        "expected_revision",
        F.sha2("content", 256).alias("digest"),
        ids.resource_id(
            F.col("expected_collection"), F.col("expected_source_type"), F.col("expected_uri")
        ).alias("expected_resource"),
    ).withColumn("expected_document", ids.document_id(F.col("expected_resource"), F.col("digest")))
    docs = (
        exported_documents.join(expected.select("file_key", "digest", "expected_document"), "file_key")
        .groupBy("file_key")
        .agg(
            F.count("*").alias("checked_documents"),
            F.count_if(
                (F.lower("content_hash") == F.col("digest")) & (F.col("document_id") == F.col("expected_document"))
            ).alias("matching"),
        )
    )
    full = (
        expected.join(exported, "file_key", "left")
        .join(docs, "file_key", "left")
        .na.fill(0, ["checked_documents", "matching"])
    )
    binary = _codes(
        [
            (F.col("canonical_uri") != F.col("expected_uri"), "CANONICAL_URI_MISMATCH"),
            (F.col("source_type") != F.col("expected_source_type"), "SOURCE_TYPE_MISMATCH"),
            (F.col("resource_id") != F.col("expected_resource"), "RESOURCE_ID_MISMATCH"),
            (F.lower("content_hash") != F.col("digest"), "RESOURCE_BINARY_HASH_MISMATCH"),
            (F.col("checked_documents") == 0, "NO_DOCUMENTS"),
            (F.col("matching") != 1, "ORIGINAL_DOCUMENT_HASH_OR_ID_MISMATCH"),
        ]
    )
    revision = F.coalesce(
        (strip(F.col("expected_revision")) != "") & (F.col("notice_revision") == F.col("expected_revision")),
        F.lit(False),
    )
    return full.select(
        "file_key",
        (F.size(binary) == 0).alias("binary_matches_store"),
        revision.alias("notice_revision_matches"),
        "checked_documents",
        F.array_sort(
            F.concat(
                binary,
                F.when(revision, F.array().cast("array<string>")).otherwise(
                    F.array(F.lit("NOTICE_REVISION_NOT_INDEPENDENTLY_MATCHED"))
                ),
            )
        ).alias("error_codes"),
    )


def fact_preservation(cases: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per case: fact in the document, in a chunk, and with its context in one chunk.

    cases: case_id, artifact_id, fact, context; documents: artifact_id, text;
    chunks: artifact_id, ordinal, chunk_text.
    """
    in_source = cases.join(documents, "artifact_id", "left").select(
        "case_id", F.coalesce(F.contains("text", "fact"), F.lit(False)).alias("source_contains_fact")
    )
    with_fact = F.contains("chunk_text", "fact")
    with_context = with_fact & F.contains("chunk_text", "context")
    in_chunks = (
        cases.join(chunks, "artifact_id", "left")
        .groupBy("case_id")
        .agg(
            F.coalesce(F.bool_or(with_fact), F.lit(False)).alias("chunk_contains_fact"),
            F.coalesce(F.bool_or(with_context), F.lit(False)).alias("context_preserved"),
            F.coalesce(
                F.min(F.when(with_context, F.col("ordinal"))), F.min(F.when(with_fact, F.col("ordinal")))
            ).alias("first_ordinal"),
        )
    )
    return in_source.join(in_chunks, "case_id")


def fact_rates(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count("*").alias("cases"),
        F.avg(F.col("source_contains_fact").cast("int")).alias("source_rate"),
        F.avg(F.col("chunk_contains_fact").cast("int")).alias("chunk_rate"),
        F.avg(F.col("context_preserved").cast("int")).alias("context_rate"),
    )
