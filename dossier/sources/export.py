"""Paged, nested export of one collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _nested(df: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """One row per key with its child rows as an array sorted by ``order``."""
    rest = [c for c in df.columns if c not in (key, order)]
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, *rest))).alias(name))


def export_collection(
    resources: DataFrame,
    documents: DataFrame,
    chunks: DataFrame,
    records: DataFrame,
    provenance: DataFrame,
    collection_id: str,
    include_content: bool = False,
    offset: int = 0,
    limit: int = 100,
) -> DataFrame:
    """A page of resources by id with their documents, chunks, records and provenance.

    The page is cut first; children are semi-joined to it before any text is grouped.
    """
    if offset < 0 or not 1 <= limit <= 1000:
        raise ValueError("offset must be non-negative and limit between 1 and 1000")
    scoped = resources.where(F.col("collection_id") == collection_id)
    page = scoped.orderBy("resource_id").offset(offset).limit(limit)
    page_ids = page.select("resource_id")
    content = lambda c: (F.col(c) if include_content else F.lit(None).cast("string")).alias(c)

    docs = documents.join(page_ids, "resource_id", "left_semi").select(
        "resource_id", "document_id", "title", content("text"), "media_type", "content_hash", "extraction_status"
    )
    cut = chunks.join(docs.select("document_id"), "document_id", "left_semi").select(
        "document_id",
        "ordinal",
        "chunk_id",
        content("chunk_text"),
        "content_hash",
        "char_start",
        "char_end",
        "token_estimate",
    )
    docs = docs.join(_nested(cut, "document_id", "ordinal", "chunks"), "document_id", "left")
    recs = records.join(page_ids, "resource_id", "left_semi").select(
        "resource_id", "record_id", "record_type", content("data"), "revision", "review_status"
    )
    prov = provenance.join(page_ids, "resource_id", "left_semi").select(
        "resource_id", "chunk_id", "document_id", "source_ref", "content_hash"
    )
    total = scoped.agg(F.count("*").alias("total_resources"))
    return (
        page.join(_nested(docs, "resource_id", "document_id", "documents"), "resource_id", "left")
        .join(_nested(recs, "resource_id", "record_id", "records"), "resource_id", "left")
        .join(_nested(prov, "resource_id", "chunk_id", "provenance"), "resource_id", "left")
        .withColumn("total_resources", total.scalar())
        .withColumn("has_more", F.lit(offset + limit) < F.col("total_resources"))
    )


def write_export(export: DataFrame, path: str) -> None:
    export.write.mode("errorifexists").json(path)
