"""Turn raw texts and pages into resources, documents, chunks and provenance."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions import ids
from dossier.functions.text import html_to_text, strip
from dossier.operators.chunking import (
    CHUNK_MIN,
    CHUNK_OVERLAP,
    CHUNK_SIZE,
    chunk_documents,
    whole_text_chunks,
)


class Ingested(NamedTuple):
    resources: DataFrame
    documents: DataFrame
    chunks: DataFrame
    provenance: DataFrame


def identify(
    df: DataFrame, collection: Column, source_type: str, uri: Column, text: Column, raw: Column
) -> DataFrame:
    """Add collection, ids, content hash of the raw bytes and extraction status."""
    with_source = (
        df.withColumn("collection_id", collection)
        .withColumn("source_type", F.lit(source_type))
        .withColumn("canonical_uri", uri)
        .withColumn("text", text)
        .withColumn("content_hash", F.sha2(raw, 256))
    )
    resource = ids.resource_id(F.col("collection_id"), F.col("source_type"), F.col("canonical_uri"))
    return (
        with_source.withColumn("resource_id", resource)
        .withColumn("document_id", ids.document_id(F.col("resource_id"), F.col("content_hash")))
        .withColumn(
            "extraction_status",
            F.when(strip(F.coalesce("text", F.lit(""))) == "", "empty").otherwise("extracted"),
        )
    )


def ingest(
    identified: DataFrame,
    media_type: str = "text/plain",
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    minimum: int = CHUNK_MIN,
    pre_chunked: bool = False,
) -> Ingested:
    """Split identified rows into the four stored tables."""
    if "title" not in identified.columns:
        identified = identified.withColumn("title", F.col("canonical_uri"))
    resources = identified.select(
        "resource_id", "collection_id", "source_type", "canonical_uri", "content_hash"
    )
    documents = identified.select(
        "document_id",
        "resource_id",
        "title",
        "text",
        "content_hash",
        F.lit(media_type).alias("media_type"),
        "extraction_status",
    )
    keys = ["document_id", "resource_id", "collection_id", "canonical_uri", "document_hash"]
    source = identified.withColumn("document_hash", F.col("content_hash"))
    if pre_chunked:
        cut = whole_text_chunks(source, keys)
    else:
        cut = chunk_documents(source, keys, "text", size, overlap, minimum)
    chunks = cut.withColumn(
        "chunk_id", ids.chunk_id(F.col("document_id"), F.col("content_hash"), F.col("ordinal"))
    )
    provenance = chunks.select(
        "resource_id",
        "document_id",
        "chunk_id",
        F.col("canonical_uri").alias("source_ref"),
        F.col("document_hash").alias("content_hash"),
    )
    return Ingested(resources, documents, chunks.drop("document_hash"), provenance)


def ingest_texts(
    df: DataFrame, collection: Column, uri: Column, text: Column, source_type: str = "file", **options
) -> Ingested:
    return ingest(identify(df, collection, source_type, uri, text, text), **options)


def ingest_pages(df: DataFrame, collection: Column, url: Column, html: Column, **options) -> Ingested:
    """Stored web pages: the hash is over the markup, the text is its visible part."""
    identified = identify(df, collection, "url", url, html_to_text(html), html)
    return ingest(identified, media_type="text/html", **options)
