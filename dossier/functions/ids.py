"""Stable identifiers: sha256 over NUL-joined parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(*parts: Column | str) -> Column:
    """sha256 hex of the parts joined by NUL; plain strings are literals, nulls count as ''."""
    columns = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws("\u0000", *columns), 256)


def line_id(*parts: Column) -> Column:
    """sha256 hex of the parts joined by newline, nulls as empty strings."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def text_hash(column: Column) -> Column:
    return F.sha2(column.cast("string"), 256)


def resource_id(collection: Column, source_type: Column, uri: Column) -> Column:
    return stable_id("resource", collection, source_type, uri)


def document_id(resource: Column, content_hash: Column) -> Column:
    return stable_id("document", resource, content_hash)


def chunk_id(document: Column, content_hash: Column, ordinal: Column) -> Column:
    return stable_id("chunk", document, content_hash, ordinal)
