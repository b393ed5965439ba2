"""Continuous ingestion: new documents become chunks and pending embeddings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from dossier.operators.ingest import Ingested
from dossier.operators.stores import append_new
from dossier.session import work_folder
from dossier.streaming.tables import read_versions, run_batches, write_version

KEYS = {"resources": "resource_id", "documents": "document_id", "chunks": "chunk_id", "provenance": "chunk_id"}


def stream_ingest(documents: DataFrame, ingest: Callable[[DataFrame], Ingested], purpose: str = "ingest") -> dict[str, DataFrame]:
    """Ingest each batch and append only the rows whose key is not stored yet.

    Returns the stored tables after everything available has been processed. Chunks of the
    newest versions without a vector are the pending embeddings.
    """
    spark = documents.sparkSession
    folder = work_folder(spark, purpose)
    sample = ingest(spark.createDataFrame([], documents.schema))
    schemas = {name: getattr(sample, name).schema for name in KEYS}

    def each(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        out = ingest(batch)
        for name, key in KEYS.items():
            stored = read_versions(session, f"{folder}/{name}", schemas[name], before=batch_id)
            write_version(append_new(stored, getattr(out, name), key).select(*schemas[name].names), f"{folder}/{name}", batch_id)

    run_batches(documents, each, folder)
    return {name: read_versions(spark, f"{folder}/{name}", schemas[name]).drop("version") for name in KEYS}
