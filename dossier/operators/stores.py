"""Merging new rows into stored tables without a transactional table format."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_new(target: DataFrame, incoming: DataFrame, key: str | Sequence[str], order: str | None = None) -> DataFrame:
    """Incoming rows whose key is not stored; of several rows of a key the first by ``order``.

    Without an order it is the row that sorts first by all its columns (as JSON), so the choice
    does not depend on how the rows are dealt.
    """
    keys = [key] if isinstance(key, str) else list(key)
    row = F.struct(*incoming.columns)
    place = F.to_json(row) if order is None else F.struct(F.col(order), F.to_json(row))
    first = incoming.groupBy(*keys).agg(F.min_by(row, place).alias("__row")).select("__row.*")
    return first.join(target.select(*keys), keys, "left_anti")


def refresh_resources(target: DataFrame, incoming: DataFrame, seen_at) -> DataFrame:
    """Stored resources with hash, status and last_seen taken from the incoming rows.

    Both: resource_id, content_hash, status, first_seen, last_seen. A full outer join
    on the key; rows absent from the input are kept as they are.
    """
    new = incoming.select("resource_id", F.col("content_hash").alias("__hash"), F.lit(True).alias("__hit"))
    joined = target.join(new, "resource_id", "full_outer")
    hit = F.coalesce("__hit", F.lit(False))
    return joined.select(
        "resource_id",
        F.when(hit, F.col("__hash")).otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(hit, F.lit("ready")).otherwise(F.col("status")).alias("status"),
        F.coalesce("first_seen", seen_at).alias("first_seen"),
        F.when(hit, seen_at).otherwise(F.col("last_seen")).alias("last_seen"),
    )


EMBEDDING_KEY = ("chunk_id", "provider", "model")


def invalid_embeddings(incoming: DataFrame) -> DataFrame:
    """Rows an upsert must refuse: blank ids, empty vectors, ids repeated in the batch."""
    empty = incoming.where(
        F.col("chunk_id").isNull() | (F.col("chunk_id").cast("string") == "") | (F.size("vector") < 1)
    ).select("chunk_id", F.lit("empty").alias("reason"))
    repeated = (
        incoming.groupBy(*EMBEDDING_KEY)
        .count()
        .where("count > 1")
        .select("chunk_id", F.lit("repeated").alias("reason"))
    )
    return empty.unionByName(repeated)


def upsert_embeddings(target: DataFrame, incoming: DataFrame) -> DataFrame:
    """Replace or add vectors by (chunk, provider, model); ids and creation data survive.

    A batch with a key twice, without an id or with an empty vector is refused as a whole.
    """
    blank = F.col("chunk_id").isNull() | (F.col("chunk_id").cast("string") == "") | (F.coalesce(F.size("__vector"), F.lit(0)) < 1)
    new = incoming.groupBy(*EMBEDDING_KEY).agg(F.count("*").alias("__rows"), F.max("vector").alias("__vector"))
    checked = (
        F.when(F.col("__rows") > 1, F.raise_error(F.lit("upsert refused: repeated embedding key")))
        .when(blank, F.raise_error(F.lit("upsert refused: blank id or empty vector")))
        .otherwise(F.col("__vector"))
    )
    new = new.select(*EMBEDDING_KEY, checked.alias("__vector"))
    joined = target.join(new, list(EMBEDDING_KEY), "full_outer")
    vector = F.coalesce("__vector", "vector")
    kept = [c for c in target.columns if c not in (*EMBEDDING_KEY, "vector", "dimension")]
    return joined.select(
        *EMBEDDING_KEY, vector.alias("vector"), F.size(vector).alias("dimension"), *kept
    )
