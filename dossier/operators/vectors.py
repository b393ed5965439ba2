"""Hashing embeddings, exact and list-probing vector search, and embedding coverage."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from dossier.functions.text import computed_once
from dossier.operators.blocks import ARROW, CELLS, PART, TaskTopK, in_parts, kind_of, spread, top_k
from dossier.operators.digests import sorted_digest

# Fixed values of the hashing embedding: prefix length and weights.
PREFIX = 6
PREFIX_WEIGHT = 0.5
LENGTH_CAP = 24

_TOKEN = re.compile(r"[\w\-]+", re.UNICODE)
_CACHE_LIMIT = 500_000


class _HashingEmbedder:
    """Signed token buckets of one text; the buckets of a word are remembered."""

    def __init__(self, dimension: int) -> None:
        self.dimension = dimension
        self.known: dict[str, tuple[list[int], list[float]]] = {}

    def _slot(self, word: str) -> tuple[int, float]:
        digest = hashlib.sha256(word.encode()).digest()
        return int.from_bytes(digest[:4], "big") % self.dimension, 1.0 - 2.0 * (digest[4] & 1)

    def _parts(self, word: str) -> tuple[list[int], list[float]]:
        bucket, sign = self._slot(word)
        buckets, values = [bucket], [sign * (1.0 + min(len(word), LENGTH_CAP) / LENGTH_CAP)]
        if len(word) >= PREFIX:
            bucket, sign = self._slot(word[:PREFIX])
            buckets.append(bucket)
            values.append(sign * PREFIX_WEIGHT)
        return buckets, values

    def __call__(self, value: str | None) -> np.ndarray:
        buckets: list[int] = []
        weights: list[float] = []
        for word in _TOKEN.findall((value or "").lower()):
            hit = self.known.get(word)
            if hit is None:
                if len(self.known) >= _CACHE_LIMIT:
                    self.known.clear()
                hit = self.known[word] = self._parts(word)
            buckets += hit[0]
            weights += hit[1]
        if not buckets:
            return np.zeros(self.dimension)
        vector = np.bincount(buckets, weights=weights, minlength=self.dimension)
        size = np.sqrt(vector @ vector)
        return vector / size if size else vector


def hashing_embed(text: Column, dimension: int = 256) -> Column:
    """Unit vector of signed token buckets; texts without tokens give the zero vector.

    An Arrow batch function: the vector is local to one text, so the whole step is
    narrow. Exploding tokens and summing buckets in SQL would shuffle every token.
    """

    @computed_once
    @F.pandas_udf(ArrayType(DoubleType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embedder = _HashingEmbedder(dimension)
        for batch in batches:
            yield batch.map(embedder)

    return embed(text)


def embed_texts(df: DataFrame, key: str, text: str, dimension: int = 256) -> DataFrame:
    """(key, vector) of every text."""

    def run(batches):
        embedder = _HashingEmbedder(dimension)
        for batch in in_parts(batches, PART):
            rows = [embedder(value) for value in batch.column(1).to_pylist()]
            flat = np.concatenate(rows) if rows else np.zeros(0)
            offsets = np.arange(len(rows) + 1, dtype=np.int32) * dimension
            vectors = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), vectors], names=[key, "vector"])

    return spread(df.select(key, text), key).mapInArrow(run, f"{key} {kind_of(df, key)}, vector array<double>")


def matrix_of(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def units_of(vectors) -> np.ndarray:
    block = np.asarray(vectors, dtype=np.float64)
    return block / np.linalg.norm(block, axis=1, keepdims=True)


def scores_of(matrix: np.ndarray, units: np.ndarray) -> np.ndarray:
    """Cosine of each row with each unit query; 0 for zero rows; rounded so equal vectors tie."""
    sizes = np.linalg.norm(matrix, axis=1)
    sizes[sizes == 0] = np.inf
    return np.round((matrix @ units.T) / sizes[:, None], 12)


def cosine_topk(
    embeddings: DataFrame,
    query: Sequence[float],
    k: int,
    collections: Sequence[str] | None = None,
    provider: str | None = None,
    model: str | None = None,
    allowed_ids: DataFrame | None = None,
) -> DataFrame:
    """Exact top-k of one query inside a scope; order: score descending, chunk_id.

    Scope predicates reach the scan; an allow-list is a semi join before scoring. A zero query matches nothing.
    """
    scoped = embeddings.where(F.size("vector") == len(query))
    if provider is not None:
        scoped = scoped.where(F.col("provider") == provider)
    if model is not None:
        scoped = scoped.where(F.col("model") == model)
    if collections is not None:
        scoped = scoped.where(F.col("collection_id").isin(list(collections)))
    if allowed_ids is not None:
        scoped = scoped.join(allowed_ids.select("chunk_id"), "chunk_id", "left_semi")
    one = np.asarray([query], np.float64)
    if not one.any():
        scoped = scoped.limit(0)
    kind = kind_of(embeddings, "chunk_id")

    def run(batches):
        units = units_of(one)
        kept = TaskTopK([0], k)
        for batch in batches:
            if batch.num_rows:
                ids = np.asarray(batch.column(0).to_pylist())
                kept.add_matrix(scores_of(matrix_of(batch.column(1)), units), ids)
        for hits in kept.batches("int", kind):
            yield hits.select(["chunk_id", "score"])

    best_first = [F.desc("score"), F.col("chunk_id")]
    hits = scoped.select("chunk_id", "vector").mapInArrow(run, f"chunk_id {kind}, score double")
    # k rows at most, so that one task may number them.
    return hits.orderBy(*best_first).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*best_first)))


def assign_lists(vectors: DataFrame, key: str, centroids: list[list[float]], probes: int = 1) -> DataFrame:
    """The ``probes`` nearest centroids of each vector: key, vector, list_id."""
    units = units_of(centroids)
    kind = kind_of(vectors, key)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            near = np.argsort(-scores_of(matrix_of(batch.column(1)), units), axis=1, kind="stable")[:, :probes]
            rows = np.repeat(np.arange(batch.num_rows), near.shape[1])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows)),
                    batch.column(1).take(pa.array(rows)),
                    pa.array(near.reshape(-1).astype(np.int32)),
                ],
                names=[key, "vector", "list_id"],
            )

    return vectors.select(key, F.col("vector").cast("array<double>")).mapInArrow(
        run, f"{key} {kind}, vector array<double>, list_id int"
    )


def _salted(df: DataFrame, key: str, rows_per_salt: int, own: str, other: str, other_counts: DataFrame) -> DataFrame:
    """Split each list's rows over ``own`` salts and repeat them for every ``other`` salt."""
    counts = df.groupBy("list_id").agg(F.ceil(F.count("*") / rows_per_salt).cast("int").alias("__n"))
    return (
        df.join(counts, "list_id")
        .join(other_counts.withColumnRenamed("__n", "__m"), "list_id")
        .withColumn(own, F.pmod(F.xxhash64(key), F.col("__n")).cast("int"))
        .withColumn(other, F.explode(F.sequence(F.lit(0), F.col("__m") - 1)))
        .drop("__n", "__m")
    )


def best_of_group(vectors: pa.Table, queries: pa.Table, k: int, query_kind: str, id_kind: str) -> pa.Table:
    """query_id, chunk_id, score: the best k vectors for every query; scores are made a stretch of vectors at a time."""
    batches: list[pa.RecordBatch] = []
    if vectors.num_rows and queries.num_rows:
        ids = np.asarray(vectors.column("chunk_id").to_pylist())
        matrix = matrix_of(vectors.column("vector").combine_chunks())
        units = units_of(matrix_of(queries.column("vector").combine_chunks()))
        kept = TaskTopK(queries.column("query_id").to_pylist(), k)
        step = max(1, CELLS // len(units))
        for start in range(0, len(ids), step):
            part = slice(start, start + step)
            kept.add_matrix(scores_of(matrix[part], units), ids[part])
        batches = list(kept.batches(query_kind, id_kind))
    schema = pa.schema([("query_id", ARROW[query_kind]), ("chunk_id", ARROW[id_kind]), ("score", pa.float64())])
    return pa.Table.from_batches(batches, schema)


def probed_topk(
    queries: DataFrame, vectors: DataFrame, k: int, centroids: list[list[float]], probes: int, rows: int = 20_000
) -> DataFrame:
    """Approximate top-k: score only the vectors in the lists nearest to each query.

    Lists are an equi-join key. Both sides of a crowded list are split into salts, and a
    group emits its best k per query, never its pairs.
    """
    query_kind, id_kind = kind_of(queries, "query_id"), kind_of(vectors, "chunk_id")
    left = assign_lists(vectors, "chunk_id", centroids)
    right = assign_lists(queries, "query_id", centroids, probes)
    size = lambda df: df.groupBy("list_id").agg(F.ceil(F.count("*") / rows).cast("int").alias("__n"))
    left_salted = _salted(left, "chunk_id", rows, "v_salt", "q_salt", size(right))
    right_salted = _salted(right, "query_id", rows, "q_salt", "v_salt", size(left))

    def score(vector_table, query_table):
        return best_of_group(vector_table, query_table, k, query_kind, id_kind)

    keys = ["list_id", "v_salt", "q_salt"]
    scored = (
        left_salted.groupBy(*keys)
        .cogroup(right_salted.groupBy(*keys))
        .applyInArrow(score, f"query_id {query_kind}, chunk_id {id_kind}, score double")
    )
    return top_k(scored, "query_id", [F.desc("score"), F.col("chunk_id")], k)


def pick_centroids(vectors: DataFrame, lists: int) -> list[list[float]]:
    """``lists`` stored vectors chosen by the hash of their id (a bounded, repeatable sample)."""
    picked = vectors.orderBy(F.sha2(F.col("chunk_id").cast("string"), 256)).limit(lists).select("vector").collect()
    return [list(r.vector) for r in picked]


def recall_at_k(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """Per query |exact ∩ approximate| / |exact|, then mean and minimum over the queries."""
    found = approximate.select("query_id", "chunk_id", F.lit(1).alias("hit"))
    per_query = (
        exact.join(found, ["query_id", "chunk_id"], "left")
        .groupBy("query_id")
        .agg((F.count("hit") / F.count("*")).alias("recall"))
    )
    return per_query.agg(
        F.count("*").alias("queries"), F.avg("recall").alias("mean_recall"), F.min("recall").alias("min_recall")
    )


def embedding_coverage(chunks: DataFrame, embeddings: DataFrame, provider: str, model: str, dimension: int) -> DataFrame:
    """Per collection: chunks with a vector of the contract, and all chunks."""
    have = (
        embeddings.where(
            (F.col("provider") == provider) & (F.col("model") == model) & (F.size("vector") == dimension)
        )
        .select("chunk_id", F.lit(1).alias("__have"))
        .dropDuplicates(["chunk_id"])
    )
    return (
        chunks.select("collection_id", "chunk_id")
        .join(have, "chunk_id", "left")
        .groupBy("collection_id")
        .agg(F.count("__have").alias("covered"), F.count("*").alias("total"))
    )


def activation_report(coverage: DataFrame) -> DataFrame:
    """A switch of the active embedding is allowed only when every chunk is covered."""
    done = F.col("covered") == F.col("total")
    return coverage.select(
        "*",
        done.alias("can_activate"),
        F.when(F.col("total") == 0, "empty").when(done, "completed").otherwise("incomplete").alias("status"),
    )


def dimension_audit(embeddings: DataFrame) -> DataFrame:
    """Per (collection, provider, model): number of distinct dimensions and a verdict."""
    return (
        embeddings.groupBy("collection_id", "provider", "model")
        .agg(
            F.count("*").alias("vectors"),
            F.count_distinct(F.size("vector")).alias("dimensions"),
            F.min(F.size("vector")).alias("min_dimension"),
            F.max(F.size("vector")).alias("max_dimension"),
        )
        .withColumn(
            "verdict",
            F.when(F.col("min_dimension") < 1, "empty").when(F.col("dimensions") > 1, "inconsistent").otherwise("ok"),
        )
    )


def pending_chunks(chunks: DataFrame, embeddings: DataFrame, provider: str, model: str) -> DataFrame:
    """Chunks that still lack a vector of the active provider and model."""
    have = embeddings.where((F.col("provider") == provider) & (F.col("model") == model)).select("chunk_id")
    return chunks.join(have, "chunk_id", "left_anti")


def index_revision(chunks: DataFrame, provider: str, model: str, dimension: int) -> DataFrame:
    """Digest of the contract header and the sorted ``chunk_id:content_hash`` lines per collection."""
    header = F.concat(
        F.lit(f"provider={provider}\nmodel={model}\ndimension={dimension}\nlanguage="), F.col("language")
    )
    return sorted_digest(
        chunks,
        ["collection_id", "language"],
        "chunk_id",
        F.concat_ws(":", "chunk_id", "content_hash"),
        header,
    ).select("collection_id", "lines", F.col("digest").alias("revision"))


def needs_reindex(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Collections whose revision differs from the stored one."""
    return current.join(stored.select("collection_id", F.col("revision").alias("__old")), "collection_id", "left").select(
        "collection_id",
        "revision",
        (F.col("__old").isNull() | (F.col("__old") != F.col("revision"))).alias("reindex"),
    )
