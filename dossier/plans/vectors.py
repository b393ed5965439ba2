"""Embedding and vector-search queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.operators import neighbours
from dossier.operators import vectors as v
from dossier.plans import sqltext as q
from dossier.plans.ingest import DOC_IDS_SQL, ingested_documents
from dossier.plans.registry import Tables, query

# Stored vectors of the fixture: provider by label parity, collection by label.
EMB_SQL = """
emb AS (
  SELECT vec_id AS chunk_id, 'c' || label AS collection_id, 'hash' AS provider,
    CASE WHEN label < 3 THEN 'm1' ELSE 'm2' END AS model, CAST(embedding AS DOUBLE[]) AS vector, label FROM embeddings
)"""


def stored(t: Tables):
    return t.embeddings.select(
        F.col("vec_id").alias("chunk_id"),
        F.concat(F.lit("c"), "label").alias("collection_id"),
        F.lit("hash").alias("provider"),
        F.when(F.col("label") < 3, "m1").otherwise("m2").alias("model"),
        F.col("embedding").alias("vector"),
        "label",
    )


def first_vector(t: Tables) -> list[float]:
    row = t.embeddings.orderBy("vec_id").select("embedding").first()
    return list(row.embedding)


@query(
    "hashing_embed",
    "C1",
    rf"""WITH toks AS (SELECT doc_id, unnest({q.tokens("text")}) AS tok FROM documents),
    counted AS (SELECT doc_id, tok, count(*) AS n FROM toks GROUP BY ALL),
    words AS (SELECT DISTINCT tok FROM counted),
    parts AS (
      SELECT tok, tok AS piece, 1 + least(length(tok), 24) / 24.0::DOUBLE AS w FROM words
      UNION ALL SELECT tok, substr(tok, 1, 6), 0.5 FROM words WHERE length(tok) >= 6),
    hashed AS (
      SELECT tok, CAST('0x' || substr(sha256(piece), 1, 8) AS BIGINT) % 256 AS bucket,
        w * CASE WHEN CAST('0x' || substr(sha256(piece), 9, 2) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END AS w FROM parts),
    summed AS (SELECT doc_id, bucket, sum(n * w) AS s FROM counted JOIN hashed USING (tok) GROUP BY ALL),
    normed AS (SELECT doc_id, sqrt(sum(s * s)) AS size FROM summed GROUP BY doc_id)
    SELECT doc_id, bucket, round(s / size, 6) + 0.0 AS value FROM summed JOIN normed USING (doc_id)
    WHERE abs(s / size) >= 0.0001""",
)
def hashing_embed(spark, d):
    docs = v.embed_texts(Tables(spark, d).documents, "doc_id", "text")
    return (
        docs.select("doc_id", F.posexplode("vector").alias("bucket", "raw"))
        .where(F.abs("raw") >= 0.0001)
        .select("doc_id", F.col("bucket").cast("long"), (F.round("raw", 6) + 0.0).alias("value"))
    )


@query(
    "cosine_topk",
    "C2",
    f"""WITH {EMB_SQL}, probe AS (SELECT CAST(embedding AS DOUBLE[]) AS qv FROM embeddings ORDER BY vec_id LIMIT 1),
    top AS (SELECT chunk_id, list_cosine_similarity(vector, qv) AS s FROM emb, probe
      WHERE model = 'm1' ORDER BY s DESC, chunk_id LIMIT 10)
    SELECT chunk_id, round(s, 6) AS score, row_number() OVER (ORDER BY s DESC, chunk_id) AS rank FROM top""",
)
def cosine_topk(spark, d):
    t = Tables(spark, d)
    hits = v.cosine_topk(stored(t), first_vector(t), 10, provider="hash", model="m1")
    return hits.select("chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


@query(
    "cosine_topk_scoped",
    "C3",
    f"""WITH {EMB_SQL}, probe AS (SELECT CAST(embedding AS DOUBLE[]) AS qv FROM embeddings ORDER BY vec_id LIMIT 1),
    top AS (SELECT chunk_id, list_cosine_similarity(vector, qv) AS s FROM emb, probe
      WHERE collection_id IN ('c0', 'c2', 'c4', 'c7') AND chunk_id IN (SELECT doc_id FROM labels WHERE quality = 1)
      ORDER BY s DESC, chunk_id LIMIT 20)
    SELECT chunk_id, round(s, 6) AS score, row_number() OVER (ORDER BY s DESC, chunk_id) AS rank FROM top""",
)
def cosine_topk_scoped(spark, d):
    t = Tables(spark, d)
    allowed = t.labels.where("quality = 1").select(F.col("doc_id").alias("chunk_id"))
    hits = v.cosine_topk(
        stored(t), first_vector(t), 20, collections=["c0", "c2", "c4", "c7"], allowed_ids=allowed
    )
    return hits.select("chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


EXACT_KNN_SQL = """
    pairs AS (
      SELECT a.vec_id AS query_id, b.vec_id AS chunk_id,
        round(list_cosine_similarity(CAST(b.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])), 12) AS s
      FROM embeddings a, embeddings b),
    exact AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM pairs
      QUALIFY rank <= 5)"""


def _self_queries(t: Tables):
    return t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _self_vectors(t: Tables):
    return t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))


@query(
    "knn_join",
    "C4",
    f"WITH {EXACT_KNN_SQL} SELECT query_id, chunk_id, round(s, 6) AS score, rank FROM exact",
)
def knn_join(spark, d):
    t = Tables(spark, d)
    return neighbours.knn_join(_self_queries(t), _self_vectors(t), 5).select(
        "query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long")
    )


@query(
    "probed_recall_at_k",
    "C5",
    f"""WITH {EXACT_KNN_SQL},
    cents AS (
      SELECT row_number() OVER (ORDER BY sha256(CAST(vec_id AS VARCHAR))) AS list_id, CAST(embedding AS DOUBLE[]) AS cv
      FROM embeddings QUALIFY list_id <= 26),
    near AS (
      SELECT vec_id, list_id, row_number() OVER (PARTITION BY vec_id ORDER BY
        round(list_cosine_similarity(cv, CAST(embedding AS DOUBLE[])), 12) DESC, list_id) AS place
      FROM embeddings, cents),
    probes AS (SELECT vec_id AS query_id, list_id FROM near WHERE place <= 5),
    lists AS (SELECT vec_id AS chunk_id, list_id FROM near WHERE place = 1),
    approx AS (
      SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank
      FROM pairs JOIN probes USING (query_id) JOIN lists USING (list_id, chunk_id) QUALIFY rank <= 5),
    per AS (SELECT e.query_id, count(a.chunk_id) / count(*) AS recall FROM exact e
      LEFT JOIN approx a ON a.query_id = e.query_id AND a.chunk_id = e.chunk_id GROUP BY e.query_id)
    SELECT count(*) AS queries, round(avg(recall), 6) AS mean_recall, round(min(recall), 6) AS min_recall FROM per""",
)
def probed_recall_at_k(spark, d):
    t = Tables(spark, d)
    queries, vectors = _self_queries(t), _self_vectors(t)
    centroids = v.pick_centroids(vectors, 26)
    out = v.recall_at_k(neighbours.knn_join(queries, vectors, 5), v.probed_topk(queries, vectors, 5, centroids, 5))
    return out.select("queries", F.round("mean_recall", 6).alias("mean_recall"), F.round("min_recall", 6).alias("min_recall"))


COVERAGE_SQL = """
    coverage AS (
      SELECT source AS collection_id, count(vec_id) AS covered, count(*) AS total FROM documents
      LEFT JOIN (SELECT vec_id FROM embeddings WHERE label < 3 AND len(embedding) = 64) ON vec_id = doc_id
      GROUP BY source)"""


def _doc_chunks(t: Tables):
    return t.documents.select(F.col("source").alias("collection_id"), F.col("doc_id").alias("chunk_id"))


@query("embedding_coverage", "C6", f"WITH {COVERAGE_SQL} SELECT * FROM coverage")
def embedding_coverage(spark, d):
    t = Tables(spark, d)
    return v.embedding_coverage(_doc_chunks(t), stored(t), "hash", "m1", 64)


@query(
    "dimension_audit",
    "C7",
    f"""WITH {EMB_SQL}, cut AS (
      SELECT collection_id, provider, model,
        CASE WHEN label = 1 AND chunk_id % 10 = 3 THEN 32 WHEN label = 4 AND chunk_id % 10 = 5 THEN 0 ELSE len(vector) END
          AS dim FROM emb)
    SELECT collection_id, provider, model, count(*) AS vectors, count(DISTINCT dim) AS dimensions,
      min(dim) AS min_dimension, max(dim) AS max_dimension,
      CASE WHEN min(dim) < 1 THEN 'empty' WHEN count(DISTINCT dim) > 1 THEN 'inconsistent' ELSE 'ok' END AS verdict
    FROM cut GROUP BY ALL""",
)
def dimension_audit(spark, d):
    size = (
        F.when((F.col("label") == 1) & (F.col("chunk_id") % 10 == 3), 32)
        .when((F.col("label") == 4) & (F.col("chunk_id") % 10 == 5), 0)
        .otherwise(F.size("vector"))
    )
    return v.dimension_audit(stored(Tables(spark, d)).withColumn("vector", F.slice("vector", F.lit(1), size)))


@query(
    "pending_chunks",
    "C8",
    """SELECT source AS collection_id, doc_id AS chunk_id FROM documents
    WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE label < 3)""",
)
def pending_chunks(spark, d):
    t = Tables(spark, d)
    return v.pending_chunks(_doc_chunks(t), stored(t), "hash", "m1").select("collection_id", "chunk_id")


REVISION_CHUNKS_SQL = f"""{DOC_IDS_SQL}, rows AS (
      SELECT source AS collection_id, {q.sid("'chunk'", "document_id", f"sha256({q.norm('text')})", "'0'")} AS chunk_id,
        sha256({q.norm("text")}) AS content_hash FROM docs WHERE {q.norm("text")} <> '')"""
REVISION_HEADER_SQL = (
    "'provider=hashing' || chr(10) || 'model=local-hash-v1' || chr(10) || 'dimension=256' || chr(10) || 'language=simple'"
)


def _revision_chunks(t: Tables):
    return ingested_documents(t, pre_chunked=True).chunks.withColumn("language", F.lit("simple"))


@query(
    "index_revision",
    "C9",
    f"""WITH {REVISION_CHUNKS_SQL}
    SELECT collection_id, CAST(sum(n) AS BIGINT) AS lines, sha256({REVISION_HEADER_SQL} || chr(10) ||
      string_agg(h, chr(10) ORDER BY b)) AS revision
    FROM (SELECT collection_id, substr(chunk_id, 1, 5) AS b, count(*) AS n,
            sha256(string_agg(chunk_id || ':' || content_hash, chr(10) ORDER BY chunk_id)) AS h FROM rows GROUP BY ALL)
    GROUP BY collection_id""",
)
def index_revision(spark, d):
    return v.index_revision(_revision_chunks(Tables(spark, d)), "hashing", "local-hash-v1", 256)


@query(
    "index_revision_two_level",
    "C9",
    f"""WITH {REVISION_CHUNKS_SQL}, buckets AS (
      SELECT collection_id, substr(chunk_id, 1, 5) AS b, count(*) AS n,
        sha256(string_agg(chunk_id || ':' || content_hash, chr(10) ORDER BY chunk_id)) AS h FROM rows GROUP BY ALL)
    SELECT collection_id, CAST(sum(n) AS BIGINT) AS lines, sha256({REVISION_HEADER_SQL} || chr(10) ||
      string_agg(h, chr(10) ORDER BY b)) AS revision FROM buckets GROUP BY collection_id""",
)
def index_revision_two_level(spark, d):
    """The same digest when the rows come in another order and dealt over other partitions."""
    chunks = _revision_chunks(Tables(spark, d)).repartition(7, "content_hash").sortWithinPartitions(F.desc("chunk_id"))
    return v.index_revision(chunks, "hashing", "local-hash-v1", 256)


@query(
    "reindex_needed",
    "C9",
    """SELECT source AS collection_id, bool_or(lang = 'de') AS reindex FROM documents
    WHERE regexp_replace(text, '\\s+', '', 'g') <> '' GROUP BY source""",
)
def reindex_needed(spark, d):
    t = Tables(spark, d)
    now = _revision_chunks(t)
    german = t.documents.where("lang = 'de'").select(F.concat(F.lit("doc://"), "doc_id").alias("canonical_uri"))
    before = now.join(german, "canonical_uri", "left_anti")
    contract = ("hashing", "local-hash-v1", 256)
    return v.needs_reindex(v.index_revision(now, *contract), v.index_revision(before, *contract)).drop("revision")


@query(
    "activation_report",
    "C10",
    f"""WITH {COVERAGE_SQL} SELECT *, covered = total AS can_activate,
      CASE WHEN total = 0 THEN 'empty' WHEN covered = total THEN 'completed' ELSE 'incomplete' END AS status
    FROM coverage""",
)
def activation_report(spark, d):
    t = Tables(spark, d)
    return v.activation_report(v.embedding_coverage(_doc_chunks(t), stored(t), "hash", "m1", 64))
