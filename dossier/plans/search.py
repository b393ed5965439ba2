"""Fusion, hybrid search, feedback and evidence queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.operators import evidence as ev
from dossier.operators import fusion as fu
from dossier.operators.vectors import embed_texts
from dossier.plans import sqltext as q
from dossier.plans.ingest import DOC_IDS_SQL, ingested_documents
from dossier.plans.lexical import COUNT_PAIRS_SQL, benchmark_queries, untitled_documents
from dossier.plans.registry import Tables, query

EMBED_SQL = rf"""
    all_texts AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents
      UNION ALL SELECT 'q', item_id, text FROM benchmark),
    toks AS (SELECT kind, id, unnest({q.tokens("text")}) AS tok FROM all_texts),
    counted AS (SELECT kind, id, tok, count(*) AS n FROM toks GROUP BY ALL),
    words AS (SELECT DISTINCT tok FROM counted),
    word_parts AS (
      SELECT tok, tok AS piece, 1 + least(length(tok), 24) / 24.0::DOUBLE AS w FROM words
      UNION ALL SELECT tok, substr(tok, 1, 6), 0.5 FROM words WHERE length(tok) >= 6),
    hashed AS (
      SELECT tok, CAST('0x' || substr(sha256(piece), 1, 8) AS BIGINT) % 256 AS bucket,
        w * CASE WHEN CAST('0x' || substr(sha256(piece), 9, 2) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END AS w
      FROM word_parts),
    summed AS (SELECT kind, id, bucket, sum(n * w) AS s FROM counted JOIN hashed USING (tok) GROUP BY ALL),
    sizes AS (SELECT kind, id, sqrt(sum(s * s)) AS size FROM summed GROUP BY ALL),
    dots AS (SELECT a.id AS query_id, b.id AS chunk_id, sum(a.s * b.s) AS dot FROM summed a JOIN summed b USING (bucket)
      WHERE a.kind = 'q' AND b.kind = 'd' GROUP BY ALL),
    vector_pairs AS (
      SELECT i.item_id AS query_id, d.doc_id AS chunk_id,
        CASE WHEN zb.size > 0 AND za.size > 0 THEN round(coalesce(dot, 0) / (za.size * zb.size), 12) ELSE 0 END AS score
      FROM benchmark i CROSS JOIN documents d
      LEFT JOIN dots ON dots.query_id = i.item_id AND dots.chunk_id = d.doc_id
      LEFT JOIN sizes za ON za.kind = 'q' AND za.id = i.item_id
      LEFT JOIN sizes zb ON zb.kind = 'd' AND zb.id = d.doc_id)"""


@query(
    "hybrid_search",
    "E2",
    f"""WITH {COUNT_PAIRS_SQL}, {EMBED_SQL},
    lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM count_pairs
      WHERE score > 0 QUALIFY r <= 30),
    vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM vector_pairs
      QUALIFY r <= 30),
    lists AS (SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + r) AS g, score AS lexical, NULL AS vector FROM lex
      UNION ALL SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + r), NULL, score FROM vec),
    fused AS (SELECT query_id, chunk_id, sum(g) AS fusion, max(lexical) AS lexical, max(vector) AS vector
      FROM lists GROUP BY ALL)
    SELECT query_id, chunk_id, round(fusion, 6) AS fusion, lexical, round(vector, 6) AS vector,
      row_number() OVER (PARTITION BY query_id ORDER BY round(fusion, 12) DESC, chunk_id) AS rank
    FROM fused QUALIFY rank <= 10""",
)
def hybrid_search(spark, d):
    t = Tables(spark, d)
    docs = untitled_documents(t)
    vectors = embed_texts(docs, "chunk_id", "text")
    hits = fu.hybrid_search(fu.query_variants(benchmark_queries(t)), docs, vectors, limit=10)
    return hits.select(
        "query_id",
        "chunk_id",
        F.round("fusion", 6).alias("fusion"),
        "lexical",
        F.round("vector", 6).alias("vector"),
        F.col("rank").cast("long"),
    )


@query(
    "hybrid_search_variants",
    "E2",
    f"""WITH benchmark AS (
      SELECT item_id * 10 AS item_id, text FROM main.benchmark
      UNION ALL SELECT item_id * 10 + 1, substr(text, length(text) // 2 + 1) FROM main.benchmark), {COUNT_PAIRS_SQL},
    lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM count_pairs
      WHERE score > 0 QUALIFY r <= 20),
    fused AS (SELECT query_id // 10 AS query_id, chunk_id,
        sum(CASE WHEN query_id % 10 = 0 THEN 1.0::DOUBLE ELSE 0.5 END / (60 + r)) AS fusion, max(score) AS lexical
      FROM lex GROUP BY ALL)
    SELECT query_id, chunk_id, round(fusion, 6) AS fusion, lexical,
      row_number() OVER (PARTITION BY query_id ORDER BY round(fusion, 12) DESC, chunk_id) AS rank
    FROM fused QUALIFY rank <= 5""",
)
def hybrid_search_variants(spark, d):
    t = Tables(spark, d)
    queries = benchmark_queries(t)
    half = F.floor(F.char_length("query") / 2).cast("int")
    variants = queries.select(
        "query_id", F.lit(1).alias("variant_no"), F.substring(F.col("query"), half + 1, F.char_length("query")).alias("query")
    )
    docs = untitled_documents(t)
    hits = fu.hybrid_search(
        fu.query_variants(queries, variants), docs, docs.select("chunk_id"), limit=5, mode="lexical"
    )
    return hits.select(
        "query_id", "chunk_id", F.round("fusion", 6).alias("fusion"), "lexical", F.col("rank").cast("long")
    )


# Ranked lists per source, made from the documents themselves.
LISTS_SQL = """
    by_size AS (SELECT source AS query_id, doc_id AS chunk_id, CAST(n_chars AS DOUBLE) AS score,
      row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 50),
    by_hash AS (SELECT source AS query_id, doc_id AS chunk_id, CAST(doc_id AS DOUBLE) / 7 AS score,
      row_number() OVER (PARTITION BY source ORDER BY sha256(text), doc_id) AS rank FROM documents QUALIFY rank <= 50)"""


def _lists(t: Tables):
    docs = t.documents
    size = fu.top_k(docs, "source", [F.desc("n_chars"), F.col("doc_id")], 50).select(
        F.col("source").alias("query_id"), F.col("doc_id").alias("chunk_id"), F.col("n_chars").cast("double").alias("score"), "rank"
    )
    digest = fu.top_k(docs.withColumn("h", F.sha2("text", 256)), "source", [F.col("h"), F.col("doc_id")], 50).select(
        F.col("source").alias("query_id"),
        F.col("doc_id").alias("chunk_id"),
        (F.col("doc_id").cast("double") / 7).alias("score"),
        "rank",
    )
    return size, digest


@query(
    "rrf_fuse",
    "E1",
    f"""WITH {LISTS_SQL}, lists AS (
      SELECT query_id, chunk_id, 0.7::DOUBLE / (60 + rank) AS g, score AS lexical, NULL AS vector FROM by_size
      UNION ALL SELECT query_id, chunk_id, 0.3::DOUBLE / (60 + rank), NULL, score FROM by_hash),
    fused AS (SELECT query_id, chunk_id, sum(g) AS fusion, max(lexical) AS lexical, max(vector) AS vector
      FROM lists GROUP BY ALL)
    SELECT query_id, chunk_id, round(fusion, 6) AS fusion, lexical, round(vector, 6) AS vector,
      row_number() OVER (PARTITION BY query_id ORDER BY round(fusion, 12) DESC, chunk_id) AS rank FROM fused""",
)
def rrf_fuse(spark, d):
    size, digest = _lists(Tables(spark, d))
    out = fu.ranked(fu.rrf_fuse([(size, "lexical", 0.7), (digest, "vector", 0.3)]))
    return out.select(
        "query_id",
        "chunk_id",
        F.round("fusion", 6).alias("fusion"),
        "lexical",
        F.round("vector", 6).alias("vector"),
        F.col("rank").cast("long"),
    )


DICTIONARY = [
    (1, "the", 1, "a certain"),
    (1, "the", 2, "this"),
    (2, "of", 1, "from"),
    (3, "with that", 1, "and"),
    (4, "in", 1, "inside"),
    (5, "ting", 1, "thing"),
]
_DICT_VALUES = ", ".join(f"({a}, '{b}', {c}, '{e}')" for a, b, c, e in DICTIONARY)
_WB = r"[\p{L}\p{N}_]"


@query(
    "expand_queries",
    "E3",
    rf"""WITH dict(term_no, term, replacement_no, replacement) AS (VALUES {_DICT_VALUES}),
    hits AS (
      SELECT item_id AS query_id, term_no, replacement_no, 'dictionary:' || term AS source, text AS original,
        trim(regexp_replace(text, '(?is)(^|[^\p{{L}}\p{{N}}_])' || term || '($|[^\p{{L}}\p{{N}}_])',
          '\1' || replacement || '\2'), chr(32) || chr(10) || chr(9)) AS query
      FROM benchmark, dict
      WHERE regexp_matches(text, '(?is)(^|[^\p{{L}}\p{{N}}_])' || term || '($|[^\p{{L}}\p{{N}}_])')),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY query_id, lower(query) ORDER BY term_no, replacement_no) AS rn
      FROM hits WHERE lower(query) <> lower(trim(original)))
    SELECT query_id, query, source, row_number() OVER (PARTITION BY query_id ORDER BY term_no, replacement_no) AS variant_no
    FROM firsts WHERE rn = 1 QUALIFY variant_no <= 4""",
)
def expand_queries(spark, d):
    dictionary = spark.createDataFrame(DICTIONARY, "term_no int, term string, replacement_no int, replacement string")
    return fu.expand_queries(benchmark_queries(Tables(spark, d)), dictionary, 4).withColumn(
        "variant_no", F.col("variant_no").cast("long")
    )


GROUPS = [
    {"id": "articles", "aliases": ["the", "la", "der"], "ambiguous": ["la"], "contexts": ["des", "que"], "exclusions": ["license"]},
    {"id": "numbers", "aliases": ["of the", "un"], "ambiguous": [], "contexts": [], "exclusions": ["und"]},
]


def _has(term: str) -> str:
    return rf"regexp_matches(t, '(?is)(^|[^\p{{L}}\p{{N}}_]){term}($|[^\p{{L}}\p{{N}}_])')"


def _found(words: list[str]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {_has(w)} THEN '{w}' END" for w in words) + ")"


@query(
    "tag_terminology",
    "E4",
    f"""WITH d AS (SELECT doc_id AS chunk_id, text AS t FROM documents)
    SELECT chunk_id, 'articles' AS group_id, {_found(["the", "la", "der"])} AS terms, {_found(["des", "que"])} AS contexts
    FROM d WHERE NOT {_has("license")} AND ({_has("the")} OR {_has("der")} OR ({_has("la")} AND ({_has("des")} OR {_has("que")})))
    UNION ALL
    SELECT chunk_id, 'numbers', {_found(["of the", "un"])}, '' FROM d
    WHERE NOT {_has("und")} AND ({_has("of the")} OR {_has("un")})""",
)
def tag_terminology(spark, d):
    chunks = Tables(spark, d).texts.select(F.col("doc_id").alias("chunk_id"), "text")
    return fu.tag_terminology(chunks, GROUPS).select(
        "chunk_id", "group_id", F.array_join("terms", ",").alias("terms"), F.array_join("contexts", ",").alias("contexts")
    )


def _hits(t: Tables):
    """A hit list per language, ranked by size: query_id, chunk_id, canonical_uri, collection_id, rank."""
    return fu.top_k(t.documents, "lang", [F.desc("n_chars"), F.col("doc_id")], 300).select(
        F.col("lang").alias("query_id"),
        F.col("doc_id").alias("chunk_id"),
        F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.concat("source", F.lit("/"), F.col("doc_id") % 40)).alias("canonical_uri"),
        F.concat(F.lit("c"), F.col("doc_id") % 3).alias("collection_id"),
        "rank",
    )


HITS_SQL = """
    hits AS (SELECT lang AS query_id, doc_id AS chunk_id,
      CASE WHEN doc_id % 9 = 0 THEN '' ELSE source || '/' || (doc_id % 40) END AS uri, 'c' || (doc_id % 3) AS collection_id,
      row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 300)"""


@query(
    "collapse_by_uri",
    "E5",
    f"""WITH {HITS_SQL}, f AS (
      SELECT *, row_number() OVER (PARTITION BY query_id, CASE WHEN uri = '' THEN CAST(chunk_id AS VARCHAR) ELSE uri END
        ORDER BY rank) AS rn FROM hits)
    SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM f WHERE rn = 1
    QUALIFY place <= 60""",
)
def collapse_by_uri(spark, d):
    return fu.collapse_by_uri(_hits(Tables(spark, d)), 60).select("query_id", "chunk_id", F.col("place").cast("long"))


@query(
    "federated_dedupe",
    "E6",
    f"""WITH {HITS_SQL}, f AS (
      SELECT *, first_value(collection_id) OVER (PARTITION BY query_id, uri ORDER BY rank) AS winner FROM hits)
    SELECT query_id, chunk_id, collection_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM f
    WHERE uri = '' OR winner = collection_id QUALIFY place <= 100""",
)
def federated_dedupe(spark, d):
    hits = _hits(Tables(spark, d)).withColumn(
        "canonical_uri", F.when(F.col("canonical_uri") != "", F.concat(F.lit("  "), "canonical_uri")).otherwise("")
    )
    return fu.federated_dedupe(hits, 100).select("query_id", "chunk_id", "collection_id", F.col("place").cast("long"))


RERANK_QUERY = "the la of des und in que el"


@query(
    "rerank",
    "E7",
    f"""WITH {HITS_SQL}, cut AS (
      SELECT query_id, chunk_id, rank, list_distinct(string_split({q.norm("lower(source || chr(10) || text)")}, ' '))
        AS words FROM hits JOIN documents ON doc_id = chunk_id),
    s AS (SELECT query_id, chunk_id, rank, CASE WHEN rank <= 40 THEN
        len(list_intersect(string_split('{RERANK_QUERY}', ' '), words)) / 8.0::DOUBLE END AS rerank FROM cut)
    SELECT query_id, chunk_id, round(rerank, 6) AS rerank, row_number() OVER (PARTITION BY query_id ORDER BY rerank IS NULL,
      rerank DESC, CASE WHEN rerank IS NOT NULL THEN chunk_id END, rank) AS place FROM s""",
)
def rerank(spark, d):
    t = Tables(spark, d)
    texts = t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("title"), "text")
    hits = _hits(t).join(texts, "chunk_id").withColumn("query", F.lit(RERANK_QUERY))
    return fu.rerank(hits, fu.token_overlap, 40).select(
        "query_id", "chunk_id", F.round("rerank", 6).alias("rerank"), F.col("place").cast("long")
    )


@query(
    "hydrate_hits",
    "E8",
    f"""WITH {DOC_IDS_SQL}, {LISTS_SQL}
    SELECT b.query_id, b.rank, d.document_id, d.resource_id, d.uri AS canonical_uri, d.source AS collection_id,
      substr({q.norm("d.text")}, 1, 280) AS preview
    FROM by_size b JOIN docs d ON d.doc_id = b.chunk_id WHERE {q.norm("d.text")} <> ''""",
)
def hydrate_hits(spark, d):
    t = Tables(spark, d)
    out = ingested_documents(t, pre_chunked=True)
    size, _ = _lists(t)
    by_uri = out.chunks.select("chunk_id", "canonical_uri")
    hits = (
        size.withColumn("canonical_uri", F.concat(F.lit("doc://"), "chunk_id"))
        .drop("chunk_id")
        .join(by_uri, "canonical_uri")
        .select("query_id", "chunk_id", "rank")
    )
    full = fu.hydrate_hits(hits, out.chunks, out.documents, out.resources)
    return full.select(
        "query_id",
        F.col("rank").cast("long"),
        "evidence.document_id",
        "evidence.resource_id",
        "evidence.canonical_uri",
        "collection_id",
        "preview",
    )


@query(
    "authorized_collections",
    "E9",
    """WITH policies AS (
      SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN 'n' || (p_size % 5) ELSE '' END AS tenant,
        CASE WHEN p_partkey % 3 = 0 THEN ['s' || (p_partkey % 10), 's' || (p_partkey % 50)] ELSE [] END AS allowed FROM part),
    keys AS (
      SELECT 's' || s_suppkey AS c, 'n' || (s_nationkey % 5) AS tenant, s_suppkey % 7 <> 0 AS live, s_suppkey % 11 <> 5 AS fresh
      FROM supplier UNION ALL SELECT 's' || s_suppkey, 'n0', true, true FROM supplier WHERE s_suppkey % 10 = 0),
    tenants AS (SELECT c, min(tenant) AS own, count(DISTINCT tenant) > 1 AS ambiguous FROM keys WHERE live AND fresh GROUP BY c),
    requests AS (SELECT DISTINCT 's' || l_suppkey AS c, l_partkey FROM lineitem),
    decided AS (
      SELECT r.c AS consumer_id, CASE WHEN tenant <> '' AND coalesce(ambiguous, false) THEN 'ambiguous'
        WHEN (tenant <> '' AND coalesce(own, '') <> tenant) OR (len(allowed) > 0 AND NOT list_contains(allowed, r.c))
          THEN 'denied' ELSE 'allowed' END AS decision
      FROM requests r JOIN policies ON p_partkey = l_partkey LEFT JOIN tenants t ON t.c = r.c)
    SELECT consumer_id, decision, count(*) AS requests FROM decided GROUP BY ALL""",
)
def authorized_collections(spark, d):
    t = Tables(spark, d)
    policies = t.part.select(
        F.col("p_partkey").alias("collection_id"),
        F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit("n"), F.col("p_size") % 5)).otherwise("").alias("tenant_id"),
        F.when(
            F.col("p_partkey") % 3 == 0,
            F.array(F.concat(F.lit("s"), F.col("p_partkey") % 10), F.concat(F.lit("s"), F.col("p_partkey") % 50)),
        )
        .otherwise(F.array().cast("array<string>"))
        .alias("allowed_consumers"),
    )
    consumer = F.concat(F.lit("s"), "s_suppkey").alias("consumer_id")
    own = t.supplier.select(
        consumer,
        F.concat(F.lit("n"), F.col("s_nationkey") % 5).alias("tenant_id"),
        F.when(F.col("s_suppkey") % 7 != 0, "active").otherwise("revoked").alias("status"),
        F.when(F.col("s_suppkey") % 11 == 5, F.lit(100)).alias("expires_at"),
    )
    second = t.supplier.where("s_suppkey % 10 = 0").select(
        consumer, F.lit("n0").alias("tenant_id"), F.lit("active").alias("status"), F.lit(None).cast("int").alias("expires_at")
    )
    requests = t.lineitem.select(
        F.concat(F.lit("s"), "l_suppkey").alias("consumer_id"), F.col("l_partkey").alias("collection_id")
    ).distinct()
    decided = ev.authorize(requests, policies, own.unionByName(second), F.lit(200))
    return decided.groupBy("consumer_id", "decision").agg(F.count("*").alias("requests"))


def _feedback(t: Tables):
    """labels as relevance feedback on documents; some rows point at the wrong parent."""
    n = F.col("doc_id")
    tag = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    return t.labels.join(t.documents.select("doc_id", "source"), "doc_id").select(
        n.alias("feedback_id"),
        tag("c", n).alias("chunk_id"),
        tag("d", F.when(n % 13 == 0, n + 1).otherwise(n)).alias("document_id"),
        tag("r", F.when((n % 13 == 0) | (n % 17 == 0), n + 1).otherwise(n)).alias("resource_id"),
        F.when(n % 19 == 0, "elsewhere").otherwise(F.col("source")).alias("collection_id"),
        F.concat(F.lit(" query "), "quality", F.lit(" ")).alias("query"),
        F.when(n % 23 == 0, "good")
        .when(F.col("toxic") == 1, "not_relevant")
        .when(F.col("quality") == 1, "relevant")
        .otherwise("partially_relevant")
        .alias("label"),
    )


FEEDBACK_SQL = """
    feedback AS (SELECT l.doc_id AS n, source, quality,
      CASE WHEN l.doc_id % 23 = 0 THEN 'good' WHEN toxic = 1 THEN 'not_relevant' WHEN quality = 1 THEN 'relevant'
        ELSE 'partially_relevant' END AS label,
      CASE WHEN l.doc_id % 19 = 0 THEN 'elsewhere' ELSE source END AS collection_id
      FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""


@query(
    "validate_feedback",
    "E10",
    f"""WITH {FEEDBACK_SQL}, top AS (SELECT max(doc_id) AS m FROM documents)
    SELECT n AS feedback_id, sha256('query ' || quality) AS query_hash,
      CASE WHEN label = 'good' THEN 'invalid_label'
        WHEN (n % 13 = 0 OR n % 17 = 0) AND n = m THEN 'missing_target'
        WHEN n % 13 = 0 THEN 'chunk_document_mismatch' WHEN n % 17 = 0 THEN 'document_resource_mismatch'
        WHEN n % 19 = 0 THEN 'outside_collection' ELSE 'ok' END AS code FROM feedback, top""",
)
def validate_feedback(spark, d):
    t = Tables(spark, d)
    n = F.col("doc_id").cast("string")
    docs = t.documents
    out = ev.validate_feedback(
        _feedback(t),
        docs.select(F.concat(F.lit("c"), n).alias("chunk_id"), F.concat(F.lit("d"), n).alias("document_id")),
        docs.select(F.concat(F.lit("d"), n).alias("document_id"), F.concat(F.lit("r"), n).alias("resource_id")),
        docs.select(F.concat(F.lit("r"), n).alias("resource_id"), F.col("source").alias("collection_id")),
    )
    return out.select("feedback_id", "query_hash", "code")


@query(
    "feedback_summary",
    "E11",
    f"""WITH {FEEDBACK_SQL} SELECT collection_id, count_if(label <> 'good') AS total,
      count_if(label = 'relevant') AS relevant, count_if(label = 'partially_relevant') AS partially_relevant,
      count_if(label = 'not_relevant') AS not_relevant FROM feedback GROUP BY collection_id""",
)
def feedback_summary(spark, d):
    return ev.feedback_summary(_feedback(Tables(spark, d)))


@query(
    "feedback_latest",
    "E12",
    """SELECT conv_id * 1000 + turn AS feedback_id, turn AS created_at FROM conversations WHERE role = 'user'
    ORDER BY created_at DESC, feedback_id DESC LIMIT 100""",
)
def feedback_latest(spark, d):
    rows = Tables(spark, d).conversations.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("feedback_id"),
        F.col("turn").alias("created_at"),
        F.col("role").alias("collection_id"),
    )
    return ev.feedback_latest(rows, "user", 100).select("feedback_id", "created_at")


@query(
    "validate_claims",
    "E13",
    """WITH claims AS (
      SELECT conv_id, turn, CASE WHEN conv_id % 11 = 0 THEN [] WHEN conv_id % 5 = 0 THEN [turn, turn - 1, turn + 50]
        ELSE [turn, turn - 1] END AS ids FROM conversations WHERE role = 'assistant'),
    per AS (SELECT conv_id, count(*) AS claims, count_if(len(ids) = 0) AS uncited FROM claims GROUP BY conv_id),
    cited AS (SELECT DISTINCT conv_id, turn AS claim, unnest(ids) AS id FROM claims),
    outs AS (SELECT conv_id, count(*) AS outside FROM cited WHERE (conv_id, id) NOT IN
      (SELECT (conv_id, turn) FROM conversations) GROUP BY conv_id)
    SELECT c.conv_id AS answer_id, coalesce(claims, 0) AS claims, coalesce(uncited, 0) AS uncited,
      coalesce(outside, 0) AS outside,
      CASE WHEN uncited > 0 THEN 'uncited_claim' WHEN outside > 0 THEN 'outside_evidence'
        WHEN claims IS NULL AND c.conv_id % 2 = 0 THEN 'no_claims' ELSE 'ok' END AS code
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN per ON per.conv_id = c.conv_id
    LEFT JOIN outs ON outs.conv_id = c.conv_id""",
)
def validate_claims(spark, d):
    turns = Tables(spark, d).conversations
    n, turn = F.col("conv_id"), F.col("turn")
    answers = turns.groupBy("conv_id").agg(F.max("turn")).select(
        n.alias("answer_id"), F.lit("yes").alias("answer"), (n % 2 == 1).alias("abstained")
    )
    ids = (
        F.when(n % 11 == 0, F.array().cast("array<bigint>"))
        .when(n % 5 == 0, F.array(turn, turn - 1, turn + 50, turn))
        .otherwise(F.array(turn, turn - 1))
    )
    claims = turns.where("role = 'assistant'").select(n.alias("answer_id"), turn.alias("claim_no"), ids.alias("chunk_ids"))
    evidence = turns.select(n.alias("answer_id"), turn.alias("chunk_id"))
    return ev.validate_claims(answers, claims, evidence)


RESEARCH_SQL = """
    found AS (SELECT regexp_extract(url, '([a-z]+)(/|$)', 1) AS run_id, page_id AS rank,
        CASE WHEN page_id % 8 = 0 THEN ' ' ELSE regexp_replace(url, '[0-9]+.*$', '') END AS uri FROM pages),
    log AS (SELECT regexp_replace(url, '[0-9]+.*$', '') AS uri, min(page_id) AS page_id FROM pages GROUP BY 1),
    sources AS (SELECT run_id, f.uri, min(rank) AS rank, any_value(l.page_id) AS pid FROM found f
      LEFT JOIN log l ON l.uri = f.uri WHERE f.uri <> ' ' GROUP BY ALL)"""


def _research(t: Tables):
    short = F.regexp_replace("url", "[0-9]+.*$", "")
    found = t.pages.select(
        F.regexp_extract("url", "([a-z]+)(/|$)", 1).alias("run_id"),
        F.col("page_id").alias("rank"),
        F.when(F.col("page_id") % 8 == 0, " ").otherwise(short).alias("uri"),
        F.concat(F.lit("page "), "page_id").alias("title"),
    )
    log = t.pages.groupBy(short.alias("uri")).agg(F.min("page_id").alias("page_id"))
    return ev.research_sources(
        found, log.select("uri", F.when(F.col("page_id") % 4 == 1, "TimeoutError").alias("error"))
    )


@query(
    "research_sources",
    "E14",
    f"""WITH {RESEARCH_SQL} SELECT run_id, uri, rank, 'page ' || rank AS title, pid % 4 <> 1 AS ingested,
      CASE WHEN pid % 4 = 1 THEN 'TimeoutError' END AS error FROM sources""",
)
def research_sources(spark, d):
    return _research(Tables(spark, d))


@query(
    "research_summary",
    "E14",
    f"""WITH {RESEARCH_SQL} SELECT run_id, count(*) AS attempted, count_if(pid % 4 <> 1) AS ingested,
      count_if(pid % 4 = 1) AS failed, CASE WHEN count_if(pid % 4 = 1) > 0 THEN 'partial' ELSE 'executed' END AS status
    FROM sources GROUP BY run_id""",
)
def research_summary(spark, d):
    return ev.research_summary(_research(Tables(spark, d)))
