"""Lexical search queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.operators import lexical as lx
from dossier.operators.word_index import build_word_index, count_search_batch, count_search_indexed
from dossier.plans import sqltext as q
from dossier.plans.registry import Tables, query

PHRASE = "the inin of thtion"
WEB_QUERY = '"of the" -des or "la des" queque or -the'
RANK_QUERY = "of the in"


def count_sql(hay: str, words: list[str], phrase: str) -> str:
    parts = [f"CASE WHEN contains({hay}, '{phrase}') THEN 5.0::DOUBLE ELSE 0 END"]
    for word in words:
        n = f"((length({hay}) - length(replace({hay}, '{word}', ''))) // {len(word)})"
        parts.append(f"CASE WHEN {n} > 0 THEN 1 + least({n}, 8) * 0.25::DOUBLE ELSE 0 END")
    return " + ".join(parts)


@query(
    "lexical_count_search",
    "D1",
    f"""WITH h AS (SELECT doc_id AS chunk_id, {q.fold("source || ' ' || text")} AS hay FROM documents),
    s AS (SELECT chunk_id, {count_sql("hay", PHRASE.split(), PHRASE)} AS score FROM h)
    SELECT * FROM s WHERE score > 0 ORDER BY score DESC, chunk_id LIMIT 25""",
)
def lexical_count_search(spark, d):
    docs = Tables(spark, d).texts.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("title"), "text")
    return lx.count_search(docs, PHRASE, 25).select("chunk_id", "score")


# Scores of every (benchmark passage, document) pair, for the twins of batch searches.
COUNT_PAIRS_SQL = f"""
    passages AS (SELECT item_id, {q.fold("text")} AS query,
      list_transform({q.tokens("text")}, lambda x: replace(x, 'ß', 'ss')) AS toks FROM benchmark),
    hays AS (SELECT doc_id, ' ' || {q.fold("text")} AS hay FROM documents),
    count_pairs AS (
      SELECT item_id AS query_id, doc_id AS chunk_id,
        (CASE WHEN contains(hay, query) THEN 5.0::DOUBLE ELSE 0 END) + list_sum(list_transform(toks,
          lambda x: CASE WHEN contains(hay, x) THEN 1.0::DOUBLE + least((length(hay) - length(replace(hay, x, '')))
            // length(x), 8) * 0.25::DOUBLE ELSE 0 END)) AS score
      FROM passages, hays)"""


def benchmark_queries(t: Tables):
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def untitled_documents(t: Tables):
    return t.documents.select(F.col("doc_id").alias("chunk_id"), F.lit("").alias("title"), "text")


COUNT_BATCH_SQL = f"""WITH {COUNT_PAIRS_SQL}
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
    FROM count_pairs WHERE score > 0 QUALIFY rank <= 10"""


@query("lexical_count_batch", "D1", COUNT_BATCH_SQL)
def lexical_count_batch(spark, d):
    t = Tables(spark, d)
    return count_search_batch(benchmark_queries(t), untitled_documents(t), 10).withColumn(
        "rank", F.col("rank").cast("long")
    )


@query("lexical_count_indexed", "D1", COUNT_BATCH_SQL)
def lexical_count_indexed(spark, d):
    t = Tables(spark, d)
    hits = count_search_indexed(benchmark_queries(t), build_word_index(untitled_documents(t)), 10)
    return hits.withColumn("rank", F.col("rank").cast("long"))


TERMS_SQL = f"""
    toks AS (SELECT doc_id AS chunk_id, {q.tokens("text")} AS l, lang, source FROM documents),
    terms AS (SELECT chunk_id, lang, source, unnest(l) AS term, generate_subscripts(l, 1) AS pos FROM toks)"""


def document_chunks(t: Tables):
    return t.texts.select(F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("collection_id"), "lang")


@query(
    "build_postings",
    "D2",
    f"""WITH {TERMS_SQL}
    SELECT term, chunk_id, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos,
      CAST(sum(pos) AS BIGINT) AS pos_sum FROM terms GROUP BY ALL""",
)
def build_postings(spark, d):
    p = lx.build_postings(document_chunks(Tables(spark, d)))
    return p.select(
        "term",
        "chunk_id",
        F.size("positions").cast("long").alias("n"),
        F.col("positions")[0].cast("long").alias("first_pos"),
        F.array_max("positions").cast("long").alias("last_pos"),
        F.aggregate("positions", F.lit(0).cast("long"), lambda s, x: s + x).alias("pos_sum"),
    )


@query(
    "websearch_match",
    "D3",
    f"""WITH {TERMS_SQL},
    pairs AS (SELECT chunk_id, term, lead(term) OVER (PARTITION BY chunk_id ORDER BY pos) AS nxt FROM terms)
    SELECT doc_id AS chunk_id FROM documents LEFT JOIN (
      SELECT chunk_id, bool_or(term = 'of' AND coalesce(nxt, '') = 'the') AS of_the, bool_or(term = 'des') AS des,
        bool_or(term = 'la' AND coalesce(nxt, '') = 'des') AS la_des, bool_or(term = 'queque') AS queque,
        bool_or(term = 'the') AS the FROM pairs GROUP BY chunk_id) f ON f.chunk_id = doc_id
    WHERE (coalesce(of_the, false) AND NOT coalesce(des, false))
       OR (coalesce(la_des, false) AND coalesce(queque, false)) OR NOT coalesce(the, false)""",
)
def websearch_match(spark, d):
    chunks = document_chunks(Tables(spark, d))
    return lx.websearch_match(lx.build_postings(chunks), chunks, WEB_QUERY)


@query(
    "websearch_match_positive",
    "D3",
    f"""WITH {TERMS_SQL}, pairs AS (
      SELECT chunk_id, term, lead(term) OVER (PARTITION BY chunk_id ORDER BY pos) AS nxt FROM terms)
    SELECT chunk_id FROM pairs GROUP BY chunk_id
    HAVING (bool_or(term = 'of' AND coalesce(nxt, '') = 'the') AND NOT bool_or(term = 'in'))
        OR (bool_or(term = 'der') AND bool_or(term = 'und'))""",
)
def websearch_match_positive(spark, d):
    chunks = document_chunks(Tables(spark, d))
    return lx.websearch_match(lx.build_postings(chunks), chunks, '"of the" -in OR der und')


def density_ctes(words: list[str]) -> str:
    last = ", ".join(
        f"max(CASE WHEN term = '{w}' THEN pos END) OVER (PARTITION BY chunk_id ORDER BY pos) AS l{i}"
        for i, w in enumerate(words)
    )
    seen = " AND ".join(f"l{i} IS NOT NULL" for i in range(len(words)))
    least = ", ".join(f"l{i}" for i in range(len(words)))
    listed = ", ".join(f"'{w}'" for w in words)
    return f"""
    occ AS (SELECT chunk_id, pos, row_number() OVER (PARTITION BY chunk_id ORDER BY pos) AS nth, {last}
      FROM terms WHERE term IN ({listed})),
    starts AS (SELECT chunk_id, pos, nth, CASE WHEN {seen} THEN least({least}) END AS start FROM occ),
    moved AS (SELECT *, lag(start) OVER (PARTITION BY chunk_id ORDER BY pos) AS before FROM starts),
    covers AS (SELECT * FROM moved WHERE start IS NOT NULL AND (before IS NULL OR before < start)),
    density AS (
      SELECT c.chunk_id, sum(0.1::DOUBLE / (1 + (c.pos - c.start) - (c.nth - f.nth))) AS density
      FROM covers c JOIN starts f ON f.chunk_id = c.chunk_id AND f.pos = c.start GROUP BY c.chunk_id)"""


@query(
    "lexical_rank_search",
    "D4",
    f"""WITH {TERMS_SQL}, {density_ctes(RANK_QUERY.split())},
    s AS (SELECT chunk_id, density + CASE WHEN contains(lower(text), '{RANK_QUERY}') THEN 0.25 ELSE 0 END AS score
      FROM density JOIN documents ON doc_id = chunk_id WHERE source = 'src1')
    SELECT chunk_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, chunk_id LIMIT 30""",
)
def lexical_rank_search(spark, d):
    chunks = document_chunks(Tables(spark, d))
    hits = lx.rank_search(lx.build_postings(chunks), chunks, RANK_QUERY, 30, ["src1"])
    return hits.select("chunk_id", F.round("score", 6).alias("score"))


@query(
    "lexical_rank_all",
    "D4",
    f"""WITH {TERMS_SQL}, {density_ctes(["the", "la"])}
    SELECT chunk_id, round(density, 6) AS density FROM density""",
)
def lexical_rank_all(spark, d):
    density = lx.cover_density(lx.build_postings(document_chunks(Tables(spark, d))), ["the", "la"])
    return density.select("chunk_id", F.round("density", 6).alias("density"))


@query(
    "lexical_rank_languages",
    "D5",
    f"""WITH {TERMS_SQL}, {density_ctes(["the", "in"])},
    s AS (SELECT chunk_id, source AS collection_id, CASE lang WHEN 'en' THEN 'english' ELSE 'simple' END AS config,
        density + CASE WHEN contains(lower(text), 'the in') THEN 0.25 ELSE 0 END AS score
      FROM density JOIN documents ON doc_id = chunk_id WHERE source IN ('src1', 'src2', 'src3', 'src4', 'src5'))
    SELECT chunk_id, collection_id, config, round(score, 6) AS score FROM s ORDER BY s.score DESC, chunk_id LIMIT 40""",
)
def lexical_rank_languages(spark, d):
    chunks = document_chunks(Tables(spark, d)).withColumn("config", lx.language_config(F.col("lang")))
    hits = lx.rank_search_languages(
        lx.build_postings(chunks, ["config"]), chunks, "the in", 40, ["src1", "src2", "src3", "src4", "src5"]
    )
    return hits.select("chunk_id", "collection_id", "config", F.round("score", 6).alias("score"))


@query(
    "search_filters",
    "D6",
    """SELECT doc_id FROM documents WHERE source IN ('src3', 'src7') AND 'doc://' || doc_id NOT IN ('doc://-1')
      AND CASE WHEN lang = 'en' THEN 'text/html' ELSE 'text/plain' END IN ('text/plain')""",
)
def search_filters(spark, d):
    docs = Tables(spark, d).documents.select(
        "doc_id",
        F.col("source").alias("source_type"),
        F.when(F.col("lang") == "en", "text/html").otherwise("text/plain").alias("media_type"),
        F.concat(F.lit("doc://"), "doc_id").alias("canonical_uri"),
    )
    wanted = {"source_type": ["src3", "src7", ""], "media_type": ["text/plain"], "canonical_uri": []}
    return lx.search_filters(docs, wanted).select("doc_id")
