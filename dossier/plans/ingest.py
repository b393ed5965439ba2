"""Sources, ingestion, chunking and audits over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.functions import ids
from dossier.functions.text import collapse_space, html_to_text, normalize_text, token_estimate
from dossier.operators import audits, chunking, page_text, stores
from dossier.operators import ingest as ing
from dossier.operators.passages import passage_matches
from dossier.operators.word_index import count_search_batch
from dossier.plans import sqltext as q
from dossier.plans.registry import Tables, query
from dossier.sources.export import export_collection
from dossier.sources.files import extract_contents, extraction_statuses
from dossier.sources.tables import SCHEMAS, load_tables


def doc_uri():
    return F.concat(F.lit("doc://"), F.col("doc_id"))


def ingested_documents(t: Tables, **options) -> ing.Ingested:
    """documents -> stored tables; collection = source, URI = doc://id."""
    return ing.ingest_texts(t.texts, F.col("source"), doc_uri(), F.col("text"), "file", **options)


DOC_IDS_SQL = f"""
ids AS (
  SELECT doc_id, source, lang, text, 'doc://' || doc_id AS uri, sha256(text) AS hash,
         {q.sid("'resource'", "source", "'file'", "'doc://' || doc_id")} AS resource_id
  FROM documents
), docs AS (
  SELECT *, {q.sid("'document'", "resource_id", "hash")} AS document_id FROM ids
)"""


@query(
    "load_tables",
    "A1",
    " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in SCHEMAS),
)
def load_tables_query(spark, d):
    counts = [
        df.agg(F.lit(name).alias("table_name"), F.count("*").alias("row_count"))
        for name, df in load_tables(spark, d).items()
    ]
    out = counts[0]
    for one in counts[1:]:
        out = out.unionByName(one)
    return out


@query(
    "ingest_documents",
    "A2",
    f"""WITH {DOC_IDS_SQL}
    SELECT resource_id, document_id, source AS collection_id, uri AS canonical_uri, hash AS content_hash,
           CASE WHEN {q.strip("text")} = '' THEN 'empty' ELSE 'extracted' END AS extraction_status
    FROM docs""",
)
def ingest_documents(spark, d):
    out = ingested_documents(Tables(spark, d))
    return out.resources.select("resource_id", "collection_id", "canonical_uri").join(
        out.documents.select("resource_id", "document_id", "content_hash", "extraction_status"), "resource_id"
    )


@query(
    "ingest_chunks",
    "A2",
    f"""WITH RECURSIVE {DOC_IDS_SQL}, {q.chunk_ctes("docs", "document_id", "text")}
    SELECT {q.sid("'chunk'", "document_id", "content_hash", "CAST(ordinal AS VARCHAR)")} AS chunk_id,
           document_id, ordinal, content_hash, char_start, char_end FROM chunks""",
)
def ingest_chunks(spark, d):
    return ingested_documents(Tables(spark, d)).chunks.select(
        "chunk_id", "document_id", "ordinal", "content_hash", "char_start", "char_end"
    )


@query(
    "ingest_provenance",
    "A2",
    f"""WITH RECURSIVE {DOC_IDS_SQL}, {q.chunk_ctes("docs", "document_id", "text")}
    SELECT resource_id, document_id,
           {q.sid("'chunk'", "document_id", "content_hash", "CAST(ordinal AS VARCHAR)")} AS chunk_id,
           uri AS source_ref, hash AS content_hash
    FROM (SELECT document_id, ordinal, content_hash FROM chunks) JOIN
         (SELECT document_id, resource_id, uri, hash FROM docs) USING (document_id)""",
)
def ingest_provenance(spark, d):
    return ingested_documents(Tables(spark, d)).provenance


@query(
    "ingest_pages",
    "A2",
    f"""WITH ids AS (
      SELECT page_id, url, sha256(html) AS content_hash, {q.html_text("html")} AS text,
             {q.sid("'resource'", "'web'", "'url'", "url")} AS resource_id FROM pages)
    SELECT resource_id, {q.sid("'document'", "resource_id", "content_hash")} AS document_id, url AS canonical_uri,
           content_hash, CASE WHEN text = '' THEN 'empty' ELSE 'extracted' END AS extraction_status,
           sha256(text) AS text_hash FROM ids""",
)
def ingest_pages(spark, d):
    out = ing.ingest_pages(Tables(spark, d).pages, F.lit("web"), F.col("url"), F.col("html"))
    return out.documents.select(
        "resource_id",
        "document_id",
        F.col("title").alias("canonical_uri"),
        "content_hash",
        "extraction_status",
        F.sha2("text", 256).alias("text_hash"),
    )


@query(
    "html_to_text",
    "A4",
    f"""SELECT page_id, sha256({q.html_text("html")}) AS text_hash, length({q.html_text("html")}) AS n_chars
    FROM pages""",
)
def html_to_text_query(spark, d):
    text = html_to_text(F.col("html"))
    return Tables(spark, d).markup.select(
        "page_id", F.sha2(text, 256).alias("text_hash"), F.char_length(text).cast("long").alias("n_chars")
    )


# Page tables made from the documents: one page per line; OCR output for two pages of
# three with a confidence from the line number, vision output for every second page.
def _page_tables(t: Tables):
    lines = t.texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select(
        "doc_id", (F.col("pos") + 1).alias("page"), "line"
    )
    native = lines.select("doc_id", "page", F.col("line").alias("text"))
    ocr = lines.where("(doc_id + page) % 3 <> 0").select(
        "doc_id",
        "page",
        F.concat(F.lit("scan "), "line").alias("text"),
        ((F.col("page") * 7) % 100).cast("double").alias("confidence"),
    )
    vision = lines.where("page % 2 = 0").select("doc_id", "page", F.concat(F.lit("seen "), "line").alias("text"))
    return native, ocr, vision


@query(
    "page_cascade",
    "A5",
    f"""WITH lines AS (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
             generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents),
    native AS (SELECT doc_id, page, {q.strip("line")} AS native_text,
               {q.visible("line")} < 32 AS needs_ocr, line FROM lines),
    joined AS (
      SELECT *, needs_ocr AS requested,
        CASE WHEN (doc_id + page) % 3 <> 0 THEN 'scan ' || line END AS ocr_text,
        CAST((page * 7) % 100 AS DOUBLE) AS confidence,
        CASE WHEN page % 2 = 0 THEN 'seen ' || line END AS vision_text FROM native),
    flagged AS (
      SELECT *, requested AND ocr_text IS NOT NULL
           AND ({q.visible("coalesce(ocr_text, '')")} < 24 OR confidence < 90)
           AND {q.strip("coalesce(vision_text, '')")} <> '' AS use_vision,
        requested AND ocr_text IS NOT NULL AND {q.strip("coalesce(ocr_text, '')")} <> '' AS use_ocr FROM joined),
    chosen AS (
      SELECT *, {q.strip("CASE WHEN use_vision THEN vision_text WHEN use_ocr THEN ocr_text ELSE native_text END")}
        AS selected FROM flagged)
    SELECT doc_id,
      sha256(coalesce(string_agg('[Page ' || page || ']' || chr(10) || selected, chr(10) || chr(10) ORDER BY page)
        FILTER (selected <> ''), '')) AS text_hash,
      count(*) AS pages,
      coalesce(string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) FILTER (needs_ocr AND NOT requested), '')
        AS skipped_pages,
      coalesce(string_agg(CAST(page AS VARCHAR), ',' ORDER BY page)
        FILTER (needs_ocr AND NOT use_vision AND NOT use_ocr), '') AS unresolved_pages
    FROM chosen GROUP BY doc_id""",
)
def page_cascade_query(spark, d):
    out = page_text.page_cascade(*_page_tables(Tables(spark, d)))
    return out.select(
        "doc_id",
        F.sha2("text", 256).alias("text_hash"),
        "pages",
        F.array_join("skipped_pages", ",").alias("skipped_pages"),
        F.array_join("unresolved_pages", ",").alias("unresolved_pages"),
    )


def _ocr_words(t: Tables):
    lines = t.texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    words = lines.select("doc_id", (F.col("pos") + 1).alias("page"), F.posexplode(F.split("line", " ")).alias("w", "word"))
    return words.select(
        "doc_id",
        "page",
        (F.col("w") + 1).alias("word_no"),
        "word",
        (((F.col("doc_id") * 31 + F.col("page") * 7 + (F.col("w") + 1) * 17) % 110) - 10).alias("conf"),
    )


OCR_WORDS_SQL = f"""
    lines AS (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
             generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents),
    raw_words AS (
      SELECT doc_id, page, unnest(string_split(line, ' ')) AS word,
             generate_subscripts(string_split(line, ' '), 1) AS word_no FROM lines),
    words AS (
      SELECT doc_id, page, word_no, {q.strip("word")} AS word,
             ((doc_id * 31 + page * 7 + word_no * 17) % 110) - 10 AS conf FROM raw_words),
    rolled AS (
      SELECT doc_id, page, string_agg(word, ' ' ORDER BY word_no) AS text,
             round_even(avg(CAST(conf AS DOUBLE)), 2) AS confidence, count(*) AS words
      FROM words WHERE word <> '' AND conf >= 0 GROUP BY ALL)"""


@query(
    "ocr_page_rollup",
    "A6",
    f"WITH {OCR_WORDS_SQL} SELECT doc_id, page, sha256(text) AS text_hash, confidence, words FROM rolled",
)
def ocr_page_rollup(spark, d):
    return page_text.ocr_page_rollup(_ocr_words(Tables(spark, d))).select(
        "doc_id", F.col("page").cast("long"), F.sha2("text", 256).alias("text_hash"), "confidence", "words"
    )


@query(
    "ocr_document_confidence",
    "A6",
    f"""WITH {OCR_WORDS_SQL} SELECT doc_id,
      (cents // pages + CASE WHEN (cents % pages) * 2 > pages OR ((cents % pages) * 2 = pages AND (cents // pages) % 2 = 1)
        THEN 1 ELSE 0 END) / 100 AS mean_confidence, pages
    FROM (SELECT doc_id, sum(CAST(round(confidence * 100) AS BIGINT)) AS cents, count(*) AS pages
          FROM rolled GROUP BY doc_id)""",
)
def ocr_document_confidence(spark, d):
    return page_text.ocr_document_confidence(page_text.ocr_page_rollup(_ocr_words(Tables(spark, d))))


@query(
    "append_new_documents",
    "A7",
    """WITH stored AS (SELECT DISTINCT sha256(text) AS content_hash FROM documents WHERE lang = 'en'),
    incoming AS (SELECT DISTINCT sha256(text) AS content_hash FROM documents)
    SELECT content_hash FROM incoming WHERE content_hash NOT IN (SELECT content_hash FROM stored)""",
)
def append_new_documents(spark, d):
    hashed = Tables(spark, d).documents.select("lang", F.sha2("text", 256).alias("content_hash"))
    return stores.append_new(hashed.where("lang = 'en'"), hashed.select("content_hash"), "content_hash")


@query(
    "refresh_resources",
    "A7",
    """SELECT 'doc://' || doc_id AS resource_id,
      CASE WHEN lang <> 'en' THEN sha256(text || '!') ELSE sha256(text) END AS content_hash,
      CASE WHEN lang <> 'en' THEN 'ready' ELSE 'stale' END AS status,
      CASE WHEN lang = 'fr' THEN 200 ELSE 100 END AS first_seen,
      CASE WHEN lang <> 'en' THEN 200 ELSE 100 END AS last_seen
    FROM documents""",
)
def refresh_resources(spark, d):
    docs = Tables(spark, d).documents
    stored = docs.where("lang <> 'fr'").select(
        doc_uri().alias("resource_id"),
        F.sha2("text", 256).alias("content_hash"),
        F.lit("stale").alias("status"),
        F.lit(100).alias("first_seen"),
        F.lit(100).alias("last_seen"),
    )
    incoming = docs.where("lang <> 'en'").select(
        doc_uri().alias("resource_id"), F.sha2(F.concat("text", F.lit("!")), 256).alias("content_hash")
    )
    return stores.refresh_resources(stored, incoming, F.lit(200))


@query(
    "upsert_embeddings",
    "A8",
    """SELECT vec_id AS chunk_id, 'hash' AS provider, CASE WHEN label % 2 = 0 THEN 'm1' ELSE 'm2' END AS model,
      len(embedding) AS dimension,
      round(CASE WHEN label >= 2 THEN -1 ELSE 1 END * CAST(embedding[1] AS DOUBLE), 6) AS first_value,
      CASE WHEN label = 5 THEN NULL ELSE 'e' || vec_id END AS embedding_id
    FROM embeddings""",
)
def upsert_embeddings(spark, d):
    base = Tables(spark, d).embeddings.select(
        F.col("vec_id").alias("chunk_id"),
        F.lit("hash").alias("provider"),
        F.when(F.col("label") % 2 == 0, "m1").otherwise("m2").alias("model"),
        F.col("embedding").alias("vector"),
        F.concat(F.lit("e"), "vec_id").alias("embedding_id"),
        "label",
    )
    stored = base.where("label <> 5").drop("label").withColumn("dimension", F.size("vector"))
    incoming = base.where("label >= 2").withColumn("vector", F.transform("vector", lambda x: -x))
    return stores.upsert_embeddings(stored, incoming).select(
        "chunk_id",
        "provider",
        "model",
        "dimension",
        F.round(F.col("vector")[0].cast("double"), 6).alias("first_value"),
        "embedding_id",
    )


@query(
    "invalid_embeddings",
    "A8",
    """SELECT doc_id AS chunk_id, 'empty' AS reason FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)
      AND lang = 'de'
    UNION ALL
    SELECT doc_id, 'repeated' FROM documents JOIN embeddings ON vec_id = doc_id WHERE lang = 'fr'""",
)
def invalid_embeddings(spark, d):
    t = Tables(spark, d)
    joined = t.embeddings.join(t.documents.select(F.col("doc_id").alias("vec_id"), "lang"), "vec_id").select(
        F.col("vec_id").alias("chunk_id"),
        F.lit("hash").alias("provider"),
        F.lit("m").alias("model"),
        F.when(F.col("lang") == "de", F.array().cast("array<float>")).otherwise(F.col("embedding")).alias("vector"),
        "lang",
    )
    batch = joined.unionByName(joined.where("lang = 'fr'")).drop("lang")
    return stores.invalid_embeddings(batch)


@query(
    "export_collection",
    "A9",
    f"""WITH {DOC_IDS_SQL}, page AS (
      SELECT * FROM docs WHERE source = 'src1' ORDER BY resource_id LIMIT 50 OFFSET 10)
    SELECT resource_id, document_id, uri AS canonical_uri, sha256({q.norm("text")}) AS chunk_hash,
      length({q.norm("text")}) AS char_end,
      (SELECT count(*) FROM docs WHERE source = 'src1') AS total_resources,
      60 < (SELECT count(*) FROM docs WHERE source = 'src1') AS has_more
    FROM page WHERE {q.norm("text")} <> ''""",
)
def export_collection_query(spark, d):
    t = Tables(spark, d)
    out = ingested_documents(t, pre_chunked=True)
    records = out.documents.select(
        "resource_id",
        F.concat(F.lit("rec_"), F.substring("document_id", 1, 24)).alias("record_id"),
        F.lit("text").alias("record_type"),
        F.col("title").alias("data"),
        F.lit(1).alias("revision"),
        F.lit("ready").alias("review_status"),
    )
    nested = export_collection(
        out.resources, out.documents, out.chunks, records, out.provenance, "src1", offset=10, limit=50
    )
    docs = nested.select(
        "resource_id", "canonical_uri", "total_resources", "has_more", F.inline("documents")
    )
    return docs.select(
        "resource_id", "document_id", "canonical_uri", "total_resources", "has_more", F.explode("chunks").alias("c")
    ).select(
        "resource_id",
        "document_id",
        "canonical_uri",
        F.col("c.content_hash").alias("chunk_hash"),
        F.col("c.char_end").alias("char_end"),
        "total_resources",
        "has_more",
    )


@query(
    "normalize_text",
    "B1",
    f"""SELECT doc_id, sha256({q.norm("text")}) AS text_hash, length({q.norm("text")}) AS n_chars,
      CASE WHEN {q.norm("text")} = '' THEN 0 ELSE greatest(1, length({q.norm("text")}) // 4) END AS token_estimate
    FROM documents""",
)
def normalize_text_query(spark, d):
    norm = normalize_text(F.col("text"))
    return Tables(spark, d).texts.select(
        "doc_id",
        F.sha2(norm, 256).alias("text_hash"),
        F.char_length(norm).cast("long").alias("n_chars"),
        token_estimate(norm).cast("long").alias("token_estimate"),
    )


@query(
    "chunk_documents",
    "B2",
    f"""WITH RECURSIVE {q.chunk_ctes("documents", "doc_id", "text")}
    SELECT doc_id, ordinal, content_hash, char_start, char_end, greatest(1, length(chunk_text) // 4) AS token_estimate
    FROM chunks""",
)
def chunk_documents_query(spark, d):
    return chunking.chunk_documents(Tables(spark, d).documents, ["doc_id"]).drop("chunk_text")


@query(
    "chunk_pages_small_windows",
    "B2",
    f"""WITH RECURSIVE source AS (SELECT page_id, {q.html_text("html")} AS body FROM pages),
    {q.chunk_ctes("source", "page_id", "body", 400, 300, 60)}
    SELECT page_id, ordinal, content_hash, char_start, char_end FROM chunks""",
)
def chunk_pages_small_windows(spark, d):
    pages = Tables(spark, d).pages.select("page_id", html_to_text(F.col("html")).alias("text"))
    return chunking.chunk_documents(pages, ["page_id"], "text", 400, 300, 60).drop("chunk_text", "token_estimate")


@query(
    "dedupe_chunks",
    "B3",
    f"""WITH lines AS (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
             generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
    hashed AS (SELECT doc_id, pos, sha256(line) AS content_hash FROM lines WHERE {q.norm("line")} <> ''),
    firsts AS (SELECT doc_id, content_hash, min(pos) AS source_pos FROM hashed GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY source_pos) - 1 AS ordinal FROM firsts""",
)
def dedupe_chunks_query(spark, d):
    lines = (
        Tables(spark, d)
        .texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "line"))
        .where(collapse_space(F.col("line")) != "")
        .select("doc_id", "ordinal", F.sha2("line", 256).alias("content_hash"), F.col("ordinal").alias("source_pos"))
    )
    return chunking.dedupe_chunks(lines, "doc_id").select(
        "doc_id", "content_hash", F.col("source_pos").cast("long"), F.col("ordinal").cast("long")
    )


@query(
    "whole_text_chunks",
    "B4",
    f"""SELECT doc_id, 0 AS ordinal, sha256({q.norm("text")}) AS content_hash, length({q.norm("text")}) AS char_end
    FROM documents WHERE {q.norm("text")} <> ''""",
)
def whole_text_chunks_query(spark, d):
    return chunking.whole_text_chunks(Tables(spark, d).texts, ["doc_id"]).select(
        "doc_id", "ordinal", "content_hash", "char_end"
    )


@query(
    "audit_chunk_export",
    "B5",
    f"""WITH RECURSIVE {DOC_IDS_SQL}, {q.chunk_ctes("docs", "document_id", "text")},
    faulty AS (
      SELECT document_id, ordinal, chunk_text, char_start, char_end,
        CASE WHEN source IN ('src1', 'src2') AND ordinal = 1 THEN upper(content_hash)
             WHEN source = 'src3' AND ordinal = 0 THEN 'x' ELSE content_hash END AS content_hash,
        CASE WHEN source = 'src4' THEN char_end + 1 ELSE char_end END AS bad_end,
        CASE WHEN source = 'src5' AND ordinal = 2 THEN '' ELSE 'c' END AS chunk_id, source, n
      FROM chunks JOIN (SELECT document_id, source, length({q.norm("text")}) AS n FROM docs) USING (document_id)),
    checked AS (
      SELECT f.source, sha256(chunk_text) = lower(content_hash) AS hash_ok,
        char_start < bad_end AND bad_end <= n AND trim(substr({q.norm("text")}, char_start + 1, bad_end - char_start))
          = chunk_text AS offset_ok, chunk_id = '' AS no_id
      FROM faulty f JOIN docs USING (document_id)),
    per AS (SELECT source, count(*) AS chunks, count_if(hash_ok) AS matching_chunk_hashes,
        count_if(offset_ok) AS matching_normalized_offsets, bool_or(no_id) AS no_id FROM checked GROUP BY source),
    tot AS (SELECT source, count(*) AS documents FROM docs GROUP BY source)
    SELECT source, documents AS resources, documents, chunks, matching_chunk_hashes, matching_normalized_offsets,
      concat_ws(',', CASE WHEN matching_chunk_hashes < chunks THEN 'CHUNK_HASH_MISMATCH_OR_MISSING_TEXT' END,
        CASE WHEN no_id THEN 'MISSING_CHUNK_ID' END,
        CASE WHEN matching_normalized_offsets < chunks THEN 'NORMALIZED_OFFSET_MISMATCH' END) AS error_codes,
      matching_chunk_hashes = chunks AND NOT no_id AND matching_normalized_offsets = chunks AS verified
    FROM tot JOIN per USING (source)""",
)
def audit_chunk_export_query(spark, d):
    out = ingested_documents(Tables(spark, d))
    source = F.col("collection_id")
    chunks = out.chunks.select(
        "document_id",
        "chunk_text",
        "char_start",
        F.when(source == "src4", F.col("char_end") + 1).otherwise(F.col("char_end")).alias("char_end"),
        F.when(source.isin("src1", "src2") & (F.col("ordinal") == 1), F.upper("content_hash"))
        .when((source == "src3") & (F.col("ordinal") == 0), F.lit("x"))
        .otherwise(F.col("content_hash"))
        .alias("content_hash"),
        F.when((source == "src5") & (F.col("ordinal") == 2), F.lit("")).otherwise(F.col("chunk_id")).alias("chunk_id"),
    )
    docs = out.documents.join(out.resources.select("resource_id", F.col("collection_id").alias("source")), "resource_id")
    return audits.audit_chunk_export(docs, chunks, "source").withColumn(
        "error_codes", F.array_join("error_codes", ",")
    )


@query(
    "audit_binary_identity",
    "B6",
    f"""WITH base AS (
      SELECT page_id, url, html, sha256(html) AS digest, {q.sid("'resource'", "'web'", "'url'", "url")} AS rid FROM pages),
    ided AS (SELECT *, {q.sid("'document'", "rid", "digest")} AS did FROM base),
    flags AS (SELECT page_id, page_id % 5 = 0 AS bad_hash, page_id % 7 = 0 AS doubled, page_id % 11 = 0 AS bad_type,
      page_id % 3 <> 0 AS rev FROM ided)
    SELECT page_id AS file_key, NOT (bad_hash OR doubled OR bad_type) AS binary_matches_store,
      rev AS notice_revision_matches, CASE WHEN doubled THEN 2 ELSE 1 END AS checked_documents,
      concat_ws(',', CASE WHEN NOT rev THEN 'NOTICE_REVISION_NOT_INDEPENDENTLY_MATCHED' END,
        CASE WHEN doubled THEN 'ORIGINAL_DOCUMENT_HASH_OR_ID_MISMATCH' END,
        CASE WHEN bad_hash THEN 'RESOURCE_BINARY_HASH_MISMATCH' END,
        CASE WHEN bad_type THEN 'SOURCE_TYPE_MISMATCH' END) AS error_codes
    FROM flags""",
)
def audit_binary_identity_query(spark, d):
    pages = Tables(spark, d).pages
    key = F.col("page_id").alias("file_key")
    rid = ids.resource_id(F.lit("web"), F.lit("url"), F.col("url"))
    digest = F.sha2("html", 256)
    files = pages.select(
        key,
        F.col("html").cast("binary").alias("content"),
        F.lit("web").alias("expected_collection"),
        F.lit("url").alias("expected_source_type"),
        F.col("url").alias("expected_uri"),
        F.lit("r1").alias("expected_revision"),
    )
    exported = pages.select(
        key,
        rid.alias("resource_id"),
        F.when(F.col("page_id") % 11 == 0, "file").otherwise("url").alias("source_type"),
        F.col("url").alias("canonical_uri"),
        F.when(F.col("page_id") % 5 == 0, F.lit("00")).otherwise(digest).alias("content_hash"),
        F.when(F.col("page_id") % 3 == 0, F.lit("r0")).otherwise(F.lit("r1")).alias("notice_revision"),
    )
    docs = pages.select(key, ids.document_id(rid, digest).alias("document_id"), digest.alias("content_hash"))
    docs = docs.unionByName(docs.where(F.col("file_key") % 7 == 0))
    return audits.audit_binary_identity(files, exported, docs).withColumn(
        "error_codes", F.array_join("error_codes", ",")
    )


# One case per document: 30 characters from its middle, with 80 characters of context.
FACT_CASES_SQL = f"""
    cases AS (
      SELECT doc_id, substr({q.norm("text")}, length({q.norm("text")}) // 2 + 1, 30) AS fact,
        substr({q.norm("text")}, greatest(0, length({q.norm("text")}) // 2 - 25) + 1, 80) AS context FROM documents)"""


def _fact_cases(docs):
    norm = normalize_text(F.col("text"))
    half = F.floor(F.char_length(norm) / 2).cast("int")
    return docs.select(
        F.col("doc_id").alias("case_id"),
        F.col("doc_id").alias("artifact_id"),
        F.substring(norm, half + 1, F.lit(30)).alias("fact"),
        F.substring(norm, F.greatest(F.lit(0), half - 25) + 1, F.lit(80)).alias("context"),
    )


FACT_RESULT_SQL = f"""{FACT_CASES_SQL},
    per AS (
      SELECT c.doc_id AS case_id, any_value(contains(d.text, fact)) AS source_contains_fact,
        coalesce(bool_or(contains(chunk_text, fact)), false) AS chunk_contains_fact,
        coalesce(bool_or(contains(chunk_text, fact) AND contains(chunk_text, context)), false) AS context_preserved,
        coalesce(min(ordinal) FILTER (contains(chunk_text, fact) AND contains(chunk_text, context)),
                 min(ordinal) FILTER (contains(chunk_text, fact))) AS first_ordinal
      FROM cases c JOIN documents d USING (doc_id) LEFT JOIN chunks k ON k.doc_id = c.doc_id GROUP BY c.doc_id)"""


def _fact_results(spark, d):
    docs = Tables(spark, d).texts
    chunks = chunking.chunk_documents(docs, ["doc_id"]).select(
        F.col("doc_id").alias("artifact_id"), "ordinal", "chunk_text"
    )
    return audits.fact_preservation(
        _fact_cases(docs), docs.select(F.col("doc_id").alias("artifact_id"), "text"), chunks
    )


@query(
    "fact_preservation",
    "B7",
    f"""WITH RECURSIVE {q.chunk_ctes("documents", "doc_id", "text")}, {FACT_RESULT_SQL} SELECT * FROM per""",
)
def fact_preservation_query(spark, d):
    return _fact_results(spark, d)


@query(
    "fact_rates",
    "B7",
    f"""WITH RECURSIVE {q.chunk_ctes("documents", "doc_id", "text")}, {FACT_RESULT_SQL}
    SELECT count(*) AS cases, round(avg(CAST(source_contains_fact AS INT)), 6) AS source_rate,
      round(avg(CAST(chunk_contains_fact AS INT)), 6) AS chunk_rate,
      round(avg(CAST(context_preserved AS INT)), 6) AS context_rate FROM per""",
)
def fact_rates_query(spark, d):
    rates = audits.fact_rates(_fact_results(spark, d))
    return rates.select("cases", *[F.round(c, 6).alias(c) for c in ("source_rate", "chunk_rate", "context_rate")])


@query(
    "fact_retrieval_rank",
    "B8",
    f"""WITH b AS (SELECT item_id, {q.fold("text")} AS query, {q.tokens("text")} AS toks FROM benchmark),
    folded AS (SELECT item_id, query, list_transform(toks, lambda x: replace(x, 'ß', 'ss')) AS toks FROM b),
    h AS (SELECT doc_id, ' ' || {q.fold("text")} AS hay FROM documents),
    scored AS (
      SELECT item_id, doc_id, contains(hay, query) AS exact,
        (CASE WHEN contains(hay, query) THEN 5.0::DOUBLE ELSE 0 END) + list_sum(list_transform(toks,
          lambda x: CASE WHEN contains(hay, x) THEN 1.0::DOUBLE + least((length(hay) - length(replace(hay, x, '')))
            // length(x), 8) * 0.25::DOUBLE ELSE 0 END)) AS score
      FROM folded, h),
    expected AS (SELECT b.item_id, min(doc_id) AS expected_doc FROM benchmark b
      JOIN documents d ON contains(d.text, b.text) GROUP BY 1),
    top AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored
      WHERE score > 0 QUALIFY rank <= 5)
    SELECT e.item_id, expected_doc, min(t.rank) AS rank FROM expected e
    LEFT JOIN top t ON t.item_id = e.item_id AND t.doc_id = e.expected_doc GROUP BY ALL""",
)
def fact_retrieval_rank(spark, d):
    t = Tables(spark, d)
    cases = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    docs = t.documents.select(F.col("doc_id").alias("chunk_id"), "text")
    expected = passage_matches(cases, docs).groupBy("query_id").agg(F.min("chunk_id").alias("expected_doc"))
    hits = count_search_batch(cases, docs.withColumn("title", F.lit("")), 5)
    return (
        expected.join(
            hits.select("query_id", F.col("chunk_id").alias("expected_doc"), "rank"), ["query_id", "expected_doc"], "left"
        )
        .withColumnRenamed("query_id", "item_id")
        .withColumn("rank", F.col("rank").cast("long"))
    )


# Stored rows as files of several formats and encodings.
def _files(t: Tables):
    name = lambda prefix, key, end: F.concat(F.lit(f"/in/{prefix}"), F.col(key), F.lit(end)).alias("path")
    docs = t.documents
    parts = [
        t.pages.select(name("p", "page_id", ".HTML"), F.col("html").cast("binary").alias("content")),
        docs.where("lang <> 'de'").select(name("d", "doc_id", ".txt"), F.col("text").cast("binary").alias("content")),
        docs.where("lang = 'de'").select(name("d", "doc_id", ".md"), F.encode("text", "UTF-16").alias("content")),
        docs.select(name("b", "doc_id", ".bin"), F.col("text").cast("binary").alias("content")),
        docs.select(name("e", "doc_id", ".csv"), F.lit("").cast("binary").alias("content")),
        docs.select(
            name("x", "doc_id", ".xml"),
            F.when(F.col("lang") == "fr", F.lit("<a><b></a>"))
            .otherwise(F.concat(F.lit("<?xml version='1.0'?><a n='"), "n_chars", F.lit("'><lang>"), "lang", F.lit("</lang></a>")))
            .cast("binary")
            .alias("content"),
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


FILES_SQL = f"""
    files AS (
      SELECT '/in/p' || page_id || '.HTML' AS path, '.html' AS format, {q.html_text("html")} AS text FROM pages
      UNION ALL SELECT '/in/d' || doc_id || CASE WHEN lang = 'de' THEN '.md' ELSE '.txt' END, CASE WHEN lang = 'de' THEN '.md' ELSE '.txt' END, text FROM documents
      UNION ALL SELECT '/in/b' || doc_id || '.bin', '.bin', '' FROM documents
      UNION ALL SELECT '/in/e' || doc_id || '.csv', '.csv', '' FROM documents
      UNION ALL SELECT '/in/x' || doc_id || '.xml', '.xml', CASE WHEN lang = 'fr' THEN '' ELSE '<a n="' || n_chars || '"><lang>' || lang || '</lang></a>' END FROM documents),
    extracted AS (SELECT *, CASE WHEN format = '.bin' THEN 'unsupported' WHEN {q.strip("text")} = '' THEN 'empty' ELSE 'extracted' END AS status FROM files)"""


@query("extract_contents", "A3", f"WITH {FILES_SQL} SELECT path, format, status, sha256(text) AS text_hash FROM extracted")
def extract_contents_query(spark, d):
    return extract_contents(_files(Tables(spark, d))).select("path", "format", "status", F.sha2("text", 256).alias("text_hash"))


@query(
    "extraction_statuses",
    "A3",
    f"WITH {FILES_SQL} SELECT format, status, count(*) AS files, CAST(sum(length(text)) AS BIGINT) AS chars FROM extracted GROUP BY ALL",
)
def extraction_statuses_query(spark, d):
    return extraction_statuses(extract_contents(_files(Tables(spark, d))))
