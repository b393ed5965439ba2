"""Rank fusion, hybrid search, query expansion, terminology tags, collapsing and reranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from dossier.functions.text import WORD_CHAR, casefold, computed_once, has_term, preview, strip
from dossier.operators.blocks import top_k
from dossier.operators.word_index import count_search_batch
from dossier.operators.neighbours import knn_join
from dossier.operators.vectors import hashing_embed

RRF_K = 60
MIN_CANDIDATES = 20
CANDIDATE_FACTOR = 3


def candidate_limit(target: int) -> int:
    return max(MIN_CANDIDATES, target * CANDIDATE_FACTOR)


def rrf_fuse(lists: Sequence[tuple[DataFrame, str, float | Column]], k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of (hits, kind, weight); kind is 'lexical' or 'vector'.

    Hits carry query_id, chunk_id, score, rank (and any column the weight needs). Output:
    query_id, chunk_id, fusion, lexical, vector.
    """
    parts = []
    for hits, kind, weight in lists:
        weight = weight if isinstance(weight, Column) else F.lit(float(weight))
        parts.append(
            hits.select(
                "query_id",
                "chunk_id",
                (weight / (F.lit(k) + F.col("rank"))).alias("gain"),
                F.when(F.lit(kind == "lexical"), F.col("score")).alias("lexical"),
                F.when(F.lit(kind == "vector"), F.col("score")).alias("vector"),
            )
        )
    return (
        reduce(DataFrame.unionByName, parts)
        .groupBy("query_id", "chunk_id")
        .agg(F.sum("gain").alias("fusion"), F.max("lexical").alias("lexical"), F.max("vector").alias("vector"))
    )


def ranked(fused: DataFrame, limit: int | None = None) -> DataFrame:
    """Order by fusion score, ties by chunk_id; rounded so that equal sums tie in any order."""
    order = [F.desc(F.round("fusion", 12)), F.col("chunk_id")]
    if limit is not None:
        return top_k(fused, "query_id", order, limit)
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def hybrid_search(
    queries: DataFrame,
    docs: DataFrame,
    vectors: DataFrame,
    limit: int = 10,
    mode: str = "hybrid",
    lexical_weight: float = 1.0,
    vector_weight: float = 1.0,
    dimension: int = 256,
    ranker: Callable[[DataFrame], DataFrame] | None = None,
    target: int | None = None,
) -> DataFrame:
    """Search a table of queries (query_id, variant_no, query, weight) by both legs and fuse.

    Variant 0 is the query itself. All variants of all queries run as one batch per leg.
    docs: chunk_id, title, text; vectors: chunk_id, vector.
    """
    if mode not in ("lexical", "vector", "hybrid"):
        raise ValueError(f"unknown mode {mode}")
    take = candidate_limit(target or limit)
    flat = queries.select(
        F.concat_ws("|", F.col("query_id").cast("string"), F.col("variant_no").cast("string")).alias("key"),
        "query_id",
        "query",
        "weight",
    )
    keyed = flat.select(F.col("key").alias("query_id"), "query")
    names = flat.select("key", "query_id", "weight")

    def attach(hits: DataFrame) -> DataFrame:
        return hits.withColumnRenamed("query_id", "key").join(names, "key").drop("key")

    lists = []
    if mode in ("lexical", "hybrid"):
        lists.append((attach(count_search_batch(keyed, docs, take)), "lexical", F.col("weight") * lexical_weight))
    if mode in ("vector", "hybrid"):
        embedded = keyed.select("query_id", hashing_embed(F.col("query"), dimension).alias("vector"))
        lists.append((attach(knn_join(embedded, vectors, take)), "vector", F.col("weight") * vector_weight))
    fused = rrf_fuse(lists)
    if ranker is not None:
        fused = ranker(fused)
    return ranked(fused, limit)


def query_variants(queries: DataFrame, variants: DataFrame | None = None, weight: float = 0.5) -> DataFrame:
    """(query_id, query) plus variants (query_id, variant_no >= 1, query) as one weighted table."""
    base = queries.select("query_id", F.lit(0).alias("variant_no"), "query", F.lit(1.0).alias("weight"))
    if variants is None:
        return base
    return base.unionByName(
        variants.select("query_id", F.col("variant_no").cast("int"), "query", F.lit(weight).alias("weight"))
    )


def _around(query: Column, term: Column, part: int) -> Column:
    """Text before (1) or after (2) the first whole-word match of a literal term."""
    pattern = F.concat(F.lit(f"(?siu)^(.*?)(?<!{WORD_CHAR})\\Q"), term, F.lit(f"\\E(?!{WORD_CHAR})(.*)$"))
    return F.call_function("regexp_extract", query, pattern, F.lit(part))


def expand_queries(queries: DataFrame, dictionary: DataFrame, limit: int) -> DataFrame:
    """Variants of each query by one whole-word replacement from a dictionary.

    queries: query_id, query; dictionary: term_no, term, replacement_no, replacement
    (a few hundred curated rows). A term joins a query on the words it starts with, then the
    exact whole-word test decides. Equal variants collapse, the first ``limit`` stay.
    """
    first_word = lambda c: F.regexp_extract(casefold(c), f"{WORD_CHAR}+", 0)
    words = queries.select(
        "query_id",
        "query",
        F.explode(F.array_distinct(F.regexp_extract_all(casefold(F.col("query")), F.lit(f"{WORD_CHAR}+"), F.lit(0)))).alias(
            "word"
        ),
    )
    terms = dictionary.where(strip(F.col("term")) != "").select(
        "term_no",
        "replacement_no",
        casefold(strip(F.col("term"))).alias("term"),
        strip(F.col("replacement")).alias("replacement"),
        first_word(F.col("term")).alias("word"),
    )
    hits = words.join(terms, "word").where(
        (F.col("replacement") != "")
        & has_term(casefold(F.col("query")), F.col("term"))
        & has_term(F.col("query"), F.col("term"))
    )
    query, term = F.col("query"), F.col("term")
    expanded = strip(F.concat(_around(query, term, 1), F.col("replacement"), _around(query, term, 2)))
    variants = (
        hits.withColumn("expanded", expanded)
        .withColumn("key", casefold(F.col("expanded")))
        .where((F.col("expanded") != "") & (F.col("key") != casefold(strip(F.col("query")))))
    )
    firsts = variants.groupBy("query_id", "key").agg(
        F.min_by(F.struct("term_no", "replacement_no", "expanded", "term"), F.struct("term_no", "replacement_no")).alias("v")
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("v.term_no", "v.replacement_no"))
    return (
        firsts.withColumn("variant_no", place)
        .where(F.col("variant_no") <= limit)
        .select(
            "query_id",
            "variant_no",
            F.col("v.expanded").alias("query"),
            F.concat(F.lit("dictionary:"), "v.term").alias("source"),
        )
    )


def group_dictionary(groups: Sequence[dict]) -> list[tuple[int, str, int, str]]:
    """Alias groups as dictionary rows: every alias may be replaced by every other one."""
    terms: dict[str, list[str]] = {}
    for group in groups:
        for alias in group["aliases"]:
            others = terms.setdefault(alias, [])
            for other in group["aliases"]:
                if other.casefold() != alias.casefold() and other not in others:
                    others.append(other)
    return [
        (number, term, place, other)
        for number, (term, others) in enumerate(terms.items())
        for place, other in enumerate(others)
    ]


def tag_terminology(chunks: DataFrame, groups: Sequence[dict], max_chars: int | None = None) -> DataFrame:
    """Candidate tags per chunk: chunk_id, group_id, terms, contexts.

    A group has aliases, ambiguous aliases, contexts and exclusions. Any exclusion drops
    the group; a match by ambiguous aliases only needs a context term in the same chunk.
    Whole texts are read unless ``max_chars`` asks for a cut.
    """
    text = F.col("text") if max_chars is None else F.substring("text", 1, max_chars)

    def found(words: Sequence[str]) -> Column:
        return F.array_compact(F.array(*[F.when(has_term(F.col("__text"), F.lit(w)), F.lit(w)) for w in words]))

    tags = []
    for group in groups:
        ambiguous = {a.casefold() for a in group.get("ambiguous", ())}
        clear = [a for a in group["aliases"] if a.casefold() not in ambiguous]
        none = F.array().cast("array<string>")
        terms = found(group["aliases"])
        contexts = found(group["contexts"]) if group.get("contexts") else none
        excluded = found(group["exclusions"]) if group.get("exclusions") else none
        has_clear = F.size(F.array_intersect(terms, F.array(*[F.lit(c) for c in clear]).cast("array<string>"))) > 0
        valid = (F.size(excluded) == 0) & (F.size(terms) > 0) & (has_clear | (F.size(contexts) > 0))
        tags.append(F.when(valid, F.struct(F.lit(group["id"]).alias("group_id"), terms.alias("terms"), contexts.alias("contexts"))))
    return (
        chunks.select("chunk_id", text.alias("__text"))
        .select("chunk_id", F.explode(F.array_compact(F.array(*tags))).alias("tag"))
        .select("chunk_id", "tag.group_id", "tag.terms", "tag.contexts")
    )


def collapse_by_uri(hits: DataFrame, k: int) -> DataFrame:
    """First hit per (query, URI), blank URIs count by chunk_id; renumbered, first k."""
    uri = strip(F.coalesce("canonical_uri", F.lit("")))
    key = F.when(uri == "", F.col("chunk_id").cast("string")).otherwise(uri)
    rest = [c for c in hits.columns if c != "query_id"]
    firsts = (
        hits.withColumn("__key", key)
        .groupBy("query_id", "__key")
        .agg(F.min_by(F.struct(*rest), F.col("rank")).alias("h"))
        .select("query_id", "h.*")
    )
    return top_k(firsts, "query_id", [F.col("rank")], k, "place")


def federated_dedupe(hits: DataFrame, k: int) -> DataFrame:
    """Per (query, URI) only hits of the collection seen first; renumbered, first k."""
    uri = strip(F.coalesce("canonical_uri", F.lit("")))
    collection = F.coalesce("collection_id", F.lit(""))
    keyed = hits.withColumn("__uri", uri)
    winners = (
        keyed.where((F.col("__uri") != "") & (collection != ""))
        .groupBy("query_id", "__uri")
        .agg(F.min_by("collection_id", "rank").alias("__winner"))
    )
    kept = (
        keyed.join(winners, ["query_id", "__uri"], "left")
        .where(F.col("__winner").isNull() | (collection == "") | (F.col("__winner") == collection))
        .drop("__uri", "__winner")
    )
    return top_k(kept, "query_id", [F.col("rank")], k, "place")


def overfetch(limit: int, collections: int, collapse: bool) -> int:
    """Hits to fetch before collapsing or federated deduplication."""
    return limit * (4 if collapse else min(max(collections, 2), 8))


@computed_once
@F.pandas_udf(DoubleType())
def token_overlap(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Stand-in pair scorer: share of the query's words that the passage holds."""
    for queries, passages in batches:
        out = []
        for query, passage in zip(queries, passages):
            wanted = set((query or "").lower().split())
            out.append(len(wanted & set((passage or "").lower().split())) / len(wanted) if wanted else 0.0)
        yield pd.Series(out)


def rerank(
    hits: DataFrame, scorer: Callable[[Column, Column], Column], n: int, passage_chars: int | None = None
) -> DataFrame:
    """Score the first n hits of each query with a pair scorer and reorder.

    hits: query_id, query, chunk_id, title, text, rank. Scored hits come first by
    (-score, chunk_id); the rest, and hits whose score is null, keep their order after. The
    scorer sees whole texts, or their first ``passage_chars`` characters.
    """
    shown = F.col("text") if passage_chars is None else F.substring("text", 1, passage_chars)
    passage = strip(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), shown))
    head = hits.where(F.col("rank") <= n).withColumn("rerank", scorer(F.col("query"), passage))
    tail = hits.where(F.col("rank") > n).withColumn("rerank", F.lit(None).cast("double"))
    order = Window.partitionBy("query_id").orderBy(
        F.col("rerank").isNull(),
        F.desc("rerank"),
        F.when(F.col("rerank").isNotNull(), F.col("chunk_id")),
        "rank",
    )
    return head.unionByName(tail).withColumn("place", F.row_number().over(order))


def hydrate_hits(hits: DataFrame, chunks: DataFrame, documents: DataFrame, resources: DataFrame) -> DataFrame:
    """Join text, title and URI to the few final hits and add the evidence struct."""
    return (
        hits.join(chunks.select("chunk_id", "document_id", F.col("chunk_text").alias("text")), "chunk_id")
        .join(documents.select("document_id", "resource_id", "title"), "document_id")
        .join(resources.select("resource_id", "canonical_uri", "collection_id"), "resource_id")
        .withColumn("preview", preview(F.col("text")))
        .withColumn("evidence", F.struct("resource_id", "document_id", "chunk_id", "canonical_uri"))
    )
