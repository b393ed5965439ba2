"""The registered queries of this subpackage: name, Spark callable, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import (
    context_tree,
    decontaminate,
    hard_negatives,
    language_id,
    license_scan,
    ngram_join,
    ordinal_quality,
    quality_rules,
    signature_search,
    source_mix,
    suffix_dedup,
    token_count,
    token_files,
)


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        ENTRIES[name] = Entry(run, sql)
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op7_mix_sources", source_mix.SQL)
def op7_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return source_mix.mix_sources(table(spark, folder, "documents"))


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_count.count_tokens(table(spark, folder, "documents"))


@query("op9_language_id")
def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = language_id.identify(docs, docs.filter(~language_id.held_out()))
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


@query("op1_quality_rules")
def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(table(spark, folder, "documents"))


@query("op8_decontaminate", decontaminate.SQL)
def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op6_context_tree")
def op6_context_tree(spark: SparkSession, folder: str) -> DataFrame:
    return context_tree.score_texts(table(spark, folder, "documents"), context_tree.held_out())


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.removal_report(table(spark, folder, "documents"))


@query("op2_ngram_join")
def op2_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, folder, "documents"))


@query("op4_ordinal_quality")
def op4_ordinal_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Grades of the labels: 0 for poor text, 1 for good but toxic text, 2 for good text."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    clean = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0)
    model = ordinal_quality.fit(docs, labels.select("doc_id", (F.col("quality") + clean).alias("grade")))
    return ordinal_quality.grade_documents(docs, model)


@query("op5_license_scan", license_scan.SQL)
def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(table(spark, folder, "documents"))


@query("op13_hard_negatives", hard_negatives.SQL)
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = hard_negatives.noisy_labels(table(spark, folder, "embeddings"))
    return hard_negatives.mine(vectors, F.col("row_id") % 100 == 0)


@query("op12_token_files")
def op12_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.encode_and_report(table(spark, folder, "documents"))


@query("op11_signature_search", signature_search.SQL)
def op11_signature_search(spark: SparkSession, folder: str) -> DataFrame:
    index = signature_search.build_index(table(spark, folder, "documents"))
    return signature_search.search(index, table(spark, folder, "benchmark"))
