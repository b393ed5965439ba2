"""The corpus pipeline: quality rules, near-duplicate removal, repeated passages, benchmark passages, source mix.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as the next
stage's documents. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dossier.llm.decontaminate import drop_contaminated
from dossier.llm.ngram_join import one_per_class
from dossier.llm.quality_rules import kept_documents
from dossier.llm.source_mix import mix_sources
from dossier.llm.suffix_dedup import without_repeats
from dossier.llm.tables import stored
from dossier.session import ship_package


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    ship_package(spark)
    return kept_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    ship_package(spark)
    return one_per_class(docs)


#: A passage of over 50 words is a repeat. Among 8 609 runs of 51 words and more that two texts of a 0.1 GB sample
#: share after near copies are gone, the shortest has 248 bytes and 1 % have fewer than 290; 37 % have fewer than 400.
#: Shorter lengths need more anchors: at 220 bytes the stage took more than its disk, four times the input.
PASSAGE_BYTES = 280


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated strings of ``PASSAGE_BYTES`` and more are cut from the texts; every document stays."""
    ship_package(spark)
    return without_repeats(docs, PASSAGE_BYTES)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    ship_package(spark)
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    ship_package(spark)
    return mix_sources(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram join", near_copies),
    ("suffix dedup", repeats),
    ("decontamination", benchmark_passages),
    ("source mix", mix),
]

#: SQL does not express the rules' estimation; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
