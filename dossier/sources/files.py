"""Raw files to text, one job over a folder."""

from __future__ import annotations

import re
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions.files import file_text
from dossier.operators.blocks import spread


def extract_contents(df: DataFrame, max_chars: int | None = None) -> DataFrame:
    """(path, content) -> path, format, status, text; narrow, one Arrow batch at a time."""

    def run(batches):
        for batch in batches:
            found = [file_text(p or "", c, max_chars) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            columns = [pa.array([row[i] for row in found], pa.string()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["path", "format", "status", "text"])

    return df.select("path", "content").mapInArrow(run, "path string, format string, status string, text string")


def extract_files(spark: SparkSession, folder: str, pattern: str = "*", max_chars: int | None = None) -> DataFrame:
    """Text of every file below a folder.

    The reader already packs whole files into splits of even size; only an input too small to
    fill the cores is redistributed.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    # The reader makes no task for files of length 0, so those are taken from its file index.
    spelled = [(re.sub(r"^(\w+):/+", r"\1:/", unquote(p)),) for p in listing.inputFiles()]
    named = spark.createDataFrame(spelled, "path string")
    plain = F.regexp_replace("path", r"^(\w+):/+", "$1:/")
    blank = named.join(listing.where("length > 0").select(plain.alias("path")), "path", "left_anti")
    rows = listing.select("path", "content").unionByName(blank.withColumn("content", F.lit(b"")))
    return extract_contents(spread(rows, "path"), max_chars)


def extraction_statuses(extracted: DataFrame) -> DataFrame:
    return extracted.groupBy("format", "status").agg(F.count("*").alias("files"), F.sum(F.char_length("text")).alias("chars"))
