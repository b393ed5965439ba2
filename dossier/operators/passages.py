"""Which texts hold a passage verbatim, by winnowed fingerprints and a check at the place they point to."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions.fingerprints import fingerprints, level_of
from dossier.operators.blocks import kind_of, spread
from dossier.session import cut_lineage

#: Rows that one batch of fingerprints holds, about.
BATCH_ROWS = 200_000


def prints_of(rows: DataFrame, key: str, levels: list[int] | None) -> DataFrame:
    """key, level, print, place. ``levels`` of every text, or each text's own level by its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            size = 0
            for row, text in enumerate(batch.column(1).to_pylist()):
                for level in levels or [level_of(len(text))]:
                    prints, places = fingerprints(text, level)
                    held.append((np.full(len(prints), row), np.full(len(prints), level, np.int32), prints, places))
                    size += len(prints)
                if size >= BATCH_ROWS:
                    yield packed(batch.column(0), held)
                    held, size = [], 0
            if held:
                yield packed(batch.column(0), held)

    def packed(keys: pa.Array, held: list[tuple]) -> pa.RecordBatch:
        row, level, prints, places = (np.concatenate(c) for c in zip(*held))
        columns = [keys.take(pa.array(row)), pa.array(level), pa.array(prints), pa.array(places.astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, names=[key, "level", "print", "place"])

    return rows.mapInArrow(run, f"{key} {kind_of(rows, key)}, level int, print long, place int")


def passage_matches(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, chunk_id) pairs where the text holds the whole passage verbatim.

    queries: query_id (one row each), query; docs: chunk_id (one row each), text. Texts and passages meet on the hash of
    a window; of each passage only its rarest print is followed, so a passage that opens with a common line does not
    meet every text that has the line. Blank passages match nothing.
    """
    wanted = cut_lineage(queries.select("query_id", "query").where(F.coalesce("query", F.lit("")) != ""))
    asked = cut_lineage(prints_of(wanted, "query_id", None))
    levels = [r["level"] for r in asked.select("level").distinct().collect()]  # 16 at most
    texts = docs.select("chunk_id", F.coalesce("text", F.lit("")).alias("text"))
    on = ["level", "print"]
    found = prints_of(spread(texts, "chunk_id"), "chunk_id", levels)
    found = cut_lineage(found.join(asked.select(*on).distinct(), on, "left_semi"))
    times = found.groupBy(*on).agg(F.count("*").alias("times"))
    counted = asked.join(times, on, "left").withColumn("times", F.coalesce("times", F.lit(0)))
    # A print that no text has is the rarest: its passage is nowhere.
    rarest = counted.groupBy("query_id").agg(F.min_by(F.struct(*on, "place"), F.struct("times", "place")).alias("p"))
    rarest = rarest.select("query_id", "p.level", "p.print", F.col("p.place").alias("offset"))
    pairs = found.join(rarest, on).select("chunk_id", "query_id", (F.col("place") - F.col("offset")).alias("start"))
    pairs = pairs.where("start >= 0").join(wanted, "query_id")
    there = F.substr("text", F.col("start") + 1, F.char_length("query")) == F.col("query")
    return texts.join(pairs, "chunk_id").where(there).select("query_id", "chunk_id").distinct()
