"""Sliding-window chunking of normalised text, and chunk deduplication."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.functions.text import normalize_text, token_estimate
from dossier.operators.blocks import PART, computed, in_parts, spread

CHUNK_SIZE = 1500
CHUNK_OVERLAP = 200
CHUNK_MIN = 120


def spans(text: str, size: int, overlap: int, minimum: int) -> Iterator[tuple[int, int, str]]:
    """(start, end, piece) of one normalised text; first of equal pieces only."""
    total = len(text)
    if total < minimum:
        if total:
            yield 0, total, text
        return
    size = max(minimum, size)
    overlap = max(0, min(overlap, size // 2))
    if overlap < minimum:
        # The last piece could then be too short to keep, and its text would be lost.
        raise ValueError("overlap must be at least the minimum length, and at most half the size")
    seen: set[str] = set()
    start = 0
    while start < total:
        end = min(total, start + size)
        if end < total:
            # Normalised text has single spaces only, so the last one is the best break.
            cut = text.rfind(" ", start, end)
            if cut >= 0 and cut - start >= minimum // 2:
                end = cut + 1
        piece = text[start:end].strip(" ")
        if len(piece) >= minimum and piece not in seen:
            seen.add(piece)
            yield start, end, piece
        if end >= total:
            return
        start = max(end - overlap, start + 1)
        while start < total and text[start] == " ":
            start += 1


def chunk_documents(
    df: DataFrame,
    keys: Sequence[str],
    text: str = "text",
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    minimum: int = CHUNK_MIN,
) -> DataFrame:
    """Cut each document into overlapping chunks.

    The cut is sequential inside one document and narrow across documents: no shuffle.
    Only the key columns and the normalised text cross into Python; hashing and
    counting stay on the JVM side.
    """
    if size < 1 or minimum < 1 or overlap < 0:
        raise ValueError("size and minimum must be positive, overlap non-negative")
    source = spread(df.select(*keys, normalize_text(F.col(text)).alias("__text")), keys[0])
    key_fields = [source.schema[k] for k in keys]
    schema = T.StructType(
        key_fields
        + [
            T.StructField("ordinal", T.IntegerType()),
            T.StructField("chunk_text", T.StringType()),
            T.StructField("char_start", T.IntegerType()),
            T.StructField("char_end", T.IntegerType()),
        ]
    )

    def cut(batches):
        for batch in in_parts(batches, PART):
            rows, ordinals, starts, ends, pieces = [], [], [], [], []
            for row, value in enumerate(batch.column(len(keys)).to_pylist()):
                for ordinal, (start, end, piece) in enumerate(spans(value or "", size, overlap, minimum)):
                    rows.append(row)
                    ordinals.append(ordinal)
                    starts.append(start)
                    ends.append(end)
                    pieces.append(piece)
            picked = [batch.column(i).take(pa.array(rows, pa.int64())) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays(
                picked
                + [
                    pa.array(ordinals, pa.int32()),
                    pa.array(pieces, pa.string()),
                    pa.array(starts, pa.int32()),
                    pa.array(ends, pa.int32()),
                ],
                names=[*keys, "ordinal", "chunk_text", "char_start", "char_end"],
            )

    return source.mapInArrow(cut, schema).select(
        *keys,
        "ordinal",
        "chunk_text",
        F.sha2("chunk_text", 256).alias("content_hash"),
        "char_start",
        "char_end",
        token_estimate(F.col("chunk_text")).alias("token_estimate"),
    )


def whole_text_chunks(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Pre-chunked input: the whole normalised text is one chunk; empty texts give none."""
    norm = normalize_text(F.col(text))
    return (
        computed(df.select(*keys, text), chunk_text=norm)
        .where(F.char_length("chunk_text") > 0)
        .select(
            *keys,
            F.lit(0).alias("ordinal"),
            "chunk_text",
            F.sha2("chunk_text", 256).alias("content_hash"),
            F.lit(0).alias("char_start"),
            F.char_length("chunk_text").alias("char_end"),
            token_estimate(F.col("chunk_text")).alias("token_estimate"),
        )
    )


def dedupe_chunks(
    df: DataFrame, document: str, content_hash: str = "content_hash", ordinal: str = "ordinal"
) -> DataFrame:
    """Keep the first chunk of each hash inside a document and renumber from 0.

    The first-of-hash step is a partial aggregation, so repeated chunks are
    dropped before the shuffle; only the renumbering sorts, one document at a time.
    """
    rest = [c for c in df.columns if c not in (document, content_hash)]
    first = df.groupBy(document, content_hash).agg(
        F.min_by(F.struct(*rest), F.col(ordinal)).alias("__row")
    )
    order: Column = F.row_number().over(Window.partitionBy(document).orderBy("__row." + ordinal)) - 1
    return first.select(
        document,
        content_hash,
        order.alias(ordinal),
        *[F.col(f"__row.{c}").alias(c) for c in rest if c != ordinal],
    )
