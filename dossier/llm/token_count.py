"""Token counts of whole texts by a byte-level BPE vocabulary, with overlap resynchronisation for huge documents.

A *stable boundary* is a place between a character that is no white space and an ASCII white-space character. The
pre-tokenizer never joins the two sides of such a place, and what it makes of one side does not depend on the other:
no pattern of byte-level BPE holds white space after other characters, and no special string holds white space. So
encoding the two sides apart gives the tokens of the whole.

Texts of up to ``chunk`` characters are encoded in place. Longer ones are cut into overlapping chunks that travel as
rows, so one huge document is spread over the cluster. Chunk i is encoded with the offsets of its tokens. Its count
starts at the first stable boundary of its own overlap and stops at the first one of the next chunk's overlap; both
neighbours find the same place, check that it is a token boundary of their own encoding, and splice there. Where an
overlap has no such place, or a neighbour's tokens do not end there, the document's overlaps are widened eightfold
and it is encoded again, in the end as one chunk.

Encoding in place uses the same boundaries: a text is the sequence of its pieces between stable boundaries, and a
piece's number of tokens is remembered by the worker (a bounded memory; a full one is emptied).

Null texts count as empty: 0 bytes, 0 tokens. Special strings inside texts are handled as the library does by
default. Repeated rows, and rows of one id with other texts, are counted each; null ids are kept. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.tables import id_number, id_text, stored

#: Python counts U+001C to U+001F as white space; the cut asks for ASCII white space that every pattern agrees on.
STABLE = re.compile(r"(?<=\S)(?=[ \t-\r])")
IRREGULAR = re.compile(r"\s |  |^ ")
REMEMBERED = 600_000
LONGEST_REMEMBERED = 64


class Counter:
    """Token counts by one vocabulary file, remembered by piece."""

    made: dict[str, Counter] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, int] = {"": 0}

    @classmethod
    def of(cls, path: str | None) -> Counter:
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    def encode(self, pieces: list[str]) -> np.ndarray:
        """Tokens of each piece. Pieces that meet at stable boundaries are encoded as one text, told apart by offsets."""
        runs, at, closed = [], [], True
        for i, piece in enumerate(pieces):
            if closed or piece[0] not in " \t\n\v\f\r" or i - at[-1] >= 256:
                at.append(i)
            closed = piece[-1].isspace()
        at.append(len(pieces))
        for first, stop in itertools.pairwise(at):
            runs.append("".join(pieces[first:stop]))
        out = np.zeros(len(pieces), np.int64)
        encodings = self.tokenizer.encode_batch(runs, add_special_tokens=False)
        for (first, stop), done in zip(itertools.pairwise(at), encodings, strict=True):
            ends = np.cumsum([len(p) for p in pieces[first:stop]])
            token_ends = np.array([b for _, b in done.offsets], np.int64)
            out[first:stop] = np.bincount(np.searchsorted(ends, token_ends), minlength=stop - first)
        return out

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        cut = [pieces_of(t) for t in texts]
        known = self.known
        new = list({p for pieces in cut for p in pieces if p not in known})
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            known[""] = 0
            new = list({p for pieces in cut for p in pieces if p})
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            known.update(zip(part, self.encode(part).tolist(), strict=True))
        out = [sum(map(known.__getitem__, pieces)) for pieces in cut]
        for p in new:
            if len(p) > LONGEST_REMEMBERED:
                del known[p]
        return out

    def between(self, text: str, start: int, stop: int | None) -> int | None:
        """Tokens of the encoding of ``text`` between two places; None where a place is no token boundary."""
        total, offset, ends = 0, 0, {0}
        for piece in STABLE.split(text):
            spans = self.tokenizer.encode(piece, add_special_tokens=False).offsets
            for a, b in spans:
                # Several tokens may share one character: its border is where the last of them ends.
                total += offset + a >= start and (stop is None or offset + b <= stop)
                ends.add(offset + b)
            offset += len(piece)
        return total if start in ends and (stop is None or stop in ends) else None


def pieces_of(text: str) -> list[str]:
    """The text between its stable boundaries (or some of them)."""
    if IRREGULAR.search(text):
        return STABLE.split(text)
    first, *rest = text.split(" ")
    return [first, *[" " + w for w in rest]]


def first_stable(text: str, start: int, stop: int) -> int | None:
    """The first stable boundary b with start < b < stop."""
    found = STABLE.search(text, start + 1, stop)
    return found.start() if found else None


def short_counts(path: str | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Counter.of(path)
        for batch in batches:
            texts = batch.pop("text").tolist()
            counts: list[int] = []
            for at in range(0, len(texts), 512):
                counts += counter.count(texts[at : at + 512])
            yield batch.assign(n_tokens=np.array(counts, np.int64))

    return run


def chunk_counts(path: str | None, stride: int, overlap: int):
    """Tokens that a chunk stands for; -1 where a splice on one of its sides is not proven."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Counter.of(path)
        for batch in batches:
            counts = []
            for text, nth, last in zip(batch["text"], batch["nth"], batch["last"], strict=True):
                start = 0 if nth == 0 else first_stable(text, 0, overlap)
                stop = None if nth == last else first_stable(text, stride, stride + overlap)
                if start is None or (stop is None and nth != last):
                    counts.append(-1)
                    continue
                found = counter.between(text, start, stop)
                counts.append(-1 if found is None else found)
            yield batch.drop(columns=["text", "last"]).assign(n_tokens=np.array(counts, np.int64))

    return run


def long_counts(docs: DataFrame, path: str | None, chunk: int, overlap: int) -> DataFrame:
    """Counts of documents longer than a chunk (doc_id, text, text_hash, n_bytes, n_chars)."""
    done: DataFrame | None = None
    todo = docs
    while True:
        stride = chunk if overlap < chunk else overlap
        # The last chunk has an overlap's length at least: a shorter rest belongs to the chunk before.
        last = F.greatest(F.floor((F.col("n_chars") - overlap) / stride), F.lit(0)).cast("int")
        cut = todo.withColumn("last", last).withColumn("nth", F.explode(F.sequence(F.lit(0), "last")))
        length = F.when(F.col("nth") == F.col("last"), F.col("n_chars")).otherwise(F.lit(stride + overlap)).cast("int")
        cut = cut.withColumn("text", F.substring("text", F.col("nth") * stride + 1, length))
        cut = cut.select("doc_id", "text_hash", "n_bytes", "nth", "last", "text")
        spread = cut.repartition(F.xxhash64("doc_id", "text_hash", "nth"))
        counted = spread.mapInPandas(
            chunk_counts(path, stride, overlap),
            "doc_id string, text_hash long, n_bytes long, nth int, n_tokens long",
        )
        # Equal rows of the input have equal chunks: chunk 0 tells how many rows there are.
        rows = F.sum((F.col("nth") == 0).cast("int"))
        result = stored(
            counted.groupBy("doc_id", "text_hash", "n_bytes").agg(
                rows.alias("rows"),
                F.floor(F.sum("n_tokens") / rows).cast("long").alias("n_tokens"),
                F.max((F.col("n_tokens") < 0).cast("int")).alias("failed"),
            ),
            "token-chunks",
        )
        good = result.filter("failed = 0").drop("failed")
        done = good if done is None else done.unionByName(good)
        failed = result.filter("failed = 1")
        if failed.isEmpty():
            break
        names = failed.select(F.col("doc_id").alias("f_id"), F.col("text_hash").alias("f_hash"))
        same = F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("text_hash") == F.col("f_hash"))
        todo = todo.join(names, same, "left_semi")
        overlap *= 8
    return done.withColumn("row", F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int")))).drop("row", "rows")


def count_tokens(
    docs: DataFrame, path: str | None = None, limit: int = 512, chunk: int = 1 << 16, overlap: int = 1 << 10
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. ``path``: the vocabulary file, the same on every executor.

    ``chunk`` and ``overlap`` are in characters; they change where the work is done, not the counts.
    """
    if not 0 < overlap <= chunk:
        raise ValueError("overlap must be positive and at most chunk")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        id_text(),
        text.alias("text"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.char_length(text).alias("n_chars"),
    )
    short = rows.filter(F.col("n_chars") <= chunk + overlap).select("doc_id", "n_bytes", "text")
    counted = short.mapInPandas(short_counts(path), "doc_id string, n_bytes long, n_tokens long")
    long = rows.filter(F.col("n_chars") > chunk + overlap).withColumn("text_hash", F.xxhash64("text"))
    counted = counted.unionByName(long_counts(long, path, chunk, overlap).select("doc_id", "n_bytes", "n_tokens"))
    return counted.select(id_number(), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
