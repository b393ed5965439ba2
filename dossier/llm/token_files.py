"""Token ids of documents as Parquet files, laid out for selective reads.

Layout. Documents are dealt into range parts by (doc_id, hash of the text), one file or more per part, rows in that
order. A row holds ``doc_id``, ``part``, ``start`` (ids of the part before it), ``n_tokens`` and the list ``ids``, the
document's tokens and one end id. ``ids`` is dictionary-encoded (a vocabulary fits one dictionary page, so an id takes
at most 16 bits before compression); the other columns ascend or repeat and are delta-encoded. Row groups and pages
have a set size and Parquet writes column and offset indexes, so a filter on ``doc_id`` or ``start`` reads the pages
it needs, and a reader of metadata never touches the ids.

The place of a document among all ids is the sum of the parts before its own plus ``start``. It needs the sizes of the
parts only, which are read from the metadata columns (``parts_of``), one row per part.

Encoding. A text is cut where a space follows a character that is no white space: the pre-tokenizer never joins the
two sides of such a place, and special strings hold no white space. The ids of a piece are remembered by the worker (a
bounded memory), and a text's ids are the pieces' ids in a row. Texts with other white space
before a space are cut at the places that ``token_count`` proves.

Null texts count as empty and hold the end id alone. Special strings inside texts are handled as the library does by
default. Null ids come first. Repeated rows are written each, next to each other; rows of one id and other texts are
ordered by the hash of the text. An empty table gives files without rows. Other columns are not read.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.llm.tables import shuffle_partitions
from dossier.llm.token_count import pieces_of
from dossier.llm.words import encoded, prefix_hash, span_hash
from dossier.session import work_folder

#: Pieces that a worker remembers, at about 30 bytes each; a full memory is emptied.
REMEMBERED = 3_000_000
#: White space other than the space and the line feed. Texts that have some are cut by the general rule.
ODD_SPACE = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
RUN = 256

FILE_SCHEMA = "doc_id bigint, part int, start bigint, n_tokens int, ids array<int>"


def regular(text: str) -> bool:
    """Whether every space stands between two characters that are no white space, or before a line feed."""
    return not (text[:1] == " " or text[-1:] == " " or "  " in text or "\n " in text or ODD_SPACE.search(text))


class Encoder:
    """Ids of whole texts by one vocabulary file, as little-endian 32-bit integers.

    Remembered pieces lie in arrays: the sorted hashes of their words, and where their ids start in a pool.
    """

    made: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Bytes that a token stands for in a byte-level vocabulary, whose alphabet has a sign for each byte.
        self.widths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.widths[list(vocabulary.values())] = [len(token) for token in vocabulary]
        self.forget()

    @classmethod
    def of(cls, path: str | None) -> Encoder:
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    def forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, "<u4")

    def plainly(self, pieces: list[str]) -> list[np.ndarray]:
        done = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in done]

    def after_space(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of the pieces of a space and a word, many to one call of the library.

        The ids of a run of pieces are told apart by the bytes they stand for. Where those do not end with the pieces,
        or a word ends with white space, so that the next piece does not stand by itself, each is encoded alone.
        """
        runs = [words[at : at + RUN] for at in range(0, len(words), RUN)]
        texts = [[w.decode("utf-8", "surrogatepass") for w in run] for run in runs]
        done = self.tokenizer.encode_batch_fast([f" {' '.join(t)}" for t in texts], add_special_tokens=False)
        ids, sizes = [], []
        for run, text, encoding in zip(runs, texts, done, strict=True):
            found = np.array(encoding.ids, "<u4")
            reach = np.cumsum(self.widths[found])
            ends = np.cumsum([len(w) + 1 for w in run])
            if any(t[-1].isspace() for t in text) or not len(found) or reach[-1] != ends[-1]:
                last = None
            else:
                last = np.searchsorted(reach, ends)
            if last is None or (reach[last] != ends).any():
                alone = self.plainly([" " + t for t in text])
                ids += alone
                sizes.append(np.array([len(a) for a in alone], np.int64))
            else:
                ids.append(found)
                sizes.append(np.diff(last, prepend=-1))
        return (np.concatenate(ids), np.concatenate(sizes)) if ids else (self.pool[:0], self.sizes[:0])

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Where the hashes stand among the remembered ones; -1 where they do not."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        ids, sizes = self.after_space(words)
        starts = len(self.pool) + np.cumsum(sizes) - sizes
        self.pool = np.concatenate((self.pool, ids))
        at = np.searchsorted(self.hashes, hashes)
        self.starts, self.sizes = np.insert(self.starts, at, starts), np.insert(self.sizes, at, sizes)
        self.hashes = np.insert(self.hashes, at, hashes)

    def words_of(self, buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of the words of a buffer, each ended by a space."""
        data = np.frombuffer(buffer, np.uint8)
        end = np.flatnonzero(data == 32)
        start = np.concatenate(([0], end[:-1] + 1)) if len(end) else end
        hashes, first, which = np.unique(
            span_hash(prefix_hash(data), start, end), return_index=True, return_inverse=True
        )
        new = np.flatnonzero(self.places(hashes) < 0)
        if len(self.hashes) + len(new) > REMEMBERED:
            self.forget()
            new = np.arange(len(hashes))
        if len(new):
            spans = zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)
            self.learn(hashes[new], [buffer[a:b] for a, b in spans])
        at = self.places(hashes)
        sizes = self.sizes[at][which]
        border = np.cumsum(sizes)
        within = np.repeat(self.starts[at][which] - (border - sizes), sizes) + np.arange(border[-1] if len(border) else 0)
        return self.pool[within], sizes

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        out = [b""] * len(texts)
        even = [i for i, text in enumerate(texts) if regular(text)]
        for i in set(range(len(texts))).difference(even):
            out[i] = b"".join(a.tobytes() for a in self.plainly([p for p in pieces_of(texts[i]) if p]))
        cut = [texts[i].partition(" ") for i in even]
        firsts = self.plainly([first for first, _, _ in cut])
        rests = [encoded(rest) + b" " if space else b"" for _, space, rest in cut]
        ids, sizes = self.words_of(b"".join(rests))
        border = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum([0, *[r.count(b" ") for r in rests]])].tolist()
        data = memoryview(ids.tobytes())
        for i, first, (a, b) in zip(even, firsts, itertools.pairwise(border), strict=True):
            out[i] = first.tobytes() + data[4 * a : 4 * b]
        return out


def encoding(path: str | None, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, start = Encoder.of(path), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for at in range(0, len(texts), 512):
                rows = slice(at, at + 512)
                ids = [e + end for e in encoder.encode(texts[rows])]
                sizes = np.array([len(e) // 4 for e in ids], np.int64)
                border = np.concatenate(([0], np.cumsum(sizes)))
                flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, 512),
                        batch.column("part").slice(at, 512),
                        pa.array(start + border[:-1]),
                        pa.array(sizes.astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(border.astype(np.int32)), pa.array(flat)),
                    ],
                    names=["doc_id", "part", "start", "n_tokens", "ids"],
                )
                start += int(border[-1])

    return run


def write_ids(
    docs: DataFrame,
    path: str,
    vocabulary: str | None = None,
    end_id: int = 2,
    parts: int | None = None,
    row_group_bytes: int = 16 << 20,
    page_bytes: int = 128 << 10,
) -> None:
    """Encode (doc_id, text) and write the files below ``path``, which must not exist.

    The texts are sorted before they are encoded, so the range sampler does not run the encoder, and a task that is
    run again writes the same rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    order = [F.asc_nulls_first("doc_id"), F.asc("text_hash")]
    dealt = rows.repartitionByRange(parts or shuffle_partitions(docs), *order).sortWithinPartitions(*order)
    placed = dealt.select("doc_id", F.spark_partition_id().alias("part"), "text")
    writer = placed.mapInArrow(encoding(vocabulary, end_id), FILE_SCHEMA).write
    for key, value in {
        "compression": "zstd",
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.block.size": row_group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.dictionary.page.size": 1 << 20,
        "parquet.enable.dictionary": "false",
        "parquet.enable.dictionary#ids.list.element": "true",
    }.items():
        writer = writer.option(key, str(value))
    writer.parquet(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).parquet(path)


def parts_of(spark: SparkSession, path: str) -> DataFrame:
    """part, before (ids of all parts before it), tokens, documents; from the metadata columns alone."""
    sizes = read_files(spark, path).groupBy("part").agg(
        F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents")
    )
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("part", F.coalesce(F.sum("tokens").over(upto), F.lit(0)).alias("before"), "tokens", "documents")


def with_places(files: DataFrame, parts: DataFrame) -> DataFrame:
    """``start`` counted over all files instead of within a part. There is one small row per part."""
    placed = files.join(F.broadcast(parts.select("part", "before")), "part")
    return placed.withColumn("start", F.col("before") + F.col("start")).drop("before", "part")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens of every document; the ids are not read."""
    files = read_files(spark, path).select("doc_id", "part", "start", "n_tokens")
    return with_places(files, parts_of(spark, path)).select("doc_id", "start", "n_tokens")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id, ids of the named documents; other pages are passed over by their indexes."""
    return read_files(spark, path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def read_span(spark: SparkSession, path: str, first: int, stop: int) -> DataFrame:
    """doc_id, place (of its first id here), ids: the ids [first, stop) of the whole sequence, as rows per document."""
    parts = parts_of(spark, path).where((F.col("before") < stop) & (F.col("before") + F.col("tokens") > first))
    touched = parts.orderBy("part").collect()  # parts that the span touches: a span is what one reader asks for
    wanted = F.lit(False)
    for row in touched:
        wanted = wanted | (
            (F.col("part") == row["part"])
            & (F.col("start") < stop - row["before"])
            & (F.col("start") + F.col("n_tokens") > first - row["before"])
        )
    rows = with_places(read_files(spark, path).where(wanted), parts)
    skip = F.greatest(F.lit(first) - F.col("start"), F.lit(0)).cast("int")
    length = (F.least(F.lit(stop), F.col("start") + F.col("n_tokens")) - F.col("start")).cast("int") - skip
    return rows.select("doc_id", (F.col("start") + skip).alias("place"), F.slice("ids", skip + 1, length).alias("ids"))


def checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        border = np.asarray(ids.offsets, np.int64)
        data = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False))).cast("B")
        sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(border[:-1].tolist(), border[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in ("doc_id", "part", "start")),
                pa.array(np.diff(border)),
                pa.array(sums, pa.int64()),
            ],
            names=["doc_id", "part", "start", "n_tokens", "ids_crc32"],
        )


def report(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    schema = "doc_id bigint, part int, start bigint, n_tokens bigint, ids_crc32 bigint"
    read = read_files(spark, path).select("doc_id", "part", "start", "ids").mapInArrow(checksums, schema)
    return with_places(read, parts_of(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")


def encode_and_report(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    path = work_folder(docs.sparkSession, "token-ids")
    write_ids(docs, path, vocabulary)
    return report(docs.sparkSession, path)
