"""Ranked lexical search over bit-sliced Bloom signatures, with exact rescoring of all that is not excluded.

Index. Documents are gathered into blocks of at most 1024 documents of similar size. A document's signature holds its
terms three times over: all terms, those found twice or more, those found four times or more. The signatures of a
block are kept as slices: slice b is a bitmap of the documents that have bit b set. A row of the index holds the
slices, the documents' ids, lengths and largest term count, and their normalised texts. The same pass counts in how
many documents each term stands; those counts are merged by a sum.

Search. The slices of a term are intersected, which gives a bitmap of the documents that may hold it (a Bloom filter
never misses one), at each of the three levels. Per item, the weighted sum of the bitmaps of a level, times what a
term of that level can add to the document's score at most, is an upper bound of the score. A task keeps the best
documents of every item that it has scored exactly so far. In each block it first scores the documents of highest
bound, then every other document whose bound reaches the score of the item's last kept document; a document below it
is proven to lie outside the result. Only texts that are rescored are read word by word. The best few of the tasks
meet per item.

Items are taken in groups of about ``group_terms`` terms: the weights of one group are sent to the tasks, the blocks
are read once per group, and the group's result is written before the next begins. Nothing else passes the driver.

Terms, weights and scores follow the integer arithmetic of the contract. Terms are told apart by 64-bit hashes: with
10^8 different terms in the corpus, the chance that one of 10^4 query terms shares its hash is about 5e-8.

Null texts and texts without a term are not indexed; items without a known term have no rows. Null ids of documents
are ranked last among equal scores. Repeated rows of documents are ranked each; rows of one item id with one text are
one item, with different texts they are items of their own. Empty tables give empty results; other columns are not
read. ``doc_id`` and ``item_id`` are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.tables import stored
from dossier.llm.words import SLAB_BYTES, encoded, mix, word_hashes

BLOCK_DOCS = 1024
BLOCK_BYTES = 4 << 20
HASHES = 3
#: A signature has 8 to 16 bits for each entry of the largest document of its block.
BITS_PER_ENTRY = 8
LEAST_BITS = 256
#: Least term counts of the levels.
LEVELS = (1, 2, 4)
#: Different terms whose document counts a task gathers before it hands them on.
TALLY = 1 << 20

_fold = bytearray(range(256))
for _i in range(128):
    _c = chr(_i)
    _fold[_i] = ord(_c.lower()) if _c.isalnum() else 32
FOLD = bytes(_fold)


def normalised(text) -> bytes:
    """UTF-8 with A-Z lower-cased and a space for every byte that is part of no term."""
    return encoded(text).translate(FOLD)


def slabs(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs [first, stop) of texts of about SLAB_BYTES."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > SLAB_BYTES:
            yield first, i
            first, size = i, 0
        size += len(text) + 1
    if first < len(texts):
        yield first, len(texts)


def term_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms' hashes, their counts, border positions per text, words per text) of one slab; terms ascend in a text."""
    hashes, border = word_hashes(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(border))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(fresh)
    counts = np.diff(np.append(at, len(hashes)))
    return hashes[at], counts, np.searchsorted(owner[at], np.arange(len(texts) + 1)), np.diff(border)


def bit_places(terms: np.ndarray, level: int, bits: int) -> np.ndarray:
    """[term, hash number] bit positions in a signature of ``bits`` bits, a power of two."""
    seed = mix(terms + np.uint64((0x5851F42D4C957F2D * (level + 1)) % (1 << 64)))
    step = (seed >> np.uint64(32)) | np.uint64(1)
    place = seed[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]
    return (place & np.uint64(bits - 1)).astype(np.int64)


def bit_slices(terms, counts, border, bits: int) -> np.ndarray:
    """[bit, byte of documents] of one block."""
    docs = len(border) - 1
    owner = np.repeat(np.arange(docs), np.diff(border))
    out = np.zeros((bits, -(-docs // 8)), np.uint8)
    for level, least in enumerate(LEVELS):
        have = counts >= least
        places, row = bit_places(terms[have], level, bits), owner[have]
        for j in range(HASHES):
            np.bitwise_or.at(out, (places[:, j], row >> 3), (1 << (row & 7)).astype(np.uint8))
    return out


class Tally:
    """In how many documents each term stands, gathered over a task."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, terms: np.ndarray) -> None:
        self.held.append(np.unique(terms, return_counts=True))
        self.size += len(self.held[-1][0])

    def merge(self) -> None:
        if len(self.held) > 1:
            terms, counts = (np.concatenate(x) for x in zip(*self.held, strict=True))
            terms, inverse = np.unique(terms, return_inverse=True)
            self.held = [(terms, np.bincount(inverse, weights=counts).astype(np.int64))]
        self.size = sum(len(t) for t, _ in self.held)

    def drain(self, at_least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.size >= at_least:
            self.merge()
        if self.size and self.size >= at_least:
            yield from self.held
            self.held, self.size = [], 0


INDEX = (
    "bits int, slices binary, docs array<bigint>, words array<bigint>, most array<int>, texts array<binary>, "
    "terms array<bigint>, counts array<bigint>"
)


def index_row(**columns) -> pa.RecordBatch:
    kinds = {
        "bits": pa.int32(),
        "slices": pa.binary(),
        "docs": pa.list_(pa.int64()),
        "words": pa.list_(pa.int64()),
        "most": pa.list_(pa.int32()),
        "texts": pa.list_(pa.binary()),
        "terms": pa.list_(pa.int64()),
        "counts": pa.list_(pa.int64()),
    }
    return pa.RecordBatch.from_arrays([pa.array([columns.get(c)], kind) for c, kind in kinds.items()], names=list(kinds))


def indexing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally = Tally()
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        texts = [normalised(t) for t in batch.column("text").to_pylist()]
        parts = [(first, term_counts(texts[first:stop])) for first, stop in slabs(texts)]
        # (bits of the signature, document, its slab, its place there), so that blocks hold documents of one size
        placed = []
        for s, (first, (terms, counts, border, sizes)) in enumerate(parts):
            tally.add(terms)
            passed = np.concatenate([np.concatenate(([0], np.cumsum(counts >= k)))[border] for k in LEVELS])
            entries = np.diff(passed.reshape(len(LEVELS), -1), axis=1).sum(axis=0)
            need = np.maximum(entries * BITS_PER_ENTRY, LEAST_BITS)
            bits = 1 << np.ceil(np.log2(need)).astype(np.int64)
            placed += [(int(bits[i]), first + i, s, i) for i in np.flatnonzero(sizes)]
        placed.sort()
        at = 0
        while at < len(placed):
            stop, size = at, 0
            while stop < len(placed) and placed[stop][0] == placed[at][0] and stop - at < BLOCK_DOCS and size < BLOCK_BYTES:
                size += len(texts[placed[stop][1]])
                stop += 1
            block = placed[at:stop]
            spans = [(parts[s][1], i) for _, _, s, i in block]
            terms = np.concatenate([p[0][p[2][i] : p[2][i + 1]] for p, i in spans])
            counts = np.concatenate([p[1][p[2][i] : p[2][i + 1]] for p, i in spans])
            border = np.concatenate(([0], np.cumsum([p[2][i + 1] - p[2][i] for p, i in spans])))
            yield index_row(
                bits=block[0][0],
                slices=bit_slices(terms, counts, border, block[0][0]).tobytes(),
                docs=[ids[d] for _, d, _, _ in block],
                words=[int(p[3][i]) for p, i in spans],
                most=np.maximum.reduceat(counts, border[:-1]),
                texts=[texts[d] for _, d, _, _ in block],
            )
            at = stop
        for terms, counts in tally.drain(TALLY):
            yield index_row(terms=terms.view(np.int64), counts=counts)
    for terms, counts in tally.drain(1):
        yield index_row(terms=terms.view(np.int64), counts=counts)


def build_index(docs: DataFrame) -> DataFrame:
    """Blocks of documents, and rows of (terms, counts) with document counts; see INDEX for the columns."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    return stored(rows.mapInArrow(indexing, INDEX), "signatures")


def item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [normalised(t) for t in batch.column("text").to_pylist()]
        for first, stop in slabs(texts):
            terms, counts, border, _ = term_counts(texts[first:stop])
            owner = pa.array(first + np.repeat(np.arange(stop - first), np.diff(border)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("item").take(owner), batch.column("item_id").take(owner), pa.array(terms.view(np.int64)), pa.array(counts)],
                names=["item", "item_id", "term", "times"],
            )


def weighted_items(items: DataFrame, index: DataFrame, documents: int) -> DataFrame:
    """item (text key), item_id, terms, weights (times the item's own count), of terms that the corpus holds."""
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull())
    key = F.concat_ws(":", F.coalesce(F.col("item_id").cast("string"), F.lit("-")), F.sha2("text", 256))
    named = asked.select(key.alias("item"), "item_id", "text").dropDuplicates(["item"])
    terms = stored(named.mapInArrow(item_terms, "item string, item_id bigint, term bigint, times bigint"), "item-terms")
    tallies = index.where(F.col("terms").isNotNull()).select(F.explode(F.arrays_zip("terms", "counts")).alias("t"))
    tallies = tallies.select(F.col("t.terms").alias("term"), F.col("t.counts").alias("count"))
    known = tallies.join(terms.select("term").distinct(), "term", "left_semi")
    known = known.groupBy("term").agg(F.sum("count").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * F.lit(documents) + 2) / (2.0 * F.col("df") + 1))).cast("long")
    return (
        terms.join(known, "term")
        .groupBy("item", "item_id")
        .agg(F.array_sort(F.collect_list(F.struct("term", (weight * F.col("times")).alias("weight")))).alias("terms"))
    )


class Group:
    """The items of one group, their terms, and where the terms' bits are."""

    def __init__(self, rows: list[tuple[str, list[tuple[int, int]]]], documents: int, words: int, k: int) -> None:
        self.items = [item for item, _ in rows]
        terms = np.unique(np.array([t for _, pairs in rows for t, _ in pairs], np.int64).view(np.uint64))
        self.terms, self.documents, self.words, self.k = terms, documents, words, k
        self.at = [np.searchsorted(terms, np.array([t for t, _ in pairs], np.int64).view(np.uint64)) for _, pairs in rows]
        self.weights = [np.array([w for _, w in pairs], np.int64) for _, pairs in rows]
        self.places: dict[tuple[int, int], np.ndarray] = {}
        self.kept: list[list[tuple]] = [[] for _ in rows]
        self.floor = np.ones(len(rows), np.int64)

    def gain(self, counts: np.ndarray, m: np.ndarray) -> np.ndarray:
        return (1_000_000_000 * counts) // (1000 * counts + 8 * m)

    def bitmaps(self, level: int, bits: int, slices: np.ndarray) -> np.ndarray:
        """[term, byte of documents] of the documents that may hold a term at a level."""
        if (level, bits) not in self.places:
            self.places[level, bits] = bit_places(self.terms, level, bits)
        return np.bitwise_and.reduce(slices[self.places[level, bits]], axis=1)

    def bounds(self, bits: int, slices: np.ndarray, m: np.ndarray, most: np.ndarray) -> np.ndarray:
        """[item, document] upper bounds of the scores."""
        ceilings = [np.minimum(most, after - 1) for after in LEVELS[1:]] + [most]
        steps = np.diff([self.gain(c.astype(np.int64), m) for c in ceilings], axis=0, prepend=0)
        out = np.zeros((len(self.items), len(m)), np.int64)
        within = None
        for level in range(len(LEVELS)):
            maps = self.bitmaps(level, bits, slices)
            within = maps if within is None else within & maps
            for n, (at, weights) in enumerate(zip(self.at, self.weights, strict=True)):
                hit = np.unpackbits(within[at], axis=1, bitorder="little")[:, : len(m)]
                # Sums of whole numbers below 2^53 are exact in doubles.
                out[n] += (weights.astype(np.float64) @ hit).astype(np.int64) * steps[level]
        return out

    def block(self, bits: int, slices: bytes, docs, words, most, texts) -> None:
        m = 25 + (75 * words * self.documents) // self.words
        sliced = np.frombuffer(slices, np.uint8).reshape(bits, -1)
        bounds = self.bounds(bits, sliced, m, most)
        gains = np.zeros((len(m), len(self.terms)), np.int32)
        read = np.zeros(len(m), bool)

        def score(n: int, wanted: np.ndarray) -> None:
            fresh = wanted[~read[wanted]]
            if len(fresh):
                self.read([texts[d].as_py() for d in fresh], fresh, m, gains)
                read[fresh] = True
            scores = gains[np.ix_(wanted, self.at[n])].astype(np.int64) @ self.weights[n]
            rows = self.kept[n] + [(-s, docs[d] is None, docs[d]) for s, d in zip(scores.tolist(), wanted) if s > 0]
            self.kept[n] = sorted(rows, key=lambda r: r[:2] + (r[2] or 0,))[: self.k]
            if len(self.kept[n]) == self.k:
                self.floor[n] = -self.kept[n][-1][0]

        for n in range(len(self.items)):
            possible = np.flatnonzero(bounds[n] >= self.floor[n])
            if len(possible) > self.k:
                high = possible[np.argpartition(-bounds[n, possible], self.k)[: self.k]]
                score(n, high)
                possible = np.setdiff1d(possible[bounds[n, possible] >= self.floor[n]], high)
            if len(possible):
                score(n, possible)

    def read(self, texts: list[bytes], rows: np.ndarray, m: np.ndarray, gains: np.ndarray) -> None:
        """Fill in what each of the group's terms adds to the score of some documents."""
        for first, stop in slabs(texts):
            terms, counts, border, _ = term_counts(texts[first:stop])
            owner = np.repeat(rows[first:stop], np.diff(border))
            at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
            hit = self.terms[at] == terms
            gains[owner[hit], at[hit]] = self.gain(counts[hit].astype(np.int64), m[owner[hit]])


FOUND = "item string, doc_id bigint, score bigint"


def searching(shared, documents: int, words: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = Group(shared.value, documents, words, k)
        for batch in batches:
            for i in range(batch.num_rows):
                row = [batch.column(c)[i] for c in ("bits", "slices", "docs", "words", "most", "texts")]
                lengths, most = (np.asarray(row[c].values, np.int64) for c in (3, 4))
                group.block(row[0].as_py(), row[1].as_buffer(), row[2].as_py(), lengths, most, row[5].values)
        found = [(item, doc, -s) for item, kept in zip(group.items, group.kept, strict=True) for s, _, doc in kept]
        if found:
            columns = zip(zip(*found, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in columns], names=["item", "doc_id", "score"])

    return run


def search(index: DataFrame, items: DataFrame, k: int = 10, group_terms: int = 16_384) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item (item_id, text) with a score above 0."""
    spark = index.sparkSession
    blocks = index.where(F.col("docs").isNotNull())
    documents, words = blocks.agg(
        F.coalesce(F.sum(F.size("docs")), F.lit(0)).cast("long"),
        F.coalesce(F.sum(F.aggregate("words", F.lit(0).cast("long"), lambda a, b: a + b)), F.lit(0)).cast("long"),
    ).first()
    asked = stored(weighted_items(items, index, documents), "weighted-items")
    size = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    groups = max(1, -(-size // group_terms))
    found = None
    for number in range(groups):
        part = asked.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == number).select("item", "terms").collect()
        rows = [(r["item"], [(t["term"], t["weight"]) for t in r["terms"]]) for r in part]
        shared = spark.sparkContext.broadcast(rows)
        columns = blocks.select("bits", "slices", "docs", "words", "most", "texts")
        best = columns.mapInArrow(searching(shared, documents, words, k), FOUND)
        if groups > 1:
            best = stored(best, "group-results")
            shared.destroy()
        found = best if found is None else found.unionByName(best)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


SQL = r"""
WITH lowered AS (
  SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
terms AS (
  SELECT doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS l FROM lowered
  WHERE text IS NOT NULL),
sizes AS (SELECT doc_id, len(l) AS n FROM terms WHERE len(l) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM sizes),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(l) AS term FROM terms) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
weights AS (
  SELECT item_id, term, count(*) * CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
  FROM asked JOIN df USING (term), total GROUP BY item_id, term, docs, df),
scores AS (
  SELECT item_id, doc_id,
    CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words)))) AS BIGINT) AS score
  FROM weights JOIN tf USING (term) JOIN sizes USING (doc_id), total GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
  doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""
