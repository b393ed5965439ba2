"""Benchmark decontamination: short items found inside long documents by size-partitioned MinHash containment.

Items are partitioned by their number u/2 < q <= u of distinct five-word shingles (u a power of two). For a partition
a document is read as overlapping windows of 2u shingles, one every u, so that any passage of up to u shingles lies
whole in a window, and item and window differ in size by a factor of four at most. Containment t then means a Jaccard
similarity of at least t / (5 - t), and the number of single-row MinHash bands is set so that a pair at that
similarity collides in one of them with probability ``recall``. A collision in band j means that window and item have
the same smallest value, so only windows that hold a shingle that is smallest in some item need a signature.
Each colliding pair is verified exactly: the share of the item's distinct shingles among those of the whole document.

Items go to the executors in blocks of at most ``block_shingles`` shingles; the documents are read once per block.

A text of one to four words has one shingle of all its words; null texts and texts without words have none: such
items match nothing and such documents hold nothing. Repeated rows match each for themselves, null ids are kept, rows
of one id with other texts are judged apart. Empty tables give empty results. Other columns are not read by
``find_items`` and pass unchanged through ``drop_contaminated``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.tables import id_number, id_text
from dossier.llm.words import count_words, encoded, mix, shingles, slabs, word_hashes

SHINGLE = 5
SIEVE_BITS = 22


def bands_for(threshold: float, recall: float) -> int:
    similarity = threshold / (5 - threshold)
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity))


class Partition:
    """Signatures of the items of one size partition."""

    def __init__(self, upper: int, items: list[tuple[int, np.ndarray]], seeds: np.ndarray) -> None:
        self.upper, self.seeds = upper, seeds
        self.items = np.array([i for i, _ in items])
        smallest, self.values, self.order = [], [], []
        for seed in seeds:
            at = [s[np.argmin(mix(s ^ seed))] for _, s in items]
            values = mix(np.array(at, np.uint64) ^ seed)
            order = np.argsort(values)
            smallest += at
            self.values.append(values[order])
            self.order.append(order)
        self.smallest = np.unique(np.array(smallest, np.uint64))
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[self.smallest & np.uint64((1 << SIEVE_BITS) - 1)] = True

    def candidates(self, runs: np.ndarray, border: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) pairs with a window of the text that collides with the item."""
        at = np.flatnonzero(self.sieve[(runs & np.uint64((1 << SIEVE_BITS) - 1)).astype(np.int64)])
        at = at[np.isin(runs[at], self.smallest)]
        text = np.searchsorted(border, at, "right") - 1
        window = (at - border[text]) // self.upper
        pairs = np.unique(
            np.concatenate((np.stack((text, window), 1), np.stack((text, np.maximum(window - 1, 0)), 1))), axis=0
        )
        found: set[tuple[int, int]] = set()
        for first in range(0, len(pairs), 512):
            text, window = pairs[first : first + 512].T
            start = border[text] + window * self.upper
            place = start[:, None] + np.arange(2 * self.upper)
            outside = place >= border[text + 1][:, None]
            rows = runs[np.minimum(place, len(runs) - 1)]
            for seed, values, order in zip(self.seeds, self.values, self.order, strict=True):
                hashed = mix(rows ^ seed)
                hashed[outside] = np.uint64(0xFFFFFFFFFFFFFFFF)
                low = hashed.min(axis=1)
                left, right = np.searchsorted(values, low), np.searchsorted(values, low, "right")
                for k in np.flatnonzero(right > left):
                    found.update((int(text[k]), int(self.items[i])) for i in order[left[k] : right[k]])
        return found


class Index:
    """The items of one block, by size partition."""

    def __init__(self, texts: list[str], threshold: float, recall: float) -> None:
        self.threshold = threshold
        bands = bands_for(threshold, recall)
        seeds = mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
        hashes, border = shingles(*word_hashes([encoded(t) for t in texts]), SHINGLE)
        self.sets = [np.unique(hashes[a:b]) for a, b in zip(border[:-1], border[1:], strict=True)]
        by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, s in enumerate(self.sets):
            if len(s):
                by_size.setdefault(1 << max(2, (len(s) - 1).bit_length()), []).append((i, s))
        self.partitions = [Partition(upper, items, seeds) for upper, items in sorted(by_size.items())]

    def search(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, shingles of the item, those of them in the text) of all verified pairs."""
        runs, border = shingles(*word_hashes(texts), SHINGLE)
        pairs = set().union(*(p.candidates(runs, border) for p in self.partitions)) if len(runs) else ()
        last, own = -1, None
        for text, item in sorted(pairs):
            if text != last:
                last, own = text, np.unique(runs[border[text] : border[text + 1]])
            wanted = self.sets[item]
            shared = int(np.isin(wanted, own, assume_unique=True).sum())
            if shared >= self.threshold * len(wanted) - 1e-9:
                yield text, item, len(wanted), shared


def blocks(items: DataFrame, block_shingles: int, threshold: float, recall: float) -> Iterator[tuple[list, Index]]:
    """The items in blocks of a bounded size, one after the other."""
    rows = items.select("item_id", "text", count_words(F.col("text")).alias("n")).filter("n > 0")
    total = rows.agg(F.sum("n")).first()[0] or 0
    n_blocks = math.ceil(total / block_shingles)
    for nth in range(n_blocks):
        own = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == nth).select("item_id", "text")
        held = own.collect()
        if held:
            yield [None if r["item_id"] is None else str(r["item_id"]) for r in held], Index([r["text"] for r in held], threshold, recall)


def pairs_found(ids: list, index: Index):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            doc_ids = batch["doc_id"]
            rows = []
            for first, slab in slabs(batch["text"]):
                rows += [(doc_ids.iloc[first + d], ids[i], n, k, k / n) for d, i, n, k in index.search(slab)]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "n_shingles", "n_shared", "containment"])

    return run


def clean_rows(index: Index):
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = np.ones(batch.num_rows, bool)
            for first, slab in slabs(batch.column("text").to_pylist()):
                for d, *_ in index.search(slab):
                    kept[first + d] = False
            yield batch.filter(pa.array(kept))

    return run


def find_items(
    docs: DataFrame, items: DataFrame, threshold: float = 0.8, recall: float = 0.9999, block_shingles: int = 1_000_000
) -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared, containment of all pairs of a document and an item inside it."""
    schema = "doc_id string, item_id string, n_shingles long, n_shared long, containment double"
    rows = docs.select(id_text(), "text")
    out = docs.sparkSession.createDataFrame([], schema)
    for ids, index in blocks(items, block_shingles, threshold, recall):
        out = out.unionByName(rows.mapInPandas(pairs_found(ids, index), schema))
    return out.withColumns({"doc_id": id_number(), "item_id": F.col("item_id").cast("long")})


def drop_contaminated(
    docs: DataFrame, items: DataFrame, threshold: float = 0.8, recall: float = 0.9999, block_shingles: int = 1_000_000
) -> DataFrame:
    """The documents (all columns) that hold no item."""
    for _, index in blocks(items, block_shingles, threshold, recall):
        docs = docs.mapInArrow(clean_rows(index), docs.schema)
    return docs


SQL = """
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
b AS (
  SELECT row_number() OVER () AS item_row, item_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM benchmark),
ds AS (
  SELECT DISTINCT row_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT row_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
bs AS (
  SELECT DISTINCT item_row, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT item_row, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT item_row, count(*) AS n_shingles FROM bs GROUP BY item_row),
shared AS (SELECT row_id, item_row, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY row_id, item_row)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment
FROM shared JOIN sizes USING (item_row) JOIN d USING (row_id) JOIN b USING (item_row)
WHERE 5 * n_shared >= 4 * n_shingles
"""
