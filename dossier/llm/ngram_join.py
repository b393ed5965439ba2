"""Similarity join on five-word shingles with an LSH forest of MinHash signatures and exact verification.

Texts with one set of shingles form a class; everything after works on classes, with the number of their rows.

Forest. Each of ``trees`` trees holds the classes under labels of MinHash values, as a prefix trie: classes are
grouped by (tree, label prefix). Starting from ``max_depth`` values, the matched prefix is shortened until a pair at
the threshold shares a prefix in some tree with probability ``recall``. Trie nodes with more than ``node_limit``
classes are split into blocks, and every pair of blocks is one group of its own.

Inside a node, 64-byte sketches rule out pairs far below the threshold (a pair at the threshold passes but for a chance
of about 1e-6), and the node hands on a spanning forest of the pairs that pass: at most one edge per member, never
all pairs. Connected components of these edges are families; every pair that the forest has matched lies in one.

Verification is exact and covers all pairs of a family. A family's texts are gathered in blocks of bounded size; a
task counts the common shingles of all pairs of two blocks (frequent shingles by matrix products, rare ones by their
few pairs) and returns a number of links per class and a spanning forest of the links, never the pairs.

A link is a Jaccard similarity of ``threshold`` or more (4/5 exactly, by integers). Texts of one to four words have
one shingle, of all their words. Null texts and texts without words have none, no links, and a class of their own.
Repeated rows are documents of their own and copies of each other; a null id is a document without a name. Class ids
are the smallest id of the linked documents (of those with an id). An empty table gives an empty result. Only
``doc_id`` and ``text`` are read; ``one_per_class`` passes other columns on unchanged. Sets of shingles are told apart
by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.components import connected_components
from dossier.llm.suffix_dedup import whole_groups
from dossier.llm.tables import fresh, id_number, id_text, shuffle_partitions, stored
from dossier.llm.words import WORD, mix, shingles, slabs, word_hashes

SHINGLE = 5
SKETCH = 64
SKETCH_PASS = 36
DENSE = 32


def matched_depth(trees: int, threshold: float, recall: float, max_depth: int) -> int:
    """Shorten the matched prefix until a pair at the threshold is found with probability ``recall``."""
    for depth in range(max_depth, 0, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    raise ValueError("no prefix reaches the recall with so few trees")


def signatures(trees: int, depth: int):
    """Of every text with words: hash of its set of shingles, their number, one key per tree, and the sketch."""
    salt = mix(np.arange(1, 2 * max(trees * depth, SKETCH) + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    seeds, factors = salt[0::2], salt[1::2] | np.uint64(1)

    def of_slab(slab: list[bytes]) -> tuple[np.ndarray, ...]:
        runs, border = shingles(*word_hashes(slab), SHINGLE)
        text = np.flatnonzero(np.diff(border))
        start = border[:-1][text]
        sets, sizes = np.zeros(len(text), np.uint64), np.zeros(len(text), np.int64)
        for i, t in enumerate(text):
            own = np.unique(runs[border[t] : border[t + 1]])
            sets[i], sizes[i] = np.add.reduce(mix(own ^ np.uint64(0x51ED270B8D5D1A7F))), len(own)
        low = np.stack([np.minimum.reduceat((runs ^ s) * f, start) for s, f in zip(seeds, factors, strict=True)], axis=1)
        keys = np.zeros((len(text), trees), np.uint64)
        for k in range(depth):
            keys = mix(keys * np.uint64(31) + low[:, k * trees : (k + 1) * trees] + np.uint64(k + 1))
        keys = mix(keys + np.arange(trees, dtype=np.uint64))
        sketch = (mix(low[:, :SKETCH]) >> np.uint64(56)).astype(np.uint8)
        return text, mix(sets + sizes.astype(np.uint64)).view(np.int64), sizes, keys.view(np.int64), sketch

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            doc, text_hash = batch["doc"].to_numpy(), batch["text_hash"].to_numpy()
            ids = batch["doc_id"]
            for first, slab in slabs(batch["text"]):
                if not any(slab):
                    continue
                text, sets, sizes, keys, sketch = of_slab(slab)
                at = text + first
                yield pd.DataFrame(
                    {
                        "doc_id": ids.iloc[at].array,
                        "doc": doc[at],
                        "text_hash": text_hash[at],
                        "class": sets,
                        "n_shingles": sizes,
                        "keys": list(keys),
                        "sketch": [s.tobytes() for s in sketch],
                    }
                )

    return run


SIGNATURES = "doc_id string, doc long, text_hash long, class long, n_shingles long, keys array<long>, sketch binary"


def spanning(classes: np.ndarray, sketches: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of the pairs whose sketches pass."""
    left = np.arange(len(classes))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = (sketches[left] == sketches[at]).sum(axis=1) >= SKETCH_PASS
            for to in left[near]:
                yield int(classes[at]), int(classes[to])
            queue.extend(left[near])
            left = left[~near]


def node_edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Candidate edges of trie nodes; the rows of a node stand together."""
    for rows in whole_groups(batches, "node"):
        node, classes = rows["node"].to_numpy(), rows["class"].to_numpy()
        sketches = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(-1, SKETCH)
        border = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1], [True])))
        size = np.diff(border)
        two = border[:-1][size == 2]
        two = two[(sketches[two] == sketches[two + 1]).sum(axis=1) >= SKETCH_PASS]
        out = [np.stack((classes[two], classes[two + 1]), axis=1)]
        for a, n in zip(border[:-1][size > 2], size[size > 2], strict=True):
            found = list(spanning(classes[a : a + n], sketches[a : a + n]))
            if found:
                out.append(np.array(found, np.int64))
        yield pd.DataFrame(np.concatenate(out), columns=["a", "b"])


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Number of common shingles of all pairs of sets."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    start = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    df = np.diff(np.concatenate((start, [len(every)])))
    out = np.zeros(m * m, np.float32)
    for f in np.unique(df[(df > 1) & (df <= DENSE)]):
        members = owner[start[df == f][:, None] + np.arange(f)]
        a, b = np.triu_indices(f, 1)
        for at in range(0, len(members), 1 << 14):
            part = members[at : at + (1 << 14)]
            out += np.bincount((part[:, a] * m + part[:, b]).ravel(), minlength=m * m).astype(np.float32)
    out = out.reshape(m, m)
    out += out.T
    dense = np.flatnonzero(df > DENSE)
    for at in range(0, len(dense), 2048):
        part = dense[at : at + 2048]
        table = np.zeros((m, len(part)), np.float32)
        column = np.repeat(np.arange(len(part)), df[part])
        row = np.concatenate([owner[s : s + n] for s, n in zip(start[part], df[part], strict=True)])
        table[row, column] = 1
        out += table @ table.T
    return out


def forest(linked: np.ndarray) -> Iterator[tuple[int, int]]:
    left = np.arange(len(linked))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = linked[at, left]
            for to in left[near]:
                yield int(at), int(to)
            queue.extend(left[near])
            left = left[~near]


def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(class, links) and (class, other) rows of families or pairs of blocks; the rows of one stand together."""
    for rows in whole_groups(batches, "group"):
        counted, edges = [], []
        for _, own in rows.groupby("group", sort=False):
            classes, copies = own["class"].to_numpy(), own["copies"].to_numpy()
            sets = []
            for _, slab in slabs(own["text"]):
                runs, border = shingles(*word_hashes(slab), SHINGLE)
                sets += [np.unique(runs[a:b]) for a, b in zip(border[:-1], border[1:], strict=True)]
            size = np.array([len(s) for s in sets])
            linked = 9 * common_counts(sets) >= 4 * (size[:, None] + size[None, :])
            if own["two"].iloc[0]:  # pairs inside a block belong to the block's own group
                side = own["side"].to_numpy()
                linked &= side[:, None] != side[None, :]
            np.fill_diagonal(linked, False)
            links = linked @ copies
            counted.append(pd.DataFrame({"class": classes[links > 0], "links": links[links > 0]}))
            edges += [(classes[a], classes[b]) for a, b in forest(linked)]
        # Class hashes are 64 bits wide: never through a column that may turn into floating point.
        yield pd.concat(counted).assign(other=None).astype({"other": "Int64"})
        found = np.array(edges, np.int64).reshape(-1, 2)
        yield pd.DataFrame({"class": found[:, 0], "links": 0, "other": pd.array(found[:, 1], "Int64")})


def keyed(docs: DataFrame) -> DataFrame:
    own = F.col("doc_id").cast("long")
    return docs.select(
        own.alias("doc_id"), F.coalesce(own, F.lit(0)).alias("doc"), F.xxhash64("text").alias("text_hash"), "text"
    )


def together(rows: DataFrame, key: str) -> DataFrame:
    return rows.repartition(shuffle_partitions(rows), key).sortWithinPartitions(key)


def block_pairs(rows: DataFrame, blocks, by: str) -> DataFrame:
    """A row for each pair of blocks that the row's block is part of, with its side in the pair and whether there are two."""
    own = F.pmod(F.xxhash64(F.col(by), F.lit(7)), blocks)
    rows = rows.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return (
        rows.withColumn("i", F.least("own", "with"))
        .withColumn("j", F.greatest("own", "with"))
        .withColumn("side", F.col("own") > F.col("with"))
        .withColumn("two", F.col("own") != F.col("with"))
        .withColumn("group", F.xxhash64("group", "i", "j"))
        .drop("own", "with", "i", "j")
    )


def candidate_edges(classes: DataFrame, node_limit: int) -> DataFrame:
    """(a, b): spanning edges of all trie nodes."""
    nodes = classes.select("class", F.explode("keys").alias("node"))
    counted = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    large = stored(counted.filter(F.col("n") > node_limit), "forest-large")
    rows = classes.select("class", "sketch", F.explode("keys").alias("node"))
    small = rows.join(large, "node", "left_anti")
    split = rows.join(large, "node").withColumn("blocks", F.ceil(F.col("n") / node_limit).cast("long"))
    split = block_pairs(split.withColumnRenamed("node", "group"), F.col("blocks"), "class")
    split = split.select("class", "sketch", F.col("group").alias("node"))
    parts = [together(x, "node").mapInPandas(node_edges, "a long, b long") for x in (small, split)]
    return parts[0].union(parts[1])


def join_classes(
    docs: DataFrame,
    trees: int = 24,
    recall: float = 0.9999,
    max_depth: int = 8,
    node_limit: int = 4096,
    block_rows: int = 2000,
    block_shingles: int = 1_000_000,
) -> tuple[DataFrame, DataFrame]:
    """(rows with words: doc_id, doc, text_hash, class; classes: class, copies, links, component, class_id)."""
    depth = matched_depth(trees, 0.8, recall, max_depth)
    rows = keyed(docs)
    signed = rows.withColumn("doc_id", id_text()).mapInPandas(signatures(trees, depth), SIGNATURES)
    signed = stored(signed.withColumn("doc_id", id_number()), "forest-signatures")
    place = F.struct("doc", "text_hash")
    classes = signed.groupBy("class").agg(
        F.count(F.lit(1)).alias("copies"),
        F.min("doc_id").alias("least_id"),
        F.min_by(F.struct("doc", "text_hash", "n_shingles", "keys", "sketch"), place).alias("of"),
    )
    classes = stored(classes.select("class", "copies", "least_id", "of.*"), "forest-classes")
    families = connected_components(candidate_edges(classes, node_limit))
    members = stored(
        families.select(F.col("node").alias("class"), F.col("component").alias("family")).join(
            classes.select("class", "copies", "doc", "text_hash", "n_shingles"), "class"
        ),
        "forest-members",
    )
    sizes = members.groupBy("family").agg(
        F.greatest(
            F.ceil(F.count(F.lit(1)) / F.lit(block_rows)), F.ceil(F.sum("n_shingles") / F.lit(block_shingles))
        ).alias("blocks")
    )
    placed = members.join(sizes, "family").withColumnRenamed("family", "group")
    # Rows that are equal in id and text bring the same class twice.
    texts = rows.dropDuplicates(["doc", "text_hash"]).select("doc", "text_hash", "text")
    texts = placed.join(texts, ["doc", "text_hash"]).select("group", "blocks", "class", "copies", "text")
    gathered = together(block_pairs(texts, F.col("blocks"), "class").drop("blocks"), "group")
    told = stored(gathered.mapInPandas(verified, "class long, links long, other long"), "forest-links")
    links = told.filter("other is null").groupBy("class").agg(F.sum("links").alias("links"))
    linked = connected_components(told.filter("other is not null").select(F.col("class").alias("a"), F.col("other").alias("b")))
    known = (
        classes.select("class", "copies", "least_id", "doc", "text_hash")
        .join(links, "class", "left")
        .join(linked.withColumnRenamed("node", "class"), "class", "left")
        .withColumn("component", F.coalesce("component", "class"))
    )
    known = stored(known, "forest-known")
    names = known.groupBy("component").agg(F.min("least_id").alias("class_id"))
    return signed.select("doc_id", "doc", "text_hash", "class"), known.join(names, "component")


def similar_documents(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id, copies (rows with the same set of shingles) and n_links (other rows linked) of every row."""
    signed, classes = join_classes(docs, **options)
    classes = classes.select(
        "class", "class_id", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    found = signed.join(classes, "class").select("doc_id", "class_id", "copies", "n_links")
    one = F.lit(1).cast("long")
    alone = keyed(docs).filter(~F.coalesce(F.regexp_like("text", F.lit(WORD)), F.lit(False)))
    return found.unionByName(
        alone.select("doc_id", F.col("doc_id").alias("class_id"), one.alias("copies"), (one - 1).alias("n_links"))
    )


def one_per_class(docs: DataFrame, **options) -> DataFrame:
    """All columns of one row of each class of linked documents: that with the smallest id (and text hash)."""
    _, classes = join_classes(docs, **options)
    kept = classes.groupBy("component").agg(F.min(F.struct("doc", "text_hash")).alias("k"))
    doc, text_hash = fresh(docs, "_doc"), fresh(docs, "_hash")
    kept = kept.select(F.col("k.doc").alias(doc), F.col("k.text_hash").alias(text_hash))
    wordy = F.coalesce(F.regexp_like("text", F.lit(WORD)), F.lit(False))
    own = docs.filter(wordy).withColumns(
        {doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), text_hash: F.xxhash64("text")}
    )
    own = own.join(kept, [doc, text_hash], "left_semi").dropDuplicates([doc, text_hash]).drop(doc, text_hash)
    return own.unionByName(docs.filter(~wordy))
