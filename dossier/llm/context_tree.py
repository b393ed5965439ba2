"""Language-model scores by context-tree weighting over bytes, next to a smoothed unigram base score.

A byte is eight binary decisions. Each decision has a context tree over the preceding bytes, down to ``depth``; a node
holds the decision's two training counts. Its Krichevsky-Trofimov block probability and the product of its children's
weighted probabilities, half each, give the node's weighted probability, from the leaves to the root. A text is coded
with the trained tree: the estimate at each node on the path is mixed with the one below by the posterior weights
of the tree, through all depths. Below the deepest context seen in training the mixing stops, so an unseen context
costs no more than its longest known suffix. The score is the sum of log10 probabilities of all bytes of the
lower-cased text and of its end (a zero byte); ``depth`` zero bytes stand before it.

The counts are those of distinct (depth + 1)-grams and words, pre-aggregated in the tasks, so no frequent gram or word
makes a hot key. All nodes below a two-byte context are weighted where that context's grams meet; the two levels above
have at most 256 * 255 nodes, whatever the corpus, and are weighted on the driver. Texts are dealt into chunks of
about ``chunk_bytes``; a chunk asks for its own distinct grams and words only and gets their values back. Both travel
as sorted lists, one for every even hash bucket, not as rows. Grams with one beginning share a bucket, so that their
differences are short, and an answer holds values only: the chunk that asked finds the same keys in the same order again.

Null texts are empty: one token (the end) and one byte to code. Repeated rows are counted and scored each. A null id
counts as the empty text when folds are dealt and stays null in the result. Without training documents all counts
are 0 and every bit costs one bit. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.tables import id_number, id_text, stored
from dossier.llm.words import slabs, word_hashes

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Lists of grams that leave a task together.
LISTS = 32
FLUSH = 1_000_000
#: Bits of a gram that its bucket does not depend on: its last two bytes.
ENDING = 16


def held_out(doc_id: str = "doc_id", folds: int = 10) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds == 0


def lowered(texts) -> Iterator[tuple[int, list[bytes]]]:
    for first, slab in slabs(texts):
        yield first, [t.translate(LOWER) for t in slab]


def grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(code of the (depth + 1)-gram that ends at every byte and at the end of each text, borders of the texts)."""
    pad = b"\0" * depth
    buffer = np.frombuffer(b"".join(x for t in texts for x in (pad, t, b"\0")), np.uint8).astype(np.int64)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    border = np.concatenate(([0], np.cumsum(lengths)))
    code = np.zeros(max(len(buffer) - depth, 0), np.int64)
    for k in range(depth + 1):
        code = (code << 8) | buffer[k : k + len(code)]
    real = np.ones(len(code), bool)
    for k in range(depth):
        real[border[1:-1] + np.arange(len(texts) - 1) * depth + k] = False
    return code[real], border


def packed(numbers: np.ndarray, kind: str = "<i8") -> bytes:
    """Planes of bytes: the upper ones of small numbers are zeros, which Spark's codecs shorten to nothing."""
    return np.ascontiguousarray(numbers.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T).tobytes()


def unpacked(planes: bytes, kind: str = "<i8") -> np.ndarray:
    rows = np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T
    return np.ascontiguousarray(rows).reshape(-1).view(kind)


def key_lists(keys: np.ndarray, buckets: int, ending: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its keys in their order); keys that differ in their last ``ending`` bits only share one."""
    mixed = (keys >> ending).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    bucket = ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    border = np.flatnonzero(np.diff(bucket[order])) + 1
    for places in np.split(order, border) if len(keys) else ():
        yield int(bucket[places[0]]), places


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different keys in ascending order, how often each occurs)."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate((np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1])))
    return keys[first], np.diff(first, append=len(keys))


class Places:
    """Finds the places of many keys in a list of different keys, by a table of slots with at most every second one taken."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        bits = max(1, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.table = np.full(1 << bits, -1, np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), self.slot(keys)
        while len(left):
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]
            lost = self.table[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The places of ``keys``, all of which are in the list."""
        slot = self.slot(keys)
        found = self.table[slot]
        left = np.flatnonzero(self.keys[found] != keys) if len(keys) else slot
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & self.mask
            found[left] = self.table[slot]
            missed = self.keys[found[left]] != keys[left]
            left, slot = left[missed], slot[missed]
        return found


class Tally:
    """Counts of 64-bit keys, merged when many are held; a weight of 0 only notes that the key occurs."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0
        self.limit = FLUSH

    def add(self, keys: np.ndarray, counted: bool) -> None:
        found, counts = distinct(keys)
        self.parts.append((found, counts if counted else np.zeros(len(counts), np.int64)))
        self.held += len(counts)
        if self.held > self.limit:
            self.parts = [self.merged()]
            self.held = len(self.parts[0][0])
            self.limit = max(FLUSH, 2 * self.held)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys = np.concatenate([k for k, _ in self.parts])
        order = np.argsort(keys)
        keys, n = keys[order], np.concatenate([n for _, n in self.parts])[order]
        if not len(keys):
            return keys, n
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[first], np.add.reduceat(n, first)


def by_fold(batch: pd.DataFrame) -> Iterator[tuple[bool, list[bytes]]]:
    for held, texts in batch.groupby("held_out")["text"]:
        for _, slab in lowered(texts):
            yield bool(held), slab


def gram_counts(depth: int, buckets: int):
    def lists(tally: Tally) -> pd.DataFrame:
        keys, n = tally.merged()
        rows = [(b, packed(np.diff(keys[at], prepend=0)), packed(n[at])) for b, at in key_lists(keys, buckets, ENDING)]
        return pd.DataFrame(rows, columns=["bucket", "keys", "counts"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally = Tally()
        for batch in batches:
            for held, slab in by_fold(batch):
                tally.add(grams(slab, depth)[0], not held)
                if tally.held > 3 * FLUSH and len(tally.parts) == 1:
                    yield lists(tally)
                    tally = Tally()
        yield lists(tally)

    return run


def summed(lists: pd.DataFrame) -> pd.DataFrame:
    """Counts of the grams of one bucket."""
    tally = Tally()
    tally.parts = [(np.cumsum(unpacked(k)), unpacked(n)) for k, n in zip(lists["keys"], lists["counts"], strict=True)]
    keys, n = tally.merged()
    return pd.DataFrame({"gram": keys, "n": n})


_small = np.concatenate(([0.0], np.cumsum(np.log(np.arange(256) + 0.5))))
_factorials = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, 257)))))


def _half_products(n: np.ndarray) -> np.ndarray:
    """log of (1/2)(3/2)...(n - 1/2)."""
    x = n + 0.5
    series = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < 256, _small[np.minimum(n, 256).astype(np.int64)], series - 0.5 * math.log(math.pi))


def _log_factorial(n: np.ndarray) -> np.ndarray:
    x = n + 1.0
    series = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < 256, _factorials[np.minimum(n, 256).astype(np.int64)], series)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _half_products(zeros) + _half_products(ones) - _log_factorial(zeros + ones)


def weighted(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log weighted probability of nodes with children, posterior weight of their own estimate)."""
    log_half = math.log(0.5)
    out = np.logaddexp(log_half + own, log_half + below)
    return out, np.exp(log_half + own - out)


def subtree(rows: pd.DataFrame, depth: int) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Bits of grams that share their last two context bytes, mixed from ``depth`` up to depth 2.

    (grams, their estimates or -1 where nothing was seen, (node, zeros, ones, log probability below) at depth 1).
    """
    gram, n = rows["gram"].to_numpy(), rows["n"].to_numpy().astype(np.float64)
    byte, context = gram & 255, gram >> 8
    size = len(gram)
    mixed = np.zeros((8, size))
    seen = np.zeros((8, size), bool)
    child_of: list = [None] * 8
    above = []
    for d in range(depth, 1, -1):
        order = np.argsort(((context & ((1 << 8 * d) - 1)) << 8) | byte, kind="stable")
        own_context, own_byte, own_n = (context[order] & ((1 << 8 * d) - 1)), byte[order], n[order]
        for k in range(8):
            node = (own_context << 8) | (own_byte >> (8 - k))
            first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
            bit = (own_byte >> (7 - k)) & 1
            ones = np.add.reduceat(own_n * bit, first)
            total = np.add.reduceat(own_n, first)
            number = np.empty(size, np.int64)
            number[order] = np.repeat(np.arange(len(first)), np.diff(np.concatenate((first, [size]))))
            own = log_kt(total - ones, ones)
            if d == depth:
                log_p, weight = own, np.ones(len(first))
            else:
                child_row, child_log = child_of[k]
                below = np.bincount(number[child_row], child_log, len(first))
                log_p, weight = weighted(own, below)
            child_of[k] = (order[first], log_p)
            count, one = total[number], ones[number]
            hit = np.where((byte >> (7 - k)) & 1, one, count - one)
            estimate = (hit + 0.5) / (count + 1.0)
            w = weight[number]
            mixed[k] = np.where(seen[k], w * estimate + (1 - w) * mixed[k], estimate)
            seen[k] = count > 0
            if d == 2:
                rep = order[first]
                u = (1 << k) | (byte[rep] >> (8 - k))
                above.append((((context[rep] & 255) << 8) | u, total - ones, ones, log_p))
    node, zeros, ones, log_p = (np.concatenate(x) for x in zip(*above, strict=True))
    nodes, inverse = np.unique(node, return_inverse=True)
    sums = [np.bincount(inverse, x, len(nodes)) for x in (zeros, ones, log_p)]
    return gram, np.where(seen, mixed, -1.0).T.astype(np.float32), (nodes, *sums)


def upper_nodes(depth: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("node", "zeros", "ones", "below"), subtree(rows, depth)[2], strict=True)))

    return run


class Top:
    """The two upper levels of the trees: at most 256 contexts of one byte, and the root."""

    def __init__(self, rows: list) -> None:
        self.zeros, self.ones, below = (np.zeros((257, 256)) for _ in range(3))
        for r in rows:
            context, u = r["node"] >> 8, r["node"] & 255
            self.zeros[context, u], self.ones[context, u], below[context, u] = r["zeros"], r["ones"], r["below"]
        log_p, weight = weighted(log_kt(self.zeros[:256], self.ones[:256]), below[:256])
        self.zeros[256], self.ones[256] = self.zeros[:256].sum(axis=0), self.ones[:256].sum(axis=0)
        root = weighted(log_kt(self.zeros[256], self.ones[256]), log_p.sum(axis=0))[1]
        self.weight = np.concatenate((weight, root[None]))

    def log10(self, gram: np.ndarray, estimates: np.ndarray) -> np.ndarray:
        byte, last = gram & 255, (gram >> 8) & 255
        out = np.zeros(len(gram))
        for k in range(8):
            u, bit = (1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1
            p, seen = estimates[:, k].astype(np.float64), estimates[:, k] >= 0
            for context in (last, np.full(len(gram), 256)):
                zeros, ones, w = self.zeros[context, u], self.ones[context, u], self.weight[context, u]
                own = (np.where(bit, ones, zeros) + 0.5) / (zeros + ones + 1)
                p = np.where(seen, w * own + (1 - w) * p, own)
                seen = zeros + ones > 0
            out += np.log10(p)
        return out


def finished(top: Top, depth: int, buckets: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        gram, estimates, _ = subtree(rows, depth)
        dealt = np.empty(len(gram), np.int64)
        for bucket, places in key_lists(gram, buckets, ENDING):
            dealt[places] = bucket
        return pd.DataFrame({"bucket": dealt, "key": gram, "value": top.log10(gram, estimates).astype(np.float32)})

    return run


def gram_values(rows: DataFrame, depth: int, buckets: int, subtree_rows: int = 200_000) -> DataFrame:
    """(bucket, key, value): log10 probability of the last byte of every gram of the corpus after its other bytes."""
    counted = rows.mapInPandas(gram_counts(depth, buckets), "bucket long, keys binary, counts binary")
    counted = stored(counted.groupBy("bucket").applyInPandas(summed, "gram long, n long"), "tree-grams")
    parts = max(1, math.ceil(counted.count() / subtree_rows))
    part = F.pmod(F.xxhash64(F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF))), F.lit(parts))
    shared = counted.groupBy(part.alias("part"))
    # The estimates of all grams would take far more disk than weighting them once more, when the upper levels are known.
    nodes = shared.applyInPandas(upper_nodes(depth), "node long, zeros double, ones double, below double")
    sums = [F.sum(c).alias(c) for c in ("zeros", "ones", "below")]
    top = Top(nodes.groupBy("node").agg(*sums).collect())
    return shared.applyInPandas(finished(top, depth, buckets), "bucket long, key long, value float")


def tallies(batches: Iterator[pd.DataFrame], depth: int) -> Iterator[tuple[int, Tally, Tally]]:
    """The grams and the words of every chunk, one chunk at a time: the rows come sorted by chunk."""
    now, codes, words = None, Tally(), Tally()
    for batch in batches:
        for chunk, part in batch.groupby("chunk"):
            if chunk != now:
                if now is not None:
                    yield now, codes, words
                now, codes, words = chunk, Tally(), Tally()
            for held, slab in by_fold(part):
                codes.add(grams(slab, depth)[0], False)
                words.add(word_hashes(slab)[0].view(np.int64), not held)
    if now is not None:
        yield now, codes, words


def asked(depth: int, buckets: int, word_buckets: int):
    """The distinct grams of every chunk and its distinct words with their training counts, a list for every bucket.

    The buckets of words come after those of grams.
    """

    def lists(chunk: int, codes: Tally, words: Tally) -> Iterator[tuple]:
        keys = codes.merged()[0]
        codes.parts = []
        for b, at in key_lists(keys, buckets, ENDING):
            yield chunk, b, packed(np.diff(keys[at], prepend=0)), None
        keys, n = words.merged()
        words.parts = []
        for b, at in key_lists(keys, word_buckets):
            yield chunk, buckets + b, packed(np.diff(keys[at], prepend=0)), packed(n[at])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk, codes, words in tallies(batches, depth):
            rows = lists(chunk, codes, words)
            while part := list(itertools.islice(rows, LISTS)):
                yield pd.DataFrame(part, columns=["chunk", "bucket", "keys", "counts"])

    return run


def word_totals(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[bytes], list[int]]:
    """For lists of words: the training counts over all lists, and how many training words each list is the first to hold."""
    known, first, place = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    total = np.zeros(len(known), np.int64)
    np.add.at(total, place, np.concatenate(counts))
    border = np.cumsum([0, *map(len, keys)])
    new = np.histogram(first[total > 0], border)[0]
    return [packed(total[place[a:b]]) for a, b in itertools.pairwise(border)], new.tolist()


def answered(asked: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
    """The lists of one bucket as values of their grams, or as training counts of their words."""
    keys = [np.cumsum(unpacked(k)) for k in asked["keys"]]
    n, new = 0, 0
    if len(asked) and asked["counts"].notna().all():
        counts = [unpacked(c) for c in asked["counts"]]
        n = [int(c.sum()) for c in counts]
        told, new = word_totals(keys, counts)
    else:
        values = values.sort_values("key")
        known, logs = values["key"].to_numpy(), values["value"].to_numpy()
        told = [packed(logs[np.searchsorted(known, k)], "<f4") for k in keys]
    return pd.DataFrame({"chunk": asked["chunk"], "bucket": asked["bucket"], "told": told, "n": n, "new": new})


def gathered(lists: dict[int, bytes], keys: np.ndarray, dealt: Iterator[tuple[int, np.ndarray]], kind: str) -> np.ndarray:
    """The answers of a chunk in the order of its keys."""
    out = np.empty(len(keys), kind)
    for bucket, places in dealt:
        out[places] = unpacked(lists[bucket], kind)
    return out


def scored(depth: int, buckets: int, word_buckets: int):
    """Score the texts of a chunk with the values of its words and grams. One more row sums up its first-seen words."""

    def run(answers: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((5, len(docs)))
        codes, words = Tally(), Tally()
        for _, slab in lowered(docs["text"]):
            codes.add(grams(slab, depth)[0], False)
            words.add(word_hashes(slab)[0].view(np.int64), False)
        lists = dict(zip(answers["bucket"], answers["told"], strict=True))
        keys = words.merged()[0]
        word_counts = gathered(lists, keys, ((buckets + b, at) for b, at in key_lists(keys, word_buckets)), "<i8")
        word_logs, words = np.log10(word_counts + 0.1), Places(keys)
        keys = codes.merged()[0]
        gram_logs, codes = gathered(lists, keys, key_lists(keys, buckets, ENDING), "<f4"), Places(keys)
        for first, slab in lowered(docs["text"]):
            to = slice(first, first + len(slab))
            hashes, border = word_hashes(slab)
            at = words.of(hashes.view(np.int64))
            out[0, to] = np.diff(border) + 1
            for row, what in ((1, word_counts[at] > 0), (2, word_logs[at])):
                sums = np.concatenate(([0.0], np.cumsum(what)))
                out[row, to] = sums[border[1:]] - sums[border[:-1]]
            keys, border = grams(slab, depth)
            out[3, to] = np.add.reduceat(gram_logs[codes.of(keys)].astype(np.float64), border[:-1])
            out[4, to] = np.diff(border)
        total = {"n_tokens": int(answers["n"].sum()), "n_known": int(answers["new"].sum())}
        rows = pd.DataFrame(
            {
                "row": True,
                "doc_id": docs["doc_id"],
                "held_out": docs["held_out"],
                "n_tokens": out[0].astype(np.int64),
                "n_known": out[1].astype(np.int64),
                "word_logs": out[2],
                "score": out[3],
                "n_bytes": out[4].astype(np.int64),
            }
        )
        extra = {"row": False, "doc_id": None, "held_out": False, "word_logs": 0.0, "score": 0.0, "n_bytes": 0} | total
        return pd.concat([rows, pd.DataFrame([extra])])

    return run


def score_texts(docs: DataFrame, held: Column, depth: int = 6, chunk_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes (with the end) and bits_per_byte.

    Learns where ``held`` is false.
    """
    if depth < 2 or depth > 6:
        raise ValueError("depth must be 2 to 6")
    rows = docs.select(id_text(), "text", held.alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    chunks = max(1, math.ceil(((size[0] or 0) + size[1]) / chunk_bytes))
    buckets = max(64, 3 * chunks)
    values = gram_values(rows.select("text", "held_out"), depth, buckets)
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))
    dealt = dealt.repartition(chunks, "chunk").sortWithinPartitions("chunk")
    word_buckets = max(1, buckets // 3)
    lists = dealt.mapInPandas(asked(depth, buckets, word_buckets), "chunk int, bucket long, keys binary, counts binary")
    lists = lists.groupBy("bucket").cogroup(values.groupBy("bucket"))
    found = lists.applyInPandas(answered, "chunk int, bucket long, told binary, n long, new long")
    schema = "row boolean, doc_id string, held_out boolean, n_tokens long, n_known long, word_logs double, score double, n_bytes long"
    told = found.groupBy("chunk").cogroup(dealt.groupBy("chunk")).applyInPandas(scored(depth, buckets, word_buckets), schema)
    told = stored(told, "tree-scores")
    is_row = F.col("row")
    n_words, n_distinct, n_texts = told.agg(
        F.coalesce(F.sum(F.when(~is_row, F.col("n_tokens"))), F.lit(0)),
        F.coalesce(F.sum(F.when(~is_row, F.col("n_known"))), F.lit(0)),
        F.coalesce(F.sum((is_row & ~F.col("held_out")).cast("long")), F.lit(0)),
    ).first()
    tokens, distinct = n_words + n_texts, n_distinct + (n_texts > 0)
    spread = math.log10(tokens + 0.1 * (distinct + 1))
    return told.filter(is_row).select(
        id_number(),
        "held_out",
        "n_tokens",
        (F.col("n_known") + int(n_texts > 0)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("word_logs") + math.log10(n_texts + 0.1) - F.col("n_tokens") * spread).alias("base_score"),
        "score",
        "n_bytes",
        (-F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )
