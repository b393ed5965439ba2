"""Language identification with bit-sliced Bloom filters over n-grams.

Learning counts the byte n-grams of all training texts per language. An n-gram belongs to a language when its share
of the language's n-grams is at least ``floor`` and at least half of its largest share in any language; since shares
sum to one, a language has at most 1 / ``floor`` n-grams of each size, however large the corpus, and the filters have
a fixed size. Slot s of the filter holds one bit per language, so the three slots of an n-gram, combined by AND,
return the set of all languages containing it in one look-up.

A text is predicted from the bits of all its n-grams: the popcount of each language is corrected for the false
positives that its filter's fill predicts, and the largest corrected count decides (ties: the first in code-point
order). The score is its share of all corrected counts.

Texts are lower-cased and everything but letters becomes one space, so each text with a letter has an n-gram.
Null texts and texts without a letter are ``und`` with score 0, as is every text when nothing could be learned.
Rows with a null language or text teach nothing. A null id counts as the empty text when folds are dealt (held out)
and stays null in the result. Repeated rows are learned and predicted each. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.tables import id_number, id_text, stored
from dossier.llm.words import mix, slabs

SIZES = (3, 5)
SLOT_BITS = 22
BLOCK_BITS = 16
OTHER = re.compile(r"[\W\d_]+")
FLUSH = 1_000_000


def plain(text) -> str:
    """Letters in lower case with one space around every run; empty when there is no letter."""
    if not isinstance(text, str):
        return ""
    out = OTHER.sub(" ", text.lower())
    return f" {out.strip()} " if any(c.isalpha() for c in out) else ""


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(codes of the n-grams of all sizes, number of the text of each); the size is part of the code."""
    buffer = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64)
    lengths = np.array([len(t) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    codes, owners = [], []
    for size in SIZES:
        n = len(buffer) - size + 1
        if n <= 0:
            continue
        code = np.full(n, size, np.int64)
        for k in range(size):
            code = (code << 8) | buffer[k : k + n]
        inside = owner[:n] == owner[size - 1 :]
        codes.append(code[inside])
        owners.append(owner[:n][inside])
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(codes), np.concatenate(owners)


class Tally:
    """Counts of codes, merged as they come and handed on when there are many."""

    def __init__(self) -> None:
        self.codes, self.counts, self.held = [], [], 0

    def add(self, codes: np.ndarray) -> None:
        found = pc.value_counts(pa.array(codes))
        self.codes.append(found.field("values").to_numpy())
        self.counts.append(found.field("counts").to_numpy())
        self.held += len(found)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        codes, inverse = np.unique(np.concatenate(self.codes), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate(self.counts)).astype(np.int64)
        self.codes, self.counts, self.held = [codes], [counts], len(codes)
        return codes, counts


def gram_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    tallies: dict[str, Tally] = {}
    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            tally = tallies.setdefault(lang, Tally())
            for _, slab in slabs([plain(t) for t in texts]):
                tally.add(grams(slab)[0])
                if tally.held > FLUSH and len(tally.merged()[0]) > FLUSH // 2:
                    codes, counts = tally.merged()
                    yield pd.DataFrame({"lang": lang, "gram": codes, "n": counts})
                    tallies[lang] = tally = Tally()
    for lang, tally in tallies.items():
        if tally.codes:
            codes, counts = tally.merged()
            yield pd.DataFrame({"lang": lang, "gram": codes, "n": counts})


def slots(codes: np.ndarray) -> list[np.ndarray]:
    """Three slots of each code, from disjoint bits of its hash."""
    h = mix(codes.astype(np.uint64))
    return [((h >> np.uint64(SLOT_BITS * k)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64) for k in range(2)] + [
        (mix(h + np.uint64(1)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    ]


def gram_slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for slot in slots(batch["gram"].to_numpy()):
            yield pd.DataFrame({"word": batch["word"], "slot": slot, "bits": batch["bits"]})


def block(rows: pd.DataFrame) -> pd.DataFrame:
    """The filter words of one range of slots as bytes."""
    words = np.zeros(1 << BLOCK_BITS, np.uint64)
    words[rows["slot"].to_numpy() & ((1 << BLOCK_BITS) - 1)] = rows["bits"].to_numpy().astype(np.uint64)
    first = rows.iloc[0]
    return pd.DataFrame({"word": [first["word"]], "block": [first["block"]], "data": [words.tobytes()]})


class Filters:
    """The learned filters: one 64-bit word per slot for each 64 languages."""

    def __init__(self, langs: list[str], words: np.ndarray) -> None:
        self.langs = langs
        bits = [8, 16, 32, 64]
        width = next(b for b in bits if min(len(langs), 64) <= b)
        self.words = words.astype(f"uint{width}")
        fill = np.array([np.mean((words[i // 64] >> np.uint64(i % 64)) & np.uint64(1)) for i in range(len(langs))])
        self.false_rate = np.minimum(fill**3, 0.999)

    def shares(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of n-grams, corrected share per language) of every text."""
        codes, owner = grams(texts)
        at = slots(codes)
        total = np.bincount(owner, minlength=len(texts))
        out = np.zeros((len(texts), len(self.langs)))
        for w, words in enumerate(self.words):
            found = words[at[0]] & words[at[1]] & words[at[2]]
            for i in range(w * 64, min(len(self.langs), w * 64 + 64)):
                hit = (found >> found.dtype.type(i % 64)) & found.dtype.type(1)
                out[:, i] = np.bincount(owner, hit, minlength=len(texts))
        share = out / np.maximum(total, 1)[:, None]
        return total, np.maximum(share - self.false_rate, 0) / (1 - self.false_rate)


def learn(train: DataFrame, floor: float = 2e-6) -> tuple[list[str], np.ndarray]:
    """Filters from (lang, text). What comes to the driver is the names of the languages and the fixed-size filters."""
    counted = train.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counted = counted.mapInPandas(gram_counts, "lang string, gram long, n long")
    counted = stored(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-grams")
    sizes = F.when(F.col("gram") >= (SIZES[1] << 8 * SIZES[1]), 1).otherwise(0)
    totals = counted.groupBy("lang", sizes.alias("size")).agg(F.sum("n").alias("total")).collect()
    langs = sorted({r["lang"] for r in totals})
    if not langs:
        return [], np.zeros((0, 1), np.uint64)
    number = {lang: i for i, lang in enumerate(langs)}
    keys = F.create_map(*[x for r in totals for x in (F.lit(f"{r['lang']}\0{r['size']}"), F.lit(r["total"]))])
    numbers = F.create_map(*[x for lang, i in number.items() for x in (F.lit(lang), F.lit(i))])
    named = counted.select(
        "gram",
        F.element_at(numbers, F.col("lang")).alias("nth"),
        (F.col("n") / F.element_at(keys, F.concat_ws("\0", "lang", sizes.cast("string")))).alias("share"),
    ).filter(F.col("share") >= floor)
    # A language's rows of one n-gram: at most one per language, so the list is as long as the list of languages.
    sets = named.groupBy("gram").agg(F.collect_list(F.struct("share", "nth")).alias("of"), F.max("share").alias("top"))
    member = sets.select("gram", F.explode(F.filter("of", lambda x: x["share"] * 2 >= F.col("top"))).alias("x"))
    member = member.select(
        "gram",
        F.floor(F.col("x.nth") / 64).cast("int").alias("word"),
        F.expr("shiftleft(1L, x.nth % 64)").alias("bits"),
    )
    member = member.groupBy("gram", "word").agg(F.bit_or("bits").alias("bits"))
    cells = member.mapInPandas(gram_slots, "word int, slot long, bits long")
    cells = cells.groupBy("word", "slot").agg(F.bit_or("bits").alias("bits"))
    cells = cells.withColumn("block", F.shiftright("slot", BLOCK_BITS).cast("int"))
    blocks = cells.groupBy("word", "block").applyInPandas(block, "word int, block int, data binary").collect()
    words = np.zeros(((len(langs) + 63) // 64, 1 << SLOT_BITS), np.uint64)
    for r in blocks:
        at = r["block"] << BLOCK_BITS
        words[r["word"], at : at + (1 << BLOCK_BITS)] = np.frombuffer(r["data"], np.uint64)
    return langs, words


def predictor(spark: SparkSession, langs: list[str], words: np.ndarray):
    """Fixed size: 2^22 slots of 1 to 8 bytes for each 64 languages."""
    shared = spark.sparkContext.broadcast(Filters(langs, words) if langs else None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filters = shared.value
        for batch in batches:
            texts = [plain(t) for t in batch.pop("text")]
            names, scores = ["und"] * len(texts), np.zeros(len(texts))
            for first, slab in slabs(texts) if filters else ():
                total, share = filters.shares(slab)
                best = share.argmax(axis=1)
                sums = share.sum(axis=1)
                top = share[np.arange(len(slab)), best]
                scores[first : first + len(slab)] = np.where(sums > 0, top / np.where(sums > 0, sums, 1), 0.0)
                for i in np.flatnonzero(total):
                    names[first + i] = filters.langs[best[i]]
            yield batch.assign(lang_pred=names, score=scores)

    return run


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds == 0


def identify(docs: DataFrame, train: DataFrame, floor: float = 2e-6) -> DataFrame:
    """doc_id, lang_pred, score of ``docs`` (doc_id, text), by filters learned from ``train`` (lang, text)."""
    langs, words = learn(train, floor)
    told = docs.select(id_text(), "text").mapInPandas(
        predictor(docs.sparkSession, langs, words), "doc_id string, lang_pred string, score double"
    )
    return told.withColumn("doc_id", id_number())
