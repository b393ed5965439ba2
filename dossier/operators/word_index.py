"""The counting scorer for a table of queries: by one scan of the texts, or by an index of word runs.

Scan. Texts and queries are dealt into blocks of bounded size that meet by an equi-join on block numbers. Each distinct
run of word characters of a block is searched for the queries' words once; a text's score adds up, word by word that it
holds, over the queries that ask for the word. A block returns its best k texts per query.

Index. A word of a query can only occur inside a run of word characters, so the corpus is indexed by its distinct
runs: a *vocabulary* of runs with the number of texts that hold them, and *postings* (run, text). Both are written once
and can serve any number of query tables.

Which runs hold a word? Runs are known by their pieces of one, two and three characters; a word joins the vocabulary on
its one most telling piece (a word of up to two characters on itself) and containment is checked on the pair.

Which texts must be scored? A word adds 1 + 0.25 * 8 = 3 to a score at most, and the 5 for the whole query takes all of
its words. Words are looked up from the rarest on; words of one or two characters, which most runs hold, come last. The
first lookups bring enough texts to know a floor: the score of the query's k-th best text so far. Once the ceilings of
the words not yet looked up sum to less than the floor, texts that hold none of the others are ruled out, and those
words are never looked up: they are the frequent ones, whose postings are most of the index. Every text that was not
ruled out is scored on its text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.text import casefold
from dossier.operators.blocks import ARROW, CELLS, PART, TaskTopK, dealt, kind_of, spread, top_k
from dossier.session import cut_lineage, work_folder

try:  # multi-pattern matching in C where the package is present
    import ahocorasick
except ImportError:
    ahocorasick = None

# Weights of the counting scorer.
EXACT_WEIGHT = 5.0
TOKEN_WEIGHT = 1.0
COUNT_WEIGHT = 0.25
COUNT_CAP = 8
CEILING = TOKEN_WEIGHT + COUNT_CAP * COUNT_WEIGHT

QUERY_WORD = re.compile(r"[\w\-]+", re.UNICODE)
#: ASCII characters that no word holds. Every other character counts as part of a run, so no word crosses a border.
BETWEEN_RUNS = r"[\x00-\x2C\x2E\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]+"
RUNS = re.compile(BETWEEN_RUNS)
#: Texts per wanted hit that the first lookups should bring.
EAGER = 16
#: Bytes of text of one block of a scan.
BLOCK_BYTES = 32 << 20
#: Words up to this length are pieces themselves.
SHORT = 2
#: Queries that meet a text in one row, about.
ASKED = 4096
#: Most rows of a side that is broadcast: words, runs and queries of some hundred bytes each.
FEW_ROWS = 100_000
#: Runs whose words a task remembers.
REMEMBERED = 200_000


def folded_text(docs: DataFrame) -> DataFrame:
    """chunk_id, hay: title and text as the scorer reads them."""
    hay = casefold(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))))
    return spread(docs.select("chunk_id", "title", "text"), "chunk_id").select("chunk_id", hay.alias("hay"))


@dataclass(frozen=True)
class WordIndex:
    """texts: chunk_id, hay; postings: run, chunk_id; vocabulary: run, texts."""

    texts: DataFrame
    postings: DataFrame
    vocabulary: DataFrame


def build_word_index(docs: DataFrame) -> WordIndex:
    """Index of docs (chunk_id, title, text), written below the checkpoint folder."""
    spark = docs.sparkSession
    folder = work_folder(spark, "word-index")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    texts = written(folded_text(docs), "texts")
    runs = texts.select(F.explode(F.array_distinct(F.split("hay", BETWEEN_RUNS))).alias("run"), "chunk_id").where("run <> ''")
    # Row groups cover ranges of runs, so a lookup passes over those that cannot hold its runs.
    postings = written(runs.repartition("run").sortWithinPartitions("run"), "postings")
    return WordIndex(texts, postings, written(postings.groupBy("run").agg(F.count("*").alias("texts")), "vocabulary"))


def query_words(queries: DataFrame) -> DataFrame:
    """query_id, phrase, word, times of every query with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for query_id, query in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = [w.casefold() for w in QUERY_WORD.findall(query or "")]
                rows += [(query_id, query.casefold(), w, words.count(w)) for w in dict.fromkeys(words)]
            if rows:
                kinds = (ARROW[kind], pa.string(), pa.string(), pa.int32())
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "phrase", "word", "times"])

    kind = kind_of(queries, "query_id")
    return queries.select("query_id", "query").mapInArrow(run, f"query_id {kind}, phrase string, word string, times int")


def spoken_queries(words: DataFrame) -> DataFrame:
    """query_id, phrase, words: all words of a query, repeats included, with spaces between."""
    every = F.flatten(F.collect_list(F.array_repeat("word", F.col("times"))))
    return words.groupBy("query_id", "phrase").agg(F.array_join(every, " ").alias("words"))


def pieces(text: Column, size: int) -> Column:
    """The distinct substrings of ``size`` characters."""
    every = F.transform(F.sequence(F.lit(1), F.char_length(text) - size + 1), lambda i: F.substring(text, i, size))
    return F.when(F.char_length(text) >= size, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def telling_pieces(words: DataFrame) -> DataFrame:
    """word, piece: the word itself, or the piece of three characters that the fewest other words share."""
    long = words.where(F.char_length("word") > SHORT).select("word", F.explode(pieces(F.col("word"), SHORT + 1)).alias("piece"))
    shared = long.groupBy("piece").agg(F.count("*").alias("words"))
    least = long.join(shared, "piece").groupBy("word").agg(F.min_by("piece", F.struct("words", "piece")).alias("piece"))
    return least.unionByName(words.where(F.char_length("word") <= SHORT).select("word", F.col("word").alias("piece")))


def if_small(df: DataFrame) -> DataFrame:
    """``df``, written, and broadcast where it has few rows; a larger one meets the other side by a shuffle."""
    df = cut_lineage(df)
    return F.broadcast(df) if df.count() <= FEW_ROWS else df


def runs_with_words(words: DataFrame, vocabulary: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """word, run, texts: the runs that hold each of the distinct ``words``, whose pieces have these ``sizes``."""
    parts = F.concat(*[pieces(F.col("run"), size) for size in sizes])
    found = vocabulary.select("run", "texts", F.explode(parts).alias("piece")).join(if_small(telling_pieces(words)), "piece")
    return found.where(F.contains("run", "word")).select("word", "run", "texts")


def texts_with_words(lookups: DataFrame, spoken: DataFrame, index: WordIndex) -> DataFrame:
    """Distinct (chunk_id, query_id) of the texts that hold a word of ``lookups`` (query_id, word)."""
    runs = spoken.select("word", "run").join(if_small(lookups), "word").select("run", "query_id").distinct()
    return index.postings.join(if_small(runs), "run").select("chunk_id", "query_id").distinct()


class WordCounter:
    """Substring counts of a set of words in many texts; each distinct run is looked at once."""

    def __init__(self, words: set[str]) -> None:
        self.words = sorted(words)
        self.place = {w: i for i, w in enumerate(self.words)}
        self.sizes = sorted({len(w) for w in self.words})
        self.known: dict[str, tuple[list[int], list[int]]] = {}
        self.automaton = None
        if ahocorasick is not None and self.words:
            self.automaton = ahocorasick.Automaton()
            for word, place in self.place.items():
                self.automaton.add_word(word, place)
            self.automaton.make_automaton()

    def inside(self, run: str) -> set[int]:
        """Places of the words that occur in a run."""
        if self.automaton is not None:
            return {place for _, place in self.automaton.iter(run)}
        parts = {run[i : i + size] for size in self.sizes for i in range(len(run) - size + 1)}
        return {self.place[w] for w in parts if w in self.place}

    def hits(self, hay: str) -> tuple[np.ndarray, np.ndarray]:
        """(places of the words that a text holds, what each adds to a score)."""
        places: list[int] = []
        counts: list[int] = []
        for run, times in Counter(RUNS.split(hay)).items():
            hit = self.known.get(run)
            if hit is None:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                inside = list(self.inside(run))
                hit = self.known[run] = inside, [run.count(self.words[place]) for place in inside]
            places += hit[0]
            counts += hit[1] if times == 1 else [c * times for c in hit[1]]
        total = np.bincount(np.array(places, np.int64), weights=counts, minlength=len(self.words))
        held = np.flatnonzero(total)
        return held, TOKEN_WEIGHT + np.minimum(total[held], COUNT_CAP) * COUNT_WEIGHT


class AskedWords:
    """The words of a block of queries, and which queries ask for each."""

    def __init__(self, phrases: list[str], words: list[list[str]]) -> None:
        self.phrases = phrases
        self.counter = WordCounter({w for own in words for w in own})
        pairs = sorted((self.counter.place[w], n, own.count(w)) for n, own in enumerate(words) for w in dict.fromkeys(own))
        place, self.query, self.times = (np.array(c, np.int64) for c in zip(*pairs))
        self.border = np.searchsorted(place, np.arange(len(self.counter.words) + 1))
        self.distinct = np.bincount(self.query, minlength=len(words))

    def scores(self, hay: str) -> np.ndarray:
        """Score of one text for every query."""
        held, gains = self.counter.hits(hay)
        size = self.border[held + 1] - self.border[held]
        at = np.repeat(self.border[held] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        asked = self.query[at]
        out = np.bincount(asked, weights=np.repeat(gains, size) * self.times[at], minlength=len(self.phrases))
        # Only a text with every word of a query can hold the query itself.
        for n in np.flatnonzero(np.bincount(asked, minlength=len(self.phrases)) == self.distinct):
            if self.phrases[n] in hay:
                out[n] += EXACT_WEIGHT
        return out


def count_search_batch(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, score, rank: the best k texts of every query by the counting scorer; ties by chunk_id.

    queries: query_id (one row each), query; docs: chunk_id, title, text.
    """
    query_kind, id_kind = kind_of(queries, "query_id"), kind_of(docs, "chunk_id")
    asked = cut_lineage(spoken_queries(query_words(queries)))
    size = docs.agg(F.sum(F.octet_length(F.concat_ws(" ", "title", "text")))).first()[0] or 0
    text_blocks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // BLOCK_BYTES))
    query_blocks = max(1, -(-asked.count() // ASKED))

    def block(key: str, into: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(into)).cast("int")

    def every(into: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(into - 1)))

    left = folded_text(docs).select("*", block("chunk_id", text_blocks).alias("b"), every(query_blocks).alias("q"))
    right = asked.select("*", every(text_blocks).alias("b"), block("query_id", query_blocks).alias("q"))

    def score(texts: pa.Table, asked: pa.Table) -> pa.Table:
        batches: list[pa.RecordBatch] = []
        if texts.num_rows and asked.num_rows:
            ids = np.asarray(texts.column("chunk_id").to_pylist())
            plan = AskedWords(asked.column("phrase").to_pylist(), [w.split(" ") for w in asked.column("words").to_pylist()])
            kept = TaskTopK(asked.column("query_id").to_pylist(), k)
            step = max(1, min(PART, CELLS // asked.num_rows))
            for start in range(0, len(ids), step):
                hays = texts.column("hay").slice(start, step).to_pylist()
                kept.add_matrix(np.stack([plan.scores(hay) for hay in hays]), ids[start : start + step], above=0.0)
            batches = list(kept.batches(query_kind, id_kind))
        schema = pa.schema([("query_id", ARROW[query_kind]), ("chunk_id", ARROW[id_kind]), ("score", pa.float64())])
        return pa.Table.from_batches(batches, schema)

    groups = dealt(left, "b", "q").groupBy("b", "q").cogroup(dealt(right, "b", "q").groupBy("b", "q"))
    scored = groups.applyInArrow(score, f"query_id {query_kind}, chunk_id {id_kind}, score double")
    return top_k(scored, "query_id", [F.desc("score"), F.col("chunk_id")], k)


class BestTexts:
    """The best k texts of every query that one task has scored."""

    def __init__(self, k: int) -> None:
        self.k, self.kept = k, {}

    def add(self, query_id, chunk_id, score: float) -> None:
        rows = self.kept.setdefault(query_id, [])
        rows.append((-score, chunk_id))
        if len(rows) > 4 * self.k + 64:
            rows.sort()
            del rows[self.k :]

    def rows(self) -> list[tuple]:
        return [(q, c, -s) for q, rows in self.kept.items() for s, c in sorted(rows)[: self.k]]


def score_texts(candidates: DataFrame, asked: DataFrame, index: WordIndex, k: int) -> DataFrame:
    """query_id, chunk_id, score of the candidate pairs that score above 0, the best k of each task.

    asked: query_id, phrase, words (with repeats, between spaces). The queries of a text meet it in one row, or in
    several where they are very many.
    """
    asked = if_small(asked)
    salts = -(-asked.count() // ASKED)
    query_kind, id_kind = kind_of(asked, "query_id"), kind_of(index.texts, "chunk_id")
    grouped = (
        candidates.join(asked, "query_id")
        .groupBy("chunk_id", F.pmod(F.xxhash64("query_id"), F.lit(max(1, salts))).alias("salt"))
        .agg(F.collect_list(F.struct("query_id", "phrase", "words")).alias("asked"))
    )
    pairs = dealt(index.texts, "chunk_id").join(dealt(grouped, "chunk_id"), "chunk_id").select(
        "chunk_id", "hay", "asked.query_id", "asked.phrase", "asked.words"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = BestTexts(k)
        for batch in batches:
            rows = [batch.column(c).to_pylist() for c in range(5)]
            spoken = {words: words.split(" ") for row in rows[4] for words in row}
            counter = WordCounter({word for words in spoken.values() for word in words})
            at = {words: np.array([counter.place[w] for w in split]) for words, split in spoken.items()}
            for chunk_id, hay, *queries in zip(*rows):
                gains = np.zeros(len(counter.words))
                held, gain = counter.hits(hay)
                gains[held] = gain
                for query_id, phrase, words in zip(*queries):
                    score = float(gains[at[words]].sum()) + (EXACT_WEIGHT if phrase in hay else 0.0)
                    if score > 0:
                        best.add(query_id, chunk_id, score)
        rows = best.rows()
        if rows:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (ARROW[query_kind], ARROW[id_kind], pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "chunk_id", "score"])

    return pairs.mapInArrow(run, f"query_id {query_kind}, chunk_id {id_kind}, score double")


def count_search_indexed(queries: DataFrame, index: WordIndex, k: int) -> DataFrame:
    """As :func:`count_search_batch`, from an index that is built once and serves many tables of queries."""
    order = [F.desc("score"), F.col("chunk_id")]
    words = cut_lineage(query_words(queries))
    asked = spoken_queries(words)
    distinct = words.select("word").distinct()
    long = F.char_length("word") > SHORT
    spoken = cut_lineage(runs_with_words(distinct.where(long), index.vocabulary, (SHORT + 1,)))
    texts = spoken.groupBy("word").agg(F.sum("texts").alias("texts"))
    # Long words that no run holds add nothing; short ones are not counted before they are needed.
    known = words.join(texts, "word", "left").where(F.col("texts").isNotNull() | ~long)
    rarest = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("texts"), F.desc(F.char_length("word")), "word")
    before = F.coalesce(F.sum("texts").over(rarest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A text that holds none of the words before this one scores ``onward`` at most.
    onward = F.sum(F.col("times") * CEILING).over(rarest.rowsBetween(0, Window.unboundedFollowing))
    early = F.col("texts").isNotNull() & (before < EAGER * k)
    plan = cut_lineage(known.select("query_id", "word", early.alias("early"), onward.alias("onward")))
    found = texts_with_words(plan.where("early").select("query_id", "word"), spoken, index)
    first = cut_lineage(score_texts(found, asked, index, k))
    floor = top_k(first, "query_id", order, k).groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("n"))
    floor = floor.where(F.col("n") == k).select("query_id", "floor")
    late = plan.join(floor, "query_id", "left").where(~F.col("early") & (F.col("onward") >= F.coalesce("floor", F.lit(0.0))))
    late = cut_lineage(late.select("query_id", "word"))
    short = late.where(~long).select("word").distinct()
    if not short.isEmpty():
        spoken = spoken.unionByName(runs_with_words(short, index.vocabulary, tuple(range(1, SHORT + 1))))
    second = score_texts(texts_with_words(late, spoken, index), asked, index, k)
    return top_k(first.unionByName(second).distinct(), "query_id", order, k)
