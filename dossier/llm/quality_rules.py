"""Quality rules as weak supervision, in column expressions only.

Every rule votes good (1), bad (-1) or abstains (0). The votes of a document are one of at most 3^m patterns for m
rules; the patterns are counted once over all documents, and expectation-maximisation runs over that table: the
posterior probability of *good* per pattern, then the rate at which each rule votes good on good documents and bad on
bad ones (abstentions tell nothing), and the share of good documents. A rule may see one kind of bad document only, so
its rate on bad ones may be low; but its bad vote counts as at least twice as likely on a bad document as on a good
one, so a vote never turns into its opposite. A document is kept when its posterior reaches ``keep_at`` and the base
test passes.

Null texts count as empty: no words, base test failed. Repeated rows and null ids are judged each like any other row.
An empty table gives an empty result. Other columns are not read. One document's words are handled as one array in
its task; nothing but the pattern table is shuffled, and brought to the driver: its size is bounded by the rules, not
by the documents.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.tables import fresh, let, stored
from dossier.llm.words import WORD, words

WINDOW = 8
GOOD_RATES = (0.6, 0.999)
BAD_RATES = (0.05, 0.99)
ROUNDS = 20


def repeated_words(word_list: Column) -> Column:
    """Words inside ``WINDOW``-word windows that occur twice or more in the list."""

    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeats(rows: Column) -> Column:
            def twice(row: Column, j: Column) -> Column:
                same_before = F.coalesce(F.get(rows, j - 1)["h"] == row["h"], F.lit(False))
                same_after = F.coalesce(F.get(rows, j + 1)["h"] == row["h"], F.lit(False))
                return same_before | same_after

            return F.array_sort(F.transform(F.filter(rows, twice), lambda row: row["i"]))

        def length(starts: Column) -> Column:
            steps = F.transform(
                starts, lambda at, j: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, j + 1) - at, F.lit(WINDOW)))
            )
            return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

        heavy = let(placed, lambda rows: let(repeats(rows), length))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(heavy)

    def windows(h: Column) -> Column:
        hashed = F.transform(
            F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])
        )
        return F.when(F.size(h) <= WINDOW, F.lit(0)).otherwise(let(hashed, covered))

    return let(F.transform(word_list, lambda w: F.xxhash64(w)), windows)


def measures(text: Column) -> dict[str, Column]:
    """What the rules read of a text. The two structs are spread by :func:`spread_measures`."""
    text = F.coalesce(text, F.lit(""))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        )

    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)).cast("long")

    return {
        "w": let(words(text), of_words),
        "l": let(F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(WORD))), of_lines),
        "n_symbols": count(r"[#*$%&|<>]"),
        "n_upper": count(r"\p{Lu}"),
        "n_marks": count(r"[^\p{L}\x20\x09-\x0D]"),
        "n_mark_runs": count(r"[#*$%&<>!]{2,}|\|"),
    }


SPREAD = ["w.*", "l.*", "n_symbols", "n_upper", "n_marks", "n_mark_runs"]


def votes(bad: Column, good: Column) -> Column:
    """-1 where ``bad`` holds, else 1 where ``good`` holds, else 0 (also where neither can be told)."""
    return F.when(bad, -1).when(good, 1).otherwise(0)


def default_rules() -> dict[str, Column]:
    n, c = F.col("n_words"), F.col
    return {
        "length": votes(n < 20, n >= 40),
        "word_length": votes((c("word_chars") < 2 * n) | (c("word_chars") > 12 * n), c("word_chars") <= 9 * n),
        "symbols": votes(10 * c("n_symbols") > n, 50 * c("n_symbols") <= n),
        "line_copies": votes(10 * c("n_dup_lines") > 3 * c("n_lines"), 10 * c("n_dup_lines") <= c("n_lines")),
        "repeats": votes(100 * c("n_repeat_words") > 30 * n, 100 * c("n_repeat_words") <= 5 * n),
        "capitals": votes(10 * c("n_upper") > 3 * c("word_chars"), 10 * c("n_upper") <= c("word_chars")),
        "marks": votes(100 * c("n_marks") > 15 * c("word_chars"), 100 * c("n_marks") <= 8 * c("word_chars")),
        "mark_runs": votes(10 * c("n_mark_runs") > n, 100 * c("n_mark_runs") <= n),
    }


def odds_steps(prior: float, good: list[float], bad: list[float]) -> list[float]:
    """What a document's log odds of being good start from, and what each rule's good and bad vote add."""
    steps = [math.log(prior / (1 - prior))]
    for g, b in zip(good, bad, strict=True):
        steps += [math.log(g / (1 - b)), math.log((1 - g) / b)]
    return steps


def posterior(names: list[str], steps: Column) -> Column:
    """Probability of good given the votes in columns ``names``; ``steps`` is the array of :func:`odds_steps`."""
    odds = steps[0]
    for j, name in enumerate(names):
        vote = F.when(F.col(name) == 1, steps[2 * j + 1]).when(F.col(name) == -1, steps[2 * j + 2])
        odds = odds + vote.otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-odds))


def estimate(patterns: list[tuple], m: int, rounds: int = ROUNDS) -> tuple[float, list[float], list[float]]:
    """Share of good documents and the rates of the ``m`` rules, from patterns: m votes, then the number of documents."""
    hold = lambda x, least, most: min(max(x, least), most)
    total = sum(row[-1] for row in patterns)
    prior, good, bad = 0.8, [0.95] * m, [0.4] * m
    for _ in range(rounds if total else 0):
        steps = odds_steps(prior, good, bad)
        kept, sums = 0.0, [[0.0] * 4 for _ in range(m)]
        for *row, n in patterns:
            odds = steps[0] + sum(steps[2 * j + (1 if v == 1 else 2)] for j, v in enumerate(row) if v)
            p = 1 / (1 + math.exp(-odds))
            kept += n * p
            for own, v in zip(sums, row, strict=True):
                if v:
                    own[0] += n * p * (v == 1)
                    own[1] += n * p
                    own[2] += n * (1 - p) * (v == -1)
                    own[3] += n * (1 - p)
        prior = hold(kept / total, 0.01, 0.99)
        for j, (on_good, told_good, on_bad, told_bad) in enumerate(sums):
            bad[j] = hold(on_bad / told_bad if told_bad else 0.4, *BAD_RATES)
            good[j] = hold(on_good / told_good if told_good else 0.95, max(GOOD_RATES[0], 1 - bad[j] / 2), GOOD_RATES[1])
    return prior, good, bad


def learned_steps(voted: DataFrame, names: list[str]) -> Column:
    """The steps of :func:`odds_steps` for these votes; at most 3^m rows of small numbers come to the driver."""
    counted = voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()
    return F.array(*[F.lit(x) for x in odds_steps(*estimate(sorted(map(tuple, counted)), len(names)))])


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(
    docs: DataFrame, rules: Callable[[], dict[str, Column]] = default_rules, keep_at: float = 0.5
) -> DataFrame:
    """doc_id, the measures, base_failed, the vote of each rule, the posterior ``quality`` and ``kept``."""
    named = rules()
    names = [f"vote_{name}" for name in named]
    measured = docs.select("doc_id", *[c.alias(k) for k, c in measures(F.col("text")).items()]).select("doc_id", *SPREAD)
    voted = measured.withColumn("base_failed", base_failed())
    told = stored(voted.withColumns(dict(zip(names, named.values(), strict=True))), "quality-votes")
    out = told.withColumn("quality", posterior(names, learned_steps(told, names)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep_at))


def kept_documents(
    docs: DataFrame, rules: Callable[[], dict[str, Column]] = default_rules, keep_at: float = 0.5
) -> DataFrame:
    """The rows of ``docs`` (all columns) that ``judge`` keeps."""
    named = rules()
    votes_of = {f"vote_{name}": vote for name, vote in named.items()}
    names = list(votes_of)
    measured = docs.select(*[c.alias(k) for k, c in measures(F.col("text")).items()]).select(*SPREAD)
    steps = learned_steps(measured.select(*[c.alias(k) for k, c in votes_of.items()]), names)
    # The texts are measured again instead of being stored with their votes. What is measured goes into one struct and
    # the document into another, whatever its columns are called.
    row, found = fresh(docs, "_row"), fresh(docs, "_found")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), F.col("text").alias(found))
    rows = rows.select(row, *[c.alias(k) for k, c in measures(F.col(found)).items()]).select(row, *SPREAD)
    judged = rows.select(row, base_failed().alias("base_failed"), *[c.alias(k) for k, c in votes_of.items()])
    return judged.filter(~F.col("base_failed") & (posterior(names, steps) >= keep_at)).select(f"{row}.*")
