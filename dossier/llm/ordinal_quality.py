"""Quality classifier: ordinal cumulative-link regression on graded ratings.

The chance of a grade above g is the logistic function of w.x - threshold(g): one weight vector over hashed text
features, and ordered thresholds (the first, and positive steps between them). Features of a text are its runs of
letters in lower case and the first ``STEM`` bytes of each, its word shapes (runs of capitals, letters and digits shortened to one sign, other signs as they are) and two
measured classes (number of words, share of distinct words), each hashed into 2^``BITS`` slots with log(1 + count), to length 1. Slots in
fewer than ``LEAST_TEXTS`` texts of the sample get no weight: they tell single texts apart, not grades.

The model is fitted on a sample of at most ``max_train`` rated rows: those with the smallest hash of the id. That bound
is what makes one task enough for the fit; every document is scored.

``fit`` needs ratings (doc_id, grade) with grades 0, 1, ...; rows with a null id or grade, or of no document, teach
nothing, several ratings of a document teach each. With fewer than two grades the expected grade is that grade (0 when
there is none) and the tail probability 1. Null texts and texts without words have the two measured features only.
Repeated rows are scored each, null ids are kept. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.tables import id_number, id_text
from dossier.llm.words import mix, slabs, word_hashes

BITS = 18
#: Letters in lower case; ASCII signs and digits part words.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SHAPE = bytes(
    65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256)
)
LEAST_TEXTS = 3
STEM = 6
RUN = re.compile(rb"(.)\1+")


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots, values, borders) of the texts' features, in one row per text."""
    n = len(texts)
    keys, owners = [], []
    plain = [t.translate(LETTERS) for t in texts]
    shapes = [RUN.sub(rb"\1", t.translate(SHAPE)) for t in texts]
    for salt, made, first in ((1, plain, None), (2, shapes, None), (3, plain, STEM)):
        hashes, border = word_hashes(made, first)
        owner = np.repeat(np.arange(n), np.diff(border))
        keys.append(mix(hashes ^ mix(np.array([salt], np.uint64))) >> np.uint64(64 - BITS))
        owners.append(owner)
        if salt == 1:
            count = np.diff(border)
            distinct = np.bincount(
                np.unique(np.stack((owner.astype(np.uint64), hashes), 1), axis=0)[:, 0].astype(np.int64), minlength=n
            )
    measured = [np.log2(count + 1).astype(np.uint64), (10 * distinct // np.maximum(count, 1)).astype(np.uint64)]
    for salt, value in enumerate(measured, 4):
        keys.append(mix(value + np.uint64(1000 * salt)) >> np.uint64(64 - BITS))
        owners.append(np.arange(n))
    both = (np.concatenate(owners).astype(np.int64) << BITS) | np.concatenate(keys).astype(np.int64)
    cells, times = np.unique(both, return_counts=True)
    border = np.searchsorted(cells, np.arange(n + 1) << BITS)
    values = np.log1p(times)
    norm = np.sqrt(np.add.reduceat(values**2, border[:-1]))  # every text has its measured classes
    values = (values / np.repeat(norm, np.diff(border))).astype(np.float32)
    return (cells & ((1 << BITS) - 1)).astype(np.int32), values, border


def row_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        grade, order = batch["grade"].to_numpy(), batch["order"].to_numpy()
        for first, slab in slabs(batch["text"]):
            slots, values, border = features(slab)
            at = slice(first, first + len(slab))
            spans = list(zip(border[:-1], border[1:], strict=True))
            yield pd.DataFrame(
                {
                    "grade": grade[at],
                    "order": order[at],
                    "slots": [slots[a:b].tobytes() for a, b in spans],
                    "values": [values[a:b].tobytes() for a, b in spans],
                }
            )


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def loss_and_gradient(p, slots, values, row, grade, grades: int, ridge: float) -> tuple[float, np.ndarray]:
    """Penalised mean log loss at (weights, first threshold, logs of the steps between thresholds)."""
    n, dims = len(grade), 1 << BITS
    w, gaps = p[:dims], np.exp(p[dims + 1 :])
    limits = p[dims] + np.concatenate(([0.0], np.cumsum(gaps)))
    rows = np.arange(n)
    score = np.bincount(row, values * w[slots], n)
    above = np.concatenate((np.ones((n, 1)), logistic(score[:, None] - limits), np.zeros((n, 1))), axis=1)  # P(grade >= g)
    chance = np.maximum(above[rows, grade] - above[rows, grade + 1], 1e-12)
    slope = above * (1 - above) / chance[:, None]
    lower, upper = slope[rows, grade], slope[rows, grade + 1]
    on_limits = np.zeros((n, grades + 1))
    on_limits[rows, grade] += lower
    on_limits[rows, grade + 1] -= upper
    on_limits = on_limits[:, 1:grades].sum(axis=0)
    on_weights = -np.bincount(slots, values * (lower - upper)[row], dims) / n + ridge * w
    on_steps = [on_limits[k + 1 :].sum() * gaps[k] / n for k in range(len(gaps))]
    loss = -np.log(chance).mean() + ridge / 2 * (w @ w)
    return loss, np.concatenate((on_weights, [on_limits.sum() / n], on_steps))


def optimise(
    slots: np.ndarray, values: np.ndarray, row: np.ndarray, grade: np.ndarray, grades: int, ridge: float, rounds: int
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the largest penalised likelihood, by limited-memory BFGS over all rows."""
    dims = 1 << BITS
    share = np.array([np.mean(grade >= g) for g in range(1, grades)]).clip(1e-4, 1 - 1e-4)
    start = -np.log(share / (1 - share))  # thresholds of a model without weights
    p = np.concatenate((np.zeros(dims), start[:1], np.log(np.maximum(np.diff(start), 1e-2))))
    data = (slots, values, row, grade, grades, ridge)
    loss, g = loss_and_gradient(p, *data)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, kept = -g, []
        for s, y in reversed(pairs):
            a = (s @ d) / (s @ y)
            kept.append(a)
            d = d - a * y
        d = d * ((pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, np.abs(g).sum()))
        for (s, y), a in zip(pairs, reversed(kept), strict=True):
            d = d + s * (a - (y @ d) / (s @ y))
        step, slope = 1.0, g @ d
        while True:
            new_loss, new_g = loss_and_gradient(p + step * d, *data)
            if new_loss <= loss + 1e-4 * step * slope or step < 1e-6:
                break
            step /= 2
        s, y = step * d, new_g - g
        if s @ y > 1e-12:
            pairs = [*pairs[-9:], (s, y)]
        done = loss - new_loss < 1e-7
        p, loss, g = p + s, new_loss, new_g
        if done:
            break
    limits = p[dims] + np.concatenate(([0.0], np.cumsum(np.exp(p[dims + 1 :]))))
    return p[:dims].astype(np.float32), limits


def fitted(ridge: float, rounds: int):
    def run(sample: pd.DataFrame) -> pd.DataFrame:
        if not len(sample):
            return pd.DataFrame(columns=["weights", "limits", "only"])
        sample = sample.sort_values(["order", "grade", "slots"])
        grade = sample["grade"].to_numpy().astype(np.int64)
        grades = int(grade.max()) + 1
        weights, limits = np.zeros(1 << BITS, np.float32), np.zeros(0)
        if len(np.unique(grade)) > 1:
            length = np.array([len(s) // 4 for s in sample["slots"]])
            slots = np.frombuffer(b"".join(sample["slots"]), np.int32)
            values = np.frombuffer(b"".join(sample["values"]), np.float32)
            row = np.repeat(np.arange(len(grade)), length)
            shared = np.bincount(slots, minlength=1 << BITS)[slots] >= LEAST_TEXTS
            slots, values, row = slots[shared], values[shared], row[shared]
            weights, limits = optimise(slots, values, row, grade, grades, ridge, rounds)
        return pd.DataFrame({"weights": [weights.tobytes()], "limits": [limits.tobytes()], "only": [int(grade[0])]})

    return run


class Model:
    def __init__(self, weights: np.ndarray, limits: np.ndarray, only: int) -> None:
        self.weights, self.limits, self.only = weights, limits, only

    def above(self, texts: list[bytes]) -> np.ndarray:
        """P(grade > g) of every text, a column for each threshold."""
        slots, values, border = features(texts)
        score = np.add.reduceat(values.astype(np.float64) * self.weights[slots], border[:-1])
        return logistic(score[:, None] - self.limits)


def fit(docs: DataFrame, ratings: DataFrame, max_train: int = 10_000, ridge: float = 3e-5, rounds: int = 60) -> Model:
    """The model of a bounded sample; what comes to the driver has the fixed size of the weights."""
    rated = ratings.filter(F.col("doc_id").isNotNull() & F.col("grade").isNotNull())
    rated = rated.select(F.col("doc_id").cast("long").alias("r_id"), F.col("grade").cast("int").alias("grade"))
    rated = rated.withColumn("order", F.xxhash64("r_id")).orderBy("order", "grade").limit(max_train)
    # At most max_train rows of three numbers.
    sample = docs.select(F.col("doc_id").cast("long").alias("d_id"), "text").join(
        F.broadcast(rated), F.col("d_id") == F.col("r_id")
    )
    sample = sample.select("grade", "order", "text")
    rows = sample.mapInPandas(row_features, "grade int, order long, slots binary, values binary")
    rows = rows.orderBy("order", "grade").limit(max_train)
    made = rows.groupBy().applyInPandas(fitted(ridge, rounds), "weights binary, limits binary, only int").collect()
    if not made:
        return Model(np.zeros(1 << BITS, np.float32), np.zeros(0), 0)
    return Model(np.frombuffer(made[0][0], np.float32), np.frombuffer(made[0][1], np.float64), made[0][2])


def grade_documents(docs: DataFrame, model: Model, keep_at: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, tail (chance of the best grade) and kept (tail of ``keep_at`` or more)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            expected, tail = np.full(len(batch), float(model.only)), np.ones(len(batch))
            texts = batch.pop("text")
            for first, slab in slabs(texts) if len(model.limits) else ():
                above = model.above(slab)
                expected[first : first + len(slab)] = above.sum(axis=1)
                tail[first : first + len(slab)] = above[:, -1]
            yield batch.assign(expected_grade=expected, tail=tail)

    told = docs.select(id_text(), "text").mapInPandas(run, "doc_id string, expected_grade double, tail double")
    return told.withColumn("doc_id", id_number()).withColumn("kept", F.col("tail") >= keep_at)
