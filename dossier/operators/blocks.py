"""Helpers of operators that score many queries against many rows: spreading, best rows per query and task, top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Cells of a score matrix held at a time by one task.
CELLS = 4_000_000
# Texts or pages that a task reads at a time.
PART = 256

ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}


def kind_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def in_parts(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows: what a task makes of a batch may be many times its size, and the session, not
    the operator, says how many rows a batch has."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def runs_of_keys(batches: Iterator[pa.RecordBatch], needed: str | None = None) -> Iterator[tuple[object, list[tuple]]]:
    """(key, rows) of rows that stand together by their first column, which is not null; rows are without it.

    Runs of which no row has the flag ``needed`` are passed over unread.
    """
    held, parts = None, []

    def rows() -> list[tuple]:
        if needed is not None and not any(True in part.column(needed).to_pylist() for part in parts):
            return []
        return [row for part in parts for row in zip(*[c.to_pylist() for c in part.columns[1:]])]

    for batch in in_parts(batches, 8 * PART):
        keys = batch.column(0).to_pylist()
        starts = [place for place in range(len(keys)) if not place or keys[place] != keys[place - 1]]
        for start, stop in zip(starts, [*starts[1:], len(keys)]):
            if parts and keys[start] != held:
                if found := rows():
                    yield held, found
                parts = []
            held = keys[start]
            parts.append(batch.slice(start, stop - start))
    if parts and (found := rows()):
        yield held, found


def in_batches(
    rows: Iterator[tuple[object, tuple, int]], key: str, kind: pa.DataType, fields: list[tuple[str, pa.DataType, str]], most: int = 4 << 20
) -> Iterator[pa.RecordBatch]:
    """Batches of (key, values, size) rows, each of ``most`` by the rows' sizes or little more."""
    keys, values, size = [], [], 0

    def batch() -> pa.RecordBatch:
        columns = [pa.array([row[number] for row in values], arrow) for number, (_, arrow, _) in enumerate(fields)]
        return pa.RecordBatch.from_arrays([pa.array(keys, kind), *columns], names=[key, *[name for name, _, _ in fields]])

    for k, row, bytes_ in rows:
        keys.append(k)
        values.append(row)
        size += bytes_
        if size >= most:
            yield batch()
            keys, values, size = [], [], 0
    if values:
        yield batch()


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal a small input of CPU-heavy work over the partitions that the session asks for.

    ``dossier.spread.partitions`` is unset by default: files keep their splits and nothing is
    shuffled. A session over tables of one file each, such as a test, sets it.
    """
    partitions = df.sparkSession.conf.get("dossier.spread.partitions", None)
    return df if partitions is None else df.repartition(int(partitions), key)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Partition by ``keys`` into the session's number of shuffle partitions.

    In front of CPU-heavy Python work on few bytes, where the adaptive planner would join partitions by their size.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def leveled(df: DataFrame, key: str) -> DataFrame:
    """Deal rows that are about to grow or to be read in Python, since a small file is one split however much work it is.

    A few tasks for every core, unless the session asks for a number: the adaptive planner would count the small bytes.
    """
    session = df.sparkSession
    partitions = session.conf.get("dossier.spread.partitions", None) or 4 * session.sparkContext.defaultParallelism
    return df.repartition(int(partitions), key)


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input and must not be broadcast.

    The planner takes a side's size from its file, and columns that repeat or are computed make rows far larger than
    their file; the adaptive planner keeps a broadcast once planned, since leaving it costs a further shuffle.
    """
    return df.hint("merge")


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters read instead of repeating their expressions.

    A filter on an ordinary derived column is pushed below the projection by writing the
    expression into the filter, once per use; it does not pass the one-row generator used here.
    """
    fresh = F.struct(*[value.alias(name) for name, value in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(fresh)))


def top_k(df: DataFrame, group: str, order: list, k: int, name: str = "rank") -> DataFrame:
    """First k rows per group with their rank; Spark cuts each task's share before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col(name) <= k)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Top k by (score descending, id ascending)."""
    if len(scores) > k:
        # Keep everything level with the k-th score, so that ids decide ties.
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = scores >= edge
        scores, ids = scores[keep], ids[keep]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


class TaskTopK:
    """The best k rows per query seen so far by one task."""

    def __init__(self, query_ids: list, k: int) -> None:
        self.query_ids, self.k = query_ids, k
        self.kept: list = [None] * len(query_ids)
        self.edge = np.full(len(query_ids), -np.inf)

    def add(self, number: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(scores):
            return
        if self.kept[number] is not None:
            scores = np.concatenate([self.kept[number][0], scores])
            ids = np.concatenate([self.kept[number][1], ids])
        self.kept[number] = best(scores, ids, self.k)
        if len(self.kept[number][0]) == self.k:
            self.edge[number] = self.kept[number][0][-1]

    def add_matrix(
        self, scores: np.ndarray, ids: np.ndarray, above: float = -np.inf, numbers: np.ndarray | None = None
    ) -> None:
        """Scores (rows x queries) of one stretch of the corpus; only those ``above`` a floor count.

        The columns are all queries, or those with these ``numbers``. Once a query has k rows, most stretches hold
        nothing better and are passed over whole.
        """
        hit = (scores >= (self.edge if numbers is None else self.edge[numbers])) & (scores > above)
        for column in np.nonzero(hit.any(axis=0))[0]:
            rows = hit[:, column]
            self.add(column if numbers is None else numbers[column], scores[rows, column], ids[rows])

    def batches(self, query_kind: str, id_kind: str) -> Iterator[pa.RecordBatch]:
        for query_id, hits in zip(self.query_ids, self.kept):
            if hits is not None:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([query_id] * len(hits[0]), ARROW[query_kind]),
                        pa.array(hits[1].tolist(), ARROW[id_kind]),
                        pa.array(hits[0], pa.float64()),
                    ],
                    names=["query_id", "chunk_id", "score"],
                )
