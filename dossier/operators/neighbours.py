"""Exact nearest neighbours of a table of queries by pivot cells.

Vectors are dealt to the nearest of a bounded number of pivots (stored vectors, picked by the hash of their id). A
cell is known by its number of vectors and by the least and greatest angle between its vectors and its pivot. By the
triangle inequality on the sphere, a query that stands at angle q from a pivot is at least q - greatest and
least - q away from every vector of the cell, which bounds the cosine of the whole cell.

A query first meets the cells nearest to it, as many as hold k vectors. The worst of the k scores found there is a
floor: every other cell whose bound lies below it is ruled out, the rest are met in a second round. Cells are packed
into blocks, and a crowded cell is split over several; a query is sent to a block once, with the cells it asks for.
Queries and blocks meet by an equi-join on (block, salt); a group of the join holds a bounded number of vectors and
queries and returns the best k rows per query that reach its floor, never its pairs. Only the pivots and one line per
cell are known to the driver, a number that a parameter bounds per dimension; queries and vectors never pass it.

Null and empty vectors and zero queries match nothing; zero vectors score 0. Vectors meet queries of their dimension.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.operators.blocks import ARROW, CELLS, TaskTopK, dealt, in_parts, kind_of, spread, top_k
from dossier.operators.vectors import matrix_of, scores_of, units_of
from dossier.session import cut_lineage

CELL_ROWS = 2048
MOST_PIVOTS = 512
#: Vectors and queries of one group of the join, and the components of one side of it.
GROUP_VECTORS = 32_768
GROUP_QUERIES = 32_768
#: Below this number of queries a group is not split further to busy more cores.
LEAST_QUERIES = 1024
#: Bounds are compared with rounded scores; angles of nearly equal vectors are good to about 1e-8.
SLACK = 1e-6


@dataclass
class Cells:
    """Pivots (unit vectors) by dimension, and what is known of their cells. The last cell of a dimension holds zeros."""

    pivots: dict[int, np.ndarray]
    first: dict[int, int] = field(default_factory=dict)
    total: int = 0
    rows: np.ndarray | None = None
    least: np.ndarray | None = None
    most: np.ndarray | None = None
    #: Blocks: the first of each cell, how many each cell is split over, the cells of each, and their number.
    block: np.ndarray | None = None
    split: np.ndarray | None = None
    held: dict[int, list[tuple[int, np.ndarray]]] = field(default_factory=dict)
    blocks: int = 0

    def __post_init__(self) -> None:
        for dim in sorted(self.pivots):
            self.first[dim] = self.total
            self.total += len(self.pivots[dim]) + 1

    def measure(self, rows: list) -> None:
        self.rows, self.least, self.most = np.zeros(self.total, np.int64), np.zeros(self.total), np.zeros(self.total)
        for r in rows:
            self.rows[r["cell"]], self.least[r["cell"]], self.most[r["cell"]] = r["rows"], r["least"], r["most"]
        self.pack()

    def pack(self) -> None:
        """Cells of a dimension, in order, into blocks of at most ``group_rows`` vectors."""
        self.block, self.split = np.zeros(self.total, np.int64), np.ones(self.total, np.int64)
        self.held, self.blocks = {}, 0
        for dim, first in self.first.items():
            most, open_cells, room = group_rows(GROUP_VECTORS, dim), [], 0
            self.held[dim] = []

            def close() -> None:
                if open_cells:
                    self.block[open_cells] = self.blocks
                    self.held[dim].append((self.blocks, np.array(open_cells)))
                    self.blocks += 1
                    open_cells.clear()

            for cell in range(first, first + len(self.pivots[dim]) + 1):
                rows = int(self.rows[cell])
                if rows > most:
                    self.split[cell] = -(-rows // most)
                    self.block[cell] = self.blocks
                    self.held[dim] += [(self.blocks + i, np.array([cell])) for i in range(self.split[cell])]
                    self.blocks += int(self.split[cell])
                elif rows:
                    if rows > room:
                        close()
                        room = most
                    # Cells of a block need not follow one another: a crowded one has blocks of its own.
                    open_cells.append(cell)
                    room -= rows
            close()

    def assign(self, dim: int, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, angle to its pivot) of each row."""
        cosines = scores_of(matrix, self.pivots[dim])
        zero = ~matrix.any(axis=1)
        if not cosines.shape[1]:
            return np.full(len(matrix), self.first[dim]), np.zeros(len(matrix))
        near = cosines.argmax(axis=1)
        angle = np.arccos(np.clip(cosines[np.arange(len(matrix)), near], -1, 1))
        return self.first[dim] + np.where(zero, cosines.shape[1], near), np.where(zero, 0.0, angle)

    def bounds(self, dim: int, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(angle to the pivots, upper bound of the cosine within the cell), [query, cell of the dimension]."""
        pivots = self.pivots[dim]
        own = slice(self.first[dim], self.first[dim] + len(pivots))
        angle = np.arccos(np.clip(units @ pivots.T, -1, 1))
        away = np.maximum(np.maximum(angle - self.most[own], self.least[own] - angle), 0)
        zeros = np.zeros((len(units), 1))
        # Zero vectors score 0 for every query; their cell comes last.
        return np.hstack([angle, zeros + np.inf]), np.hstack([np.cos(away), zeros]) + SLACK

    def rounds(self, dim: int, units: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(met first, may be met later, bounds), [query, cell of the dimension]."""
        own = slice(self.first[dim], self.first[dim] + len(self.pivots[dim]) + 1)
        angle, bound = self.bounds(dim, units)
        order = np.argsort(angle, axis=1, kind="stable")
        held = self.rows[own][order]
        before = np.cumsum(held, axis=1) - held
        early = np.zeros(angle.shape, bool)
        np.put_along_axis(early, order, (before < k) & (held > 0), axis=1)
        return early, ~early & (self.rows[own] > 0), bound


def group_rows(most: int, dim: int) -> int:
    """Rows of ``dim`` components on one side of a group."""
    return max(1, min(most, CELLS // dim))


def pick_pivots(vectors: DataFrame, cell_rows: int, most: int) -> Cells:
    """About one pivot for ``cell_rows`` vectors of a dimension, ``most`` at most."""
    sized = vectors.where(F.size("vector") > 0).select("chunk_id", "vector", F.size("vector").alias("dim"))
    counts = {r["dim"]: r["n"] for r in sized.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    wanted = {dim: min(most, -(-n // cell_rows)) for dim, n in counts.items()}
    nonzero = sized.where(F.exists("vector", lambda x: x != 0))
    order = [F.xxhash64("chunk_id"), F.col("chunk_id")]
    picked: dict[int, list] = {dim: [] for dim in wanted}
    for r in top_k(nonzero, "dim", order, max(wanted.values(), default=1), "place").select("dim", "vector", "place").collect():
        if r["place"] <= wanted[r["dim"]]:
            picked[r["dim"]].append(r["vector"])
    return Cells({dim: units_of(rows) if rows else np.zeros((0, dim)) for dim, rows in picked.items()})


def by_dimension(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, positions of its rows, their vectors)."""
    sizes = np.asarray(column.value_lengths().fill_null(0))
    for dim in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == dim)
        yield int(dim), at, matrix_of(column.take(pa.array(at)))


def in_cells(vectors: DataFrame, cells: Cells) -> DataFrame:
    """chunk_id, vector, cell, angle of every vector."""

    def run(batches):
        for batch in in_parts(batches, CELL_ROWS):
            for dim, at, matrix in by_dimension(batch.column(1)):
                cell, angle = cells.assign(dim, matrix)
                own = pa.array(at)
                columns = [batch.column(0).take(own), batch.column(1).take(own), pa.array(cell.astype(np.int32)), pa.array(angle)]
                yield pa.RecordBatch.from_arrays(columns, names=["chunk_id", "vector", "cell", "angle"])

    own = f"chunk_id {kind_of(vectors, 'chunk_id')}, vector {kind_of(vectors, 'vector')}"
    rows = spread(vectors.select("chunk_id", "vector").where(F.size("vector") > 0), "chunk_id")
    return rows.mapInArrow(run, f"{own}, cell int, angle double")


def asking(queries: DataFrame, shared, k: int, later: bool) -> DataFrame:
    """query_id, vector, floor, block, cells: the cells that a query meets first, or those its ``floor`` does not rule
    out later, in one row for every block that holds some of them."""

    def run(batches):
        cells: Cells = shared.value
        for batch in in_parts(batches, CELL_ROWS):
            for dim, at, matrix in by_dimension(batch.column(1)):
                if dim not in cells.first:
                    continue
                wanted, rest, bound = cells.rounds(dim, units_of(matrix), k)
                floor = np.full(len(at), -2.0)
                if later:
                    floor = batch.column(2).take(pa.array(at)).to_numpy(zero_copy_only=False)
                    wanted = rest & (bound >= floor[:, None])
                for block, members in cells.held[dim]:
                    asked = wanted[:, members - cells.first[dim]]
                    row = np.flatnonzero(asked.any(axis=1))
                    if not len(row):
                        continue
                    counts = asked[row].sum(axis=1)
                    starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    listed = members[np.nonzero(asked[row])[1]].astype(np.int32)
                    own = pa.array(at[row])
                    columns = [
                        batch.column(0).take(own),
                        batch.column(1).take(own),
                        pa.array(floor[row]),
                        pa.array(np.full(len(row), block, np.int32)),
                        pa.ListArray.from_arrays(pa.array(starts), pa.array(listed)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vector", "floor", "block", "cells"])

    own = f"query_id {kind_of(queries, 'query_id')}, vector {kind_of(queries, 'vector')}"
    return queries.mapInArrow(run, f"{own}, floor double, block int, cells array<int>")


def query_salts(session, cells: Cells, query_rows: int) -> int:
    """Parts of the queries: of bounded size, and enough of them to busy the cores when there are few blocks."""
    most = group_rows(GROUP_QUERIES, max(cells.first, default=1))
    busy = -(-4 * session.sparkContext.defaultParallelism // max(1, cells.blocks))
    return max(1, -(-query_rows // most), min(busy, query_rows // LEAST_QUERIES))


def meet(queries: DataFrame, members: DataFrame, cells: Cells, query_rows: int, k: int) -> DataFrame:
    """query_id, chunk_id, score: the best k of every group of a block's vectors and the queries that ask for its cells."""
    query_kind, id_kind = kind_of(queries, "query_id"), kind_of(members, "chunk_id")
    salts = query_salts(queries.sparkSession, cells, query_rows)

    def known(numbers: np.ndarray) -> Column:
        return F.element_at(F.split(F.lit(",".join(map(str, numbers))), ","), F.col("cell") + 1).cast("int")

    def salt(key: str, into: Column) -> Column:
        return F.pmod(F.xxhash64(key), into).cast("int")

    left = members.select(
        "chunk_id",
        "vector",
        "cell",
        (known(cells.block) + salt("chunk_id", known(cells.split))).alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("q"),
    )
    right = queries.select("*", salt("query_id", F.lit(salts)).alias("q"))

    def score(vector_table: pa.Table, query_table: pa.Table) -> pa.Table:
        batches: list[pa.RecordBatch] = []
        if vector_table.num_rows and query_table.num_rows:
            ids = np.asarray(vector_table.column("chunk_id").to_pylist())
            matrix = matrix_of(vector_table.column("vector").combine_chunks())
            units = units_of(matrix_of(query_table.column("vector").combine_chunks()))
            kept = TaskTopK(query_table.column("query_id").to_pylist(), k)
            kept.edge = query_table.column("floor").to_numpy().copy()
            listed = query_table.column("cells").combine_chunks()
            asker, asked = np.repeat(np.arange(len(units)), listed.value_lengths()), listed.flatten().to_numpy()
            cell = vector_table.column("cell").to_numpy()
            for number in np.unique(cell):
                own, askers = np.flatnonzero(cell == number), asker[asked == number]
                if not len(askers):
                    continue
                step = max(1, CELLS // len(askers))
                for start in range(0, len(own), step):
                    rows = own[start : start + step]
                    kept.add_matrix(scores_of(matrix[rows], units[askers]), ids[rows], numbers=askers)
            batches = list(kept.batches(query_kind, id_kind))
        schema = pa.schema([("query_id", ARROW[query_kind]), ("chunk_id", ARROW[id_kind]), ("score", pa.float64())])
        return pa.Table.from_batches(batches, schema)

    keys = ["block", "q"]
    groups = dealt(left, *keys).groupBy(*keys).cogroup(dealt(right, *keys).groupBy(*keys))
    return groups.applyInArrow(score, f"query_id {query_kind}, chunk_id {id_kind}, score double")


def knn_join(
    queries: DataFrame, vectors: DataFrame, k: int, cell_rows: int = CELL_ROWS, most_pivots: int = MOST_PIVOTS
) -> DataFrame:
    """Exact top-k by cosine for a table of queries.

    queries: query_id, vector; vectors: chunk_id, vector. Returns query_id, chunk_id, score, rank; equal scores are
    ranked by chunk_id. ``cell_rows`` and ``most_pivots`` change where the work is done, not the result.
    """
    order = [F.desc("score"), F.col("chunk_id")]
    usable = queries.select("query_id", "vector").where(F.exists("vector", lambda x: x != 0))
    cells = pick_pivots(vectors, cell_rows, most_pivots)
    members = cut_lineage(in_cells(vectors, cells))
    lines = members.groupBy("cell").agg(F.count("*").alias("rows"), F.min("angle").alias("least"), F.max("angle").alias("most"))
    cells.measure(lines.collect())
    shared = vectors.sparkSession.sparkContext.broadcast(cells)
    asked = usable.count()
    first = meet(asking(usable, shared, k, later=False), members, cells, asked, k)
    if all((cells.rows[a : a + len(cells.pivots[dim]) + 1] > 0).sum() <= 1 for dim, a in cells.first.items()):
        return top_k(first, "query_id", order, k)  # no dimension has a second cell
    first = cut_lineage(top_k(first, "query_id", order, k))
    floor = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).otherwise(-2.0).alias("floor"))
    left = usable.join(floor, "query_id", "left").select("query_id", "vector", F.coalesce("floor", F.lit(-2.0)).alias("floor"))
    second = meet(asking(left, shared, k, later=True), members, cells, asked, k)
    return top_k(first.drop("rank").unionByName(second), "query_id", order, k)
