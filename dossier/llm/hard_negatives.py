"""Hard negatives of anchor vectors, scored exactly by lookups in subset-sum tables (the method of four Russians).

Every component becomes the integer floor(scale * x). A row is kept as bit planes: plane b holds bit b (two's
complement) of all components, eight dimensions to a byte. For a block of anchors and every group of eight dimensions
a table holds the 256 sums of the anchors' components over the subsets of the group. A row's byte of plane b picks one
entry of the group's table; the picked sums of a plane are added over the groups, shifted by b and added over the
planes (the last plane counts negative). That is the whole integer inner product, with no multiplication and no loss.

Anchors and rows are dealt into blocks of bounded size by the hash of their id, and block meets block by an
equi-join on both numbers: no side is collected or broadcast. Anchors meet rows twice: first those of their own label
(a hot label is dealt over as many blocks as it needs), which gives the positives; then all rows, with the score
windows that follow from the positives. A pair of blocks returns its best few per anchor, never its pairs.

Rows that take no part: null id, null label, null vector, a component that is null, not finite, or beyond 2^22 after
scaling, and vectors of no components. Rows that share an id are one row (the least by label, then vector). Vectors
of different lengths never meet. Ties go to the smaller id. An empty table, or one without anchors, gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.tables import stored

LARGEST = 1 << 22
STRIP = 1024


def quantised(vectors: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(integer components in a row, border positions, which rows may take part)."""
    sizes = np.asarray(vectors.value_lengths().fill_null(0), np.int64)
    flat = vectors.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    border = np.concatenate(([0], np.cumsum(sizes)))
    with np.errstate(invalid="ignore", over="ignore"):
        values = np.floor(scale * flat)
        fits = np.abs(values) <= LARGEST  # false for what is not finite
    misfits = np.concatenate(([0], np.cumsum(~fits)))
    good = (sizes > 0) & (misfits[border[1:]] == misfits[border[:-1]])
    return np.where(fits, values, 0).astype(np.int32), border, good


def planes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits that each row needs, bytes [row, plane, group] of as many planes as the neediest row has)."""
    magnitude = np.where(rows < 0, ~rows, rows).max(axis=1)
    bits = np.frexp(magnitude.astype(np.float64))[1].astype(np.int32) + 1
    padded = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 8)))
    out = np.empty((len(rows), int(bits.max(initial=1)), padded.shape[1] // 8), np.uint8)
    for b in range(out.shape[1]):
        out[:, b] = np.packbits((padded >> b & 1).astype(np.uint8), axis=1, bitorder="little")
    return bits, out


def unplaned(packed: np.ndarray, dim: int) -> np.ndarray:
    """The integer components behind bytes [row, plane, group]."""
    spread = np.unpackbits(packed, axis=2, bitorder="little")[:, :, :dim].astype(np.int64)
    weight = 1 << np.arange(packed.shape[1], dtype=np.int64)
    weight[-1] *= -1
    return np.einsum("rbd,b->rd", spread, weight)


def subset_sums(anchors: np.ndarray, kind: type) -> np.ndarray:
    """[group, byte, anchor]: the sum of the anchor's components over the dimensions whose bits the byte sets."""
    count, dim = anchors.shape
    groups = np.pad(anchors, ((0, 0), (0, -dim % 8))).reshape(count, -1, 8).transpose(1, 2, 0).astype(kind)
    table = np.zeros((groups.shape[0], 256, count), kind)
    for j in range(8):
        table[:, 1 << j : 2 << j] = table[:, : 1 << j] + groups[:, j, None]
    return table


def inner_products(table: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """[row, anchor] inner products of rows given as bytes [row, plane, group]."""
    count = packed.shape[1]
    total = np.zeros((len(packed), table.shape[2]), table.dtype)
    for b in range(count):
        plane = table[0][packed[:, b, 0]]
        for g in range(1, packed.shape[2]):
            plane += table[g][packed[:, b, g]]
        plane <<= b
        total = total - plane if b == count - 1 else total + plane
    return total


def packed_rows(vectors: DataFrame, scale: float) -> DataFrame:
    """row_id, label, dim, bits, code (bit planes) of the rows that take part; rows of one id are one."""
    kind = vectors.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, border, good = quantised(batch.column("vector"), scale)
            sizes = np.diff(border)
            for dim in np.unique(sizes[good]):
                at = np.flatnonzero(good & (sizes == dim))
                bits, code = planes(values[border[at][:, None] + np.arange(dim)])
                # A plane above a row's own bits repeats its sign, so a row keeps as many planes as it needs.
                for need in np.unique(bits):
                    own = at[bits == need]
                    cells = code[bits == need, :need].reshape(len(own), -1)
                    offsets = np.arange(len(own) + 1, dtype=np.int32) * cells.shape[1]
                    codes = pa.Array.from_buffers(
                        pa.binary(), len(own), [None, pa.py_buffer(offsets), pa.py_buffer(cells.tobytes())]
                    )
                    rows = pa.array(own)
                    constant = [pa.array(np.full(len(own), x, np.int32)) for x in (dim, need)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("row_id").take(rows), batch.column("label").take(rows), *constant, codes],
                        names=["row_id", "label", "dim", "bits", "code"],
                    )

    usable = vectors.where(F.col("row_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull())
    packed = usable.select("row_id", "label", "vector").mapInArrow(
        run, f"row_id bigint, label {kind}, dim int, bits int, code binary"
    )
    least = F.min(F.struct("label", "dim", "bits", "code")).alias("row")
    return packed.groupBy("row_id").agg(least).select("row_id", "row.*")


def numbered(rows: DataFrame, within: list[str], size: int, name: str) -> DataFrame:
    """Deal the rows of each group over blocks of about ``size`` rows; adds the block and the number of blocks."""
    counts = rows.groupBy(*within).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(f"{name}s"))
    return rows.join(counts, within).withColumn(name, F.pmod(F.xxhash64("row_id"), F.col(f"{name}s")).cast("int"))


def met(anchors: DataFrame, rows: DataFrame, within: list[str], anchor_rows: int, cell_rows: int, pick, schema: str):
    """``pick(anchor table, row table)`` of every pair of an anchor block and a row block of one group."""
    left = numbered(anchors, within, anchor_rows, "a")
    right = numbered(rows, within, cell_rows, "c")
    a_counts, c_counts = left.select(*within, "as").distinct(), right.select(*within, "cs").distinct()
    # Both sides come from one table; columns of their own keep them apart in the cogroup.
    left = left.join(c_counts, within).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("cs") - 1)))
    right = right.join(a_counts, within).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("as") - 1)))
    left = left.select([F.col(c).alias(c) for c in left.columns])
    keys = [*within, "a", "c"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(pick, schema)


def codes_of(table: pa.Table, bits: int, groups: int) -> np.ndarray:
    data = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8)
    return data.reshape(table.num_rows, bits, groups)


def scored(anchor_table: pa.Table, row_table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions of rows, score [row, anchor]) in strips of rows. Both sides have one dimension."""
    dim = anchor_table.column("dim")[0].as_py()
    groups = -(-dim // 8)
    a_bits, r_bits = (np.asarray(t.column("bits"), np.int32) for t in (anchor_table, row_table))
    anchors = np.zeros((anchor_table.num_rows, dim), np.int64)
    for need in np.unique(a_bits):
        own = np.flatnonzero(a_bits == need)
        anchors[own] = unplaned(codes_of(anchor_table.take(pa.array(own)), int(need), groups), dim)
    # Every partial sum stays below dim * 2^(bits of an anchor + bits of a row).
    small = int(a_bits.max()) + int(r_bits.max()) + dim.bit_length() < 31
    table = subset_sums(anchors, np.int32 if small else np.int64)
    for need in np.unique(r_bits):
        own = np.flatnonzero(r_bits == need)
        for at in range(0, len(own), STRIP):
            part = own[at : at + STRIP]
            yield part, inner_products(table, codes_of(row_table.take(pa.array(part)), int(need), groups))


def all_scores(anchor_table: pa.Table, row_table: pa.Table) -> np.ndarray:
    """[anchor, row] scores of one pair of blocks."""
    out = np.empty((anchor_table.num_rows, row_table.num_rows), np.int64)
    for part, scores in scored(anchor_table, row_table):
        out[:, part] = scores.T
    return out


def first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, equal ones by ascending id."""
    at = np.arange(len(scores))
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge)
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


POSITIVES = "anchor_id bigint, positive_id bigint, positive_score bigint"
NEGATIVES = "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"


def table_of(schema: str, columns: list[list]) -> pa.Table:
    names = [field.split()[0] for field in schema.split(", ")]
    return pa.table({name: pa.array(column, pa.int64()) for name, column in zip(names, columns, strict=True)})


def pick_positives(k: int):
    def run(anchor_table: pa.Table, row_table: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if anchor_table.num_rows and row_table.num_rows:
            ids = np.asarray(row_table.column("row_id"), np.int64)
            scores = all_scores(anchor_table, row_table)
            for n, anchor in enumerate(anchor_table.column("row_id").to_pylist()):
                other = np.flatnonzero(ids != anchor)
                best = other[first(scores[n, other], ids[other], k)]
                out[0] += [anchor] * len(best)
                out[1] += ids[best].tolist()
                out[2] += scores[n, best].tolist()
        return table_of(POSITIVES, out)

    return run


def pick_negatives(k: int, low: int, high: int):
    def run(anchor_table: pa.Table, row_table: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if anchor_table.num_rows and row_table.num_rows:
            ids = np.asarray(row_table.column("row_id"), np.int64)
            labels = np.asarray(row_table.column("label").to_pylist())
            scores = all_scores(anchor_table, row_table)
            wanted = anchor_table.column("positives").to_pylist()
            own = anchor_table.column("label").to_pylist()
            for n, anchor in enumerate(anchor_table.column("row_id").to_pylist()):
                other = np.flatnonzero(labels != own[n])
                found = scores[n, other]
                for positive in wanted[n]:
                    score = positive["positive_score"]
                    inside = other[(100 * found >= low * score) & (100 * found <= high * score)]
                    best = inside[first(scores[n, inside], ids[inside], k)]
                    out[0] += [anchor] * len(best)
                    out[1] += [positive["positive_id"]] * len(best)
                    out[2] += [score] * len(best)
                    out[3] += ids[best].tolist()
                    out[4] += scores[n, best].tolist()
        return table_of(NEGATIVES, out)

    return run


def ranked(rows: DataFrame, group: list[str], score: str, other: str, k: int) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc(score), other)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: float = 256.0,
    anchor_rows: int = 512,
    cell_rows: int = 4096,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: row_id (a whole number), label, vector; ``is_anchor`` is a condition on them. Per anchor the ``positives``
    highest-scoring other rows of its label; per anchor and positive the ``negatives`` highest-scoring rows of other
    labels from ``low`` to ``high`` per cent of the positive's score.
    """
    rows = stored(packed_rows(vectors, scale), "packed-vectors")
    anchors = rows.where(is_anchor)
    same = met(anchors, rows, ["dim", "label"], anchor_rows, cell_rows, pick_positives(positives), POSITIVES)
    best = ranked(same, ["anchor_id"], "positive_score", "positive_id", positives)
    windows = best.groupBy(F.col("anchor_id").alias("row_id")).agg(
        F.collect_list(F.struct("positive_id", "positive_score")).alias("positives")
    )
    asking = stored(anchors.join(windows, "row_id"), "anchors-with-positives")
    found = met(asking, rows, ["dim"], anchor_rows, cell_rows, pick_negatives(negatives, low, high), NEGATIVES)
    return ranked(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def noisy_labels(embeddings: DataFrame) -> DataFrame:
    """The table ``embeddings`` with every seventh label moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return embeddings.select(F.col("vec_id").alias("row_id"), moved.alias("label"), F.col("embedding").alias("vector"))


SQL = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
    CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT same
  AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
