"""Signature search, token files and hard negatives against brute-force versions."""

import glob
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dossier.llm import hard_negatives, signature_search, token_files

public_tokenizers = pytest.importorskip("public_tokenizers")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


# 11 --------------------------------------------------------------------------------------------------------------


def found_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked_plainly(rows, items, k):
    """(item_id, rank, doc_id, score) by scoring every document for every item."""
    counted = [(doc_id, Counter(found_terms(text))) for doc_id, text in rows]
    counted = [(d, c) for d, c in counted if c]
    n_docs, words = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * v + 1))) for t, v in df.items()}
    out = []
    for item_id, text in {(i, t) for i, t in items if t is not None}:
        asked = Counter(found_terms(text))
        scores = []
        for doc_id, c in counted:
            m = 25 + (75 * sum(c.values()) * n_docs) // words
            score = sum(weight[t] * q * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in asked.items() if t in c)
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def items_of(rows_in):
    picked = [rows_in[i][1] for i in (3, 20, 44)]
    items = [(i, " ".join(t.split(" ")[5:40])) for i, t in enumerate(picked)]
    items += [(3, None), (4, ""), (5, "nothing-of-this qqqzzz"), (6, "Ñandú ÜBERFLUSS überfluß ETE été"), (6, "one two")]
    items += [(None, "three FOUR four"), (None, "three FOUR four"), (7, picked[0] + " " + picked[1] * 3)]
    return items


@pytest.mark.parametrize("group_terms", [16_384, 40])
def test_search_equals_scoring_everything(spark, docs, rows_in, group_terms):
    items = items_of(rows_in)
    table = spark.createDataFrame([(*i, "clash") for i in items], "item_id long, text string, item string")
    index = signature_search.build_index(docs)
    got = signature_search.search(index, table, 10, group_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    # Items of one id are told apart by their text only, so compare them as a bag of rows.
    got = sorted((tuple(r) for r in got.collect()), key=repr)
    assert got == ranked_plainly([(r[0], r[1]) for r in rows_in], items, 10)


def test_search_of_nothing(spark, docs, no_docs):
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert signature_search.search(signature_search.build_index(no_docs), items).count() == 0
    assert signature_search.search(signature_search.build_index(docs), items.limit(0)).count() == 0


def test_bounds_never_fall_below_scores():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 300))).encode() for _ in range(150)]
    terms, counts, border, sizes = signature_search.term_counts(texts)
    asked = [signature_search.term_counts([" ".join(rng.sample(words, 12)).encode()])[0] for _ in range(20)]
    rows = [(str(i), [(int(t.view(np.int64)), 1 + 997 * j) for j, t in enumerate(a)]) for i, a in enumerate(asked)]
    group = signature_search.Group(rows, len(texts), int(sizes.sum()), 5)
    m = 25 + (75 * sizes * len(texts)) // sizes.sum()
    gains = np.zeros((len(texts), len(group.terms)), np.int32)
    group.read(texts, np.arange(len(texts)), m, gains)
    most = np.maximum.reduceat(counts, border[:-1])
    tight = 0
    for bits in (256, 4096):
        bounds = group.bounds(bits, signature_search.bit_slices(terms, counts, border, bits), m, most)
        exact = np.stack([gains[:, at].astype(np.int64) @ w for at, w in zip(group.at, group.weights)])
        assert (bounds >= exact).all()
        tight = (bounds - exact).mean() if bits == 256 else tight
    assert (bounds - exact).mean() < tight


def test_most_texts_are_not_read_again():
    """A block whose documents cannot reach the items' kept scores is passed over."""
    rng = random.Random(6)
    common, rare = [f"c{i}" for i in range(50)], [f"rare{i}" for i in range(10)]
    read = []

    class Watched(signature_search.Group):
        def read(self, texts, rows, m, gains):
            read.append(len(rows))
            super().read(texts, rows, m, gains)

    import pyarrow as pa

    term = signature_search.term_counts([" ".join(rare).encode()])[0]
    group = Watched([("i", [(int(t.view(np.int64)), 9000) for t in term])], 4000, 4000 * 40, 3)
    for block in range(4):
        texts = [" ".join(rng.choices(common, k=40) + (rare if block == 0 and i < 3 else [])) for i in range(1000)]
        batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(texts)], names=["doc_id", "text"])
        for row in signature_search.indexing([batch]):
            if row.column("docs")[0].is_valid:
                values = [row.column(c)[0] for c in ("bits", "slices", "docs", "words", "most", "texts")]
                sizes, most = (np.asarray(values[c].values, np.int64) for c in (3, 4))
                group.block(values[0].as_py(), values[1].as_buffer(), values[2].as_py(), sizes, most, values[5].values)
    assert len(group.kept[0]) == 3 and sum(read) < 100


# 12 --------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def id_files(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ids") / "files")
    token_files.write_ids(docs, path, parts=4, page_bytes=1 << 12)
    return path


def ids_plainly(rows_in):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [(r[0], [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in rows_in]


def test_files_hold_the_ids_in_order(spark, docs, rows_in, id_files):
    got = token_files.report(spark, id_files).collect()
    want = ids_plainly(rows_in)
    sums = [(d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for d, ids in want]
    assert sorted((tuple(r[c] for c in ("doc_id", "n_tokens", "ids_crc32")) for r in got), key=repr) == sorted(sums, key=repr)
    got.sort(key=lambda r: r["start"])
    assert [r["start"] for r in got] == [0, *itertools.accumulate(r["n_tokens"] for r in got)][:-1]
    order = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
    assert order == sorted(order)
    again = token_files.encode_and_report(docs).orderBy("start").collect()
    assert [tuple(r) for r in again] == [tuple(r) for r in got]


def test_spans_and_documents_read_selectively(spark, rows_in, id_files):
    by_id = {d: ids for d, ids in ids_plainly(rows_in)}
    two = {r["doc_id"]: r["ids"] for r in token_files.read_documents(spark, id_files, [5, 62]).collect()}
    assert two == {5: by_id[5], 62: by_id[62]}
    whole = token_files.report(spark, id_files).orderBy("start").collect()
    total = sum(r["n_tokens"] for r in whole)
    spans = [token_files.read_span(spark, id_files, a, a + 5000).orderBy("place").collect() for a in range(0, total, 5000)]
    glued = [x for span in spans for r in span for x in r["ids"]]
    assert len(glued) == total
    at = next(r["start"] for r in whole if r["doc_id"] == 62)
    assert glued[at : at + len(by_id[62])] == by_id[62]
    places = [(r["place"], len(r["ids"])) for span in spans for r in span]
    assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(places))
    assert token_files.read_span(spark, id_files, total, total + 9).count() == 0


def test_layout_of_the_files(spark, id_files):
    column = next(
        pq.ParquetFile(f).metadata.row_group(0) for f in sorted(glob.glob(f"{id_files}/*.parquet")) if pq.ParquetFile(f).metadata.num_rows
    )
    columns = {column.column(i).path_in_schema: column.column(i) for i in range(column.num_columns)}
    assert "RLE_DICTIONARY" in columns["ids.list.element"].encodings
    assert all("DELTA_BINARY_PACKED" in columns[c].encodings for c in ("doc_id", "start", "n_tokens"))
    assert all(c.has_column_index and c.has_offset_index for c in columns.values())
    plan = token_files.read_metadata(spark, id_files)._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1].split(">")[0]
    plan = token_files.read_documents(spark, id_files, [5])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,5)" in plan or "In(doc_id, [5])" in plan


def test_files_of_no_documents(spark, no_docs):
    assert token_files.encode_and_report(no_docs).count() == 0


def test_remembered_pieces_are_let_go(monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 50)
    encoder = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [" ".join(f"word{i * 7 + j}" for j in range(30)) for i in range(20)]
    texts += ["a  b", " a", "a ", "a b\n", "a b\n c", "a <|endoftext|> b", "a<|endoftext|>b c", " ", "\n", "a\n b", "a  b", "", "x" * 500, "a\nb c"]
    whole = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert [encoder.encode([t])[0] for t in texts] == whole and encoder.encode(texts) == whole
    assert len(encoder.hashes) <= 700


# 13 --------------------------------------------------------------------------------------------------------------


def test_lookups_are_inner_products():
    rng = np.random.default_rng(7)
    for dim, largest in ((1, 3), (8, 256), (13, 1 << 22), (64, 300)):
        rows = rng.integers(-largest, largest + 1, (50, dim))
        rows[0], rows[1] = 0, -1
        anchors = rng.integers(-largest, largest + 1, (9, dim))
        bits, code = hard_negatives.planes(rows.astype(np.int32))
        assert (hard_negatives.unplaned(code, dim) == rows).all()
        assert (hard_negatives.inner_products(hard_negatives.subset_sums(anchors, np.int64), code) == rows @ anchors.T).all()
        for row, need in zip(rows, bits):
            assert -(1 << need - 1) <= row.min() and row.max() < 1 << need - 1


def vectors_in():
    rng = random.Random(8)
    rows = []
    for i in range(420):
        label = 0 if i % 3 == 0 else i % 5
        vector = [rng.gauss(0.1 * (label == j % 5), 0.2) + 0.1 for j in range(11)]
        rows.append((i, label, vector))
    rows += [(420 + i, 1, list(rows[17][2])) for i in range(30)]  # ties
    rows += [(500, None, rows[0][2]), (501, 1, None), (600, 1, [None] * 11), (601, 2, [float("nan")] * 11)]
    rows += [(700, 2, [float("inf")] + [0.1] * 10), (701, 2, [1e30] * 11), (702, 2, []), (None, 1, rows[3][2])]
    rows += [(800 + i, i % 2, [0.5, 0.25 * (i % 7), 0.1 * i]) for i in range(12)]  # another length
    rows += [(900, 3, [-0.5] * 11), (1000, 4, [0.0] * 11), rows[100], rows[101]]  # negative scores, zeros, repeats
    rows += [(200, 9, [9.0] * 11)]  # an id with another row: the lesser counts
    return rows


def mined_plainly(rows):
    taken = {}
    for i, label, vector in rows:
        if i is None or label is None or not vector or any(x is None or not math.isfinite(x) or abs(x) > 1e4 for x in vector):
            continue
        value = (label, [math.floor(256 * x) for x in vector])
        taken[i] = min(taken.get(i, value), value)
    out = []
    for a in (i for i in taken if i % 100 == 0):
        label, own = taken[a]
        score = {
            i: sum(x * y for x, y in zip(own, v)) for i, (_, v) in taken.items() if i != a and len(v) == len(own)
        }
        best = sorted((-s, i) for i, s in score.items() if taken[i][0] == label)[:5]
        for minus, positive in best:
            inside = sorted((-s, i) for i, s in score.items() if taken[i][0] != label and 30 * -minus <= 100 * s <= 90 * -minus)
            out += [(a, positive, rank, i, -minus, -s) for rank, (s, i) in enumerate(inside[:10], 1)]
    return sorted(out)


@pytest.mark.parametrize("anchor_rows, cell_rows", [(512, 4096), (2, 40)])
def test_negatives_equal_scoring_everything(spark, anchor_rows, cell_rows):
    rows = vectors_in()
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "row_id long, label int, vector array<double>, a string, dim int")
    got = hard_negatives.mine(table, F.col("row_id") % 100 == 0, anchor_rows=anchor_rows, cell_rows=cell_rows)
    assert sorted(tuple(r) for r in got.collect()) == mined_plainly(rows)


def test_negatives_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(hard_negatives.noisy_labels(none), F.col("row_id") % 100 == 0).count() == 0


def test_every_seventh_label_moves(spark):
    rows = spark.createDataFrame([(7, [1.0], 9), (8, [1.0], 9), (None, [1.0], 3)], "vec_id long, embedding array<float>, label int")
    assert [r["label"] for r in hard_negatives.noisy_labels(rows).collect()] == [0, 9, 3]
