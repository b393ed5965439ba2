"""Repeated passages of ``length`` bytes: maximal repeats from common-prefix interval trees, and their removal.

Anchors. Among the ``GRAM``-byte strings of a window of ``length`` bytes the one with the smallest hash (the first on
ties) is the window's anchor. Equal windows have their anchor at the same place, so two windows can only be equal when
they hang on equal anchors. Consecutive windows with one anchor form a unit: the anchor's left and right bytes, up to
``length`` on the right and less on the left. Every window belongs to exactly one unit, there is a unit about every
170 bytes, and only units whose anchor string occurs elsewhere are looked at further.

Equal units are aggregated first, with one representative: all windows of a unit that occurs twice are repeats. What
is left are different units on one anchor string. Their right sides, sorted, are a suffix array of that string; with
the common prefixes of neighbours a stack scan visits its interval tree. All units below an interval share ``r`` bytes
on the right. Sorting their left sides the same way gives, by a second scan, the groups that share ``l`` bytes on the
left: with ``l + r >= length`` such a group is a maximal repeat (its members differ on the next byte of both sides,
which the two scans test), listed with all its members, and each member's windows inside it are repeats.

A string with more than ``max_units`` different units is not gathered: each of their windows becomes a row, windows
that occur twice are found by counting, and the rows are joined back. The result is the same.

Texts are UTF-8 bytes; null texts are empty. Documents shorter than ``length`` have no window and stay whole. Windows
never cross documents. Repeated rows and rows with equal texts repeat each other. Rows of one id with other texts, and
rows with a null id, are told apart by their text. An empty table gives an empty result. Only ``doc_id`` and ``text``
are read; ``without_repeats`` passes other columns on unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.tables import fresh, id_number, shuffle_partitions, stored
from dossier.llm.words import encoded, mix, prefix_hash, slabs, span_hash

GRAM = 64
PIECE = 1 << 20


# --- units -----------------------------------------------------------------------------------------------------------


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every run of ``width`` values."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def window_anchors(prefix: np.ndarray, windows: int, length: int) -> np.ndarray:
    """Place of the anchor of every one of the first windows of a buffer."""
    at = np.arange(windows + length - GRAM)
    keyed = (span_hash(prefix, at, at + GRAM) & ~np.uint64(0xFFFFFFFF)) | at.astype(np.uint64)
    return (sliding_min(keyed, length - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def units(texts: list[bytes], length: int) -> dict[str, np.ndarray]:
    """All units of the texts: text, place of the anchor, first and last window start, hashes of anchor and unit.

    The bytes are read in pieces; a unit that reaches the end of a piece is read again with the next one.
    """
    buffer = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes) - sizes
    total, at = len(buffer) - length + 1, 0
    found: list[dict[str, np.ndarray]] = []
    while at < total:
        stop = min(at + PIECE, total)
        prefix = prefix_hash(buffer[at : stop + length - 1])
        start = np.arange(at, stop)
        text = np.searchsorted(begin, start, "right") - 1
        valid = np.flatnonzero(start + length <= (begin + sizes)[text])
        anchor = window_anchors(prefix, stop - at, length)[valid]
        new = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1]))) if len(valid) else valid
        until = np.concatenate((new[1:], [len(valid)]))[: len(new)] - 1
        following = stop
        if stop < total and len(new) and valid[-1] == stop - at - 1:
            following = at + int(valid[new[-1]])
            new, until = new[:-1], until[:-1]
        first, last, place, text = valid[new], valid[until], anchor[new], text[valid[new]]
        shape = (place - first).astype(np.uint64) * np.uint64(1 << 20) + (last + length - place).astype(np.uint64)
        own = begin[text] - at
        found.append(
            {
                "text": text,
                "place": place - own,
                "first": first - own,
                "last": last - own,
                "anchor": span_hash(prefix, place, place + GRAM).view(np.int64),
                "unit": mix(span_hash(prefix, first, last + length) ^ mix(shape)).view(np.int64),
            }
        )
        at = following
    names = ("text", "place", "first", "last", "anchor", "unit")
    return {k: np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in names}


UNITS = "doc long, text_hash long, place long, first long, last long, anchor long, unit long"


def unit_rows(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            doc, text_hash = batch["doc"].to_numpy(), batch["text_hash"].to_numpy()
            for first, slab in slabs(batch["text"], PIECE):
                rows = units(slab, length)
                text = rows.pop("text") + first
                yield pd.DataFrame({"doc": doc[text], "text_hash": text_hash[text]} | rows)

    return run


# --- interval trees --------------------------------------------------------------------------------------------------


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] == b[:low], a[:high] != b[:high]
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def intervals(strings: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """(common prefix, first, stop) of all intervals of sorted strings in which neighbours share more than outside."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(strings) + 1):
        shared = common(strings[i - 1], strings[i]) if i < len(strings) else -1
        first = i - 1
        while stack and stack[-1][0] > shared:
            depth, first = stack.pop()
            yield depth, first, i
        if shared >= 0 and (not stack or stack[-1][0] < shared):
            stack.append((shared, first))


def maximal_repeats(lefts: list[bytes], rights: list[bytes], length: int) -> Iterator[tuple[int, int, list[int]]]:
    """(bytes on the left, bytes on the right, members) of the maximal repeats of ``length`` or more around an anchor.

    ``lefts`` are the bytes before the anchor, backwards. A group is reported where its members differ on the next
    byte of both sides (or end): a larger group with the same bytes or the same group with more bytes replaces it.
    """
    order = sorted(range(len(rights)), key=rights.__getitem__)
    for right, first, stop in intervals([rights[i] for i in order]):
        members = sorted(order[first:stop], key=lefts.__getitem__)
        for left, a, b in intervals([lefts[i] for i in members]):
            group = members[a:b]
            if left + right >= length:
                ends = {rights[i][right : right + 1] or None for i in group}
                if len(ends) > 1 or None in ends:
                    yield left, right, group


def covered(lefts: list[bytes], rights: list[bytes], length: int) -> list[set[tuple[int, int]]]:
    """Of each unit, the ranges of its repeated windows, as least and most bytes before the anchor."""
    out: list[set[tuple[int, int]]] = [set() for _ in lefts]
    for left, right, group in maximal_repeats(lefts, rights, length):
        for i in group:
            out[i].add((length - right, left))
    return out


def merged(ranges) -> list[tuple[int, int]]:
    """Closed ranges, joined where they touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


RANGES = "anchor long, unit long, low int, high int"


def whole_groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Batches sorted by ``key``, cut so that no key is in two of them."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = batch[key].to_numpy()
        cut = int(np.searchsorted(keys, keys[-1])) if keys[0] <= keys[-1] else 0
        if cut:
            yield pd.concat([*held, batch.iloc[:cut]])
            held = [batch.iloc[cut:]]
        elif held and held[-1][key].iloc[-1] != keys[0]:
            yield pd.concat(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pd.concat(held)


def group_ranges(length: int):
    """Repeated windows of units that share an anchor; the rows of an anchor stand together."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_groups(batches, "anchor"):
            anchors, unit = rows["anchor"].to_numpy(), rows["unit"].to_numpy()
            lefts, rights = rows["left_side"].tolist(), rows["right_side"].tolist()
            border = np.flatnonzero(np.concatenate(([True], anchors[1:] != anchors[:-1], [True])))
            out = []
            for a, b in zip(border[:-1], border[1:], strict=True):
                found = covered(lefts[a:b], rights[a:b], length)
                out += [(anchors[a], unit[a + i], lo, hi) for i, own in enumerate(found) for lo, hi in merged(own)]
            yield pd.DataFrame(out, columns=["anchor", "unit", "low", "high"])

    return run


def window_rows(length: int):
    """One row for each window of a unit: what a string with very many units is split into."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for anchor, unit, left, right in zip(
                batch["anchor"], batch["unit"], batch["left_side"], batch["right_side"], strict=True
            ):
                text = left[::-1] + right
                prefix = prefix_hash(np.frombuffer(text, np.uint8))
                start = np.arange(len(text) - length + 1)
                yield pd.DataFrame(
                    {
                        "anchor": anchor,
                        "unit": unit,
                        "before": (len(left) - start).astype(np.int32),
                        "window": span_hash(prefix, start, start + length).view(np.int64),
                    }
                )

    return run


def joined_ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = [
            (r.anchor, r.unit, lo, hi)
            for r in batch.itertuples()
            for lo, hi in merged((int(x), int(x)) for x in r.before)
        ]
        yield pd.DataFrame(out, columns=["anchor", "unit", "low", "high"])


# --- the distributed job ---------------------------------------------------------------------------------------------


def sides(length: int):
    """The two sides of the wanted units of a document: bytes before the anchor, backwards, and from the anchor on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, wanted in zip(batch["text"], batch["wanted"], strict=True):
                data = encoded(text)
                for w in wanted:
                    place = w["place"]
                    left, right = data[w["first"] : place][::-1], data[place : w["last"] + length]
                    out.append((w["anchor"], w["unit"], w["n_units"], left, right))
            yield pd.DataFrame(out, columns=["anchor", "unit", "n_units", "left_side", "right_side"])

    return run


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc"),
        F.xxhash64(F.col("text")).alias("text_hash"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def repeated_spans(docs: DataFrame, length: int = 400, max_units: int = 2000) -> DataFrame:
    """doc, text_hash and the sorted byte spans (start, stop) covered by repeated strings of ``length`` bytes.

    ``docs`` as :func:`keyed` gives them. A document has a row only when it has a span.
    """
    found = docs.filter(F.octet_length("text") >= length).mapInPandas(unit_rows(length), UNITS)
    found = stored(found, "suffix-units")
    occurrence = F.struct("doc", "text_hash", "place", "first", "last")
    distinct = stored(
        found.groupBy("anchor", "unit").agg(F.count(F.lit(1)).alias("n"), F.min(occurrence).alias("at")), "suffix-distinct"
    )
    several = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("n_units")).filter("n_units > 1")
    # Of units that occur once, some windows may be repeats; those that occur twice only serve to be compared with.
    wanted = distinct.join(several, "anchor").select("anchor", "unit", "n_units", "at.*")
    by_doc = wanted.groupBy("doc", "text_hash").agg(
        F.collect_list(F.struct("anchor", "unit", "n_units", "place", "first", "last")).alias("wanted")
    )
    texts = docs.join(by_doc, ["doc", "text_hash"]).select("wanted", "text")
    schema = "anchor long, unit long, n_units long, left_side binary, right_side binary"
    # Rows that are equal in id and text bring the same unit twice.
    compared = stored(texts.mapInPandas(sides(length), schema), "suffix-sides")
    small = compared.filter(F.col("n_units") <= max_units).dropDuplicates(["anchor", "unit"])
    parts = shuffle_partitions(docs)
    small = small.repartition(parts, "anchor").sortWithinPartitions("anchor")
    ranges = small.mapInPandas(group_ranges(length), RANGES)
    large = compared.filter(F.col("n_units") > max_units)
    windows = large.mapInPandas(window_rows(length), "anchor long, unit long, before int, window long")
    key = ["anchor", "before", "window"]
    twice = windows.groupBy(*key).agg(F.min("unit").alias("a"), F.max("unit").alias("b")).filter("a <> b").select(*key)
    hits = windows.join(twice, key).groupBy("anchor", "unit").agg(F.collect_set("before").alias("before"))
    ranges = ranges.unionByName(hits.mapInPandas(joined_ranges, RANGES))
    full = distinct.filter("n > 1").select(
        "anchor",
        "unit",
        (F.col("at.place") - F.col("at.last")).cast("int").alias("low"),
        (F.col("at.place") - F.col("at.first")).cast("int").alias("high"),
    )
    ranges = ranges.unionByName(full)
    spans = found.join(ranges, ["anchor", "unit"]).select(
        "doc",
        "text_hash",
        F.struct((F.col("place") - F.col("high")).alias("a"), (F.col("place") - F.col("low") + length).alias("b")).alias("s"),
    )
    return spans.groupBy("doc", "text_hash").agg(F.array_sort(F.collect_set("s")).alias("spans"))


def joined_spans(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in spans if spans is not None else ():
        if out and s["a"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["b"])
        else:
            out.append([s["a"], s["b"]])
    return [(a, b) for a, b in out]


def rest_of(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *[b for _, b in spans]]
    starts = [*[a for a, _ in spans], len(data)]
    return b"".join(data[a:b] for a, b in zip(ends, starts, strict=True))


def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for text, found in zip(batch["text"], batch["spans"], strict=True):
            data, spans = encoded(text), joined_spans(found)
            digest = hashlib.sha256(rest_of(data, spans)).hexdigest()
            out.append((len(data), sum(b - a for a, b in spans), len(spans), digest))
        told = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"], index=batch.index)
        yield pd.concat([batch[["doc_id"]], told], axis=1)


def removal_report(docs: DataFrame, length: int = 400, max_units: int = 2000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    found = repeated_spans(keyed(docs), length, max_units)
    own: Column = F.col("doc_id").cast("long")
    rows = docs.select(
        own.cast("string").alias("doc_id"),
        F.coalesce(own, F.lit(0)).alias("doc"),
        F.xxhash64("text").alias("text_hash"),
        "text",
    )
    joined = rows.join(found, ["doc", "text_hash"], "left").select("doc_id", "text", "spans")
    schema = "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return joined.mapInPandas(digests, schema).withColumn("doc_id", id_number())


def cut_texts(text: int):
    """Texts (column number ``text``) without the spans in the last column, which goes.

    A character of which a part is in a span goes as a whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, last = batch.column(text).to_pylist(), batch.num_columns - 1
            for i, found in enumerate(batch.column(last).to_pylist()):
                if found:
                    texts[i] = rest_of(encoded(texts[i]), joined_spans(found)).decode("utf-8", "ignore")
            columns = [pa.array(texts, pa.string()) if c == text else batch.column(c) for c in range(last)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:last])

    return run


def without_repeats(docs: DataFrame, length: int = 400, max_units: int = 2000) -> DataFrame:
    """All rows and columns of ``docs``, with repeated strings cut from the texts; other columns are as they were."""
    found = repeated_spans(keyed(docs), length, max_units)
    doc, text_hash, spans = (fresh(docs, name) for name in ("_doc", "_hash", "_spans"))
    found = found.select(F.col("doc").alias(doc), F.col("text_hash").alias(text_hash), F.col("spans").alias(spans))
    same = (F.coalesce(docs["doc_id"].cast("long"), F.lit(0)) == found[doc]) & (
        F.xxhash64(docs["text"]) == found[text_hash]
    )
    joined = docs.join(found, same, "left").select(*[docs[c] for c in docs.columns], found[spans])
    return joined.mapInArrow(cut_texts(docs.columns.index("text")), docs.schema)
