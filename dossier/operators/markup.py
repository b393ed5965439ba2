"""Stored pages to rows: links, page signals, field signals and offer cards."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions import markup as mk
from dossier.functions.urls import canonical
from dossier.operators.blocks import PART, in_parts, kind_of, spread


def _rows(
    df: DataFrame, key: str, text: str, fields: list[tuple[str, pa.DataType, str]], read, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Flat-map ``read(text, *kept values) -> tuples`` by Arrow batch; ``keep`` columns ride along, no shuffle."""
    own = [key, *keep]
    schema = ", ".join([*(f"{c} {kind_of(df, c)}" for c in own), *(f"{name} {kind}" for name, _, kind in fields)])

    def run(batches):
        for batch in in_parts(batches, PART):
            place, out = [], []
            kept = [batch.column(i).to_pylist() for i in range(1, len(own))]
            for row, value in enumerate(batch.column(len(own)).to_pylist()):
                for item in read(value, *[c[row] for c in kept]):
                    place.append(row)
                    out.append(item)
            columns = [batch.column(i).take(pa.array(place, pa.int64())) for i in range(len(own))]
            for number, (_, arrow, _) in enumerate(fields):
                columns.append(pa.array([item[number] for item in out], arrow))
            yield pa.RecordBatch.from_arrays(columns, names=[*own, *[f[0] for f in fields]])

    return spread(df.select(*own, text), key).mapInArrow(run, schema)


_TEXT, _INT, _DOUBLE = pa.string(), pa.int32(), pa.float64()


def extract_anchors(pages: DataFrame, key: str = "page_id", html: str = "html", limit: int | None = None) -> DataFrame:
    """key, base_href, pos, href, text, rel for every link of every page, in document order."""

    def read(value):
        base, found = mk.anchors(value, limit)
        return [(base, place, href, text, rel) for place, (href, text, rel) in enumerate(found)]

    fields = [
        ("base_href", _TEXT, "string"),
        ("pos", _INT, "int"),
        ("href", _TEXT, "string"),
        ("text", _TEXT, "string"),
        ("rel", pa.list_(_TEXT), "array<string>"),
    ]
    return _rows(pages, key, html, fields, read)


def canonical_links(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", limit: int | None = None
) -> DataFrame:
    """key, source, pos, url, text, rel: links resolved against the page (or its base) and made canonical."""

    def read(value, address):
        source = canonical(address, address)
        if source is None:
            return []
        base, found = mk.anchors(value, limit)
        base = (canonical(source, base) if base else None) or source
        links = [(place, canonical(base, href), text, rel) for place, (href, text, rel) in enumerate(found)]
        return [(source, place, link, text, rel) for place, link, text, rel in links if link]

    fields = [
        ("source", _TEXT, "string"),
        ("pos", _INT, "int"),
        ("url", _TEXT, "string"),
        ("text", _TEXT, "string"),
        ("rel", pa.list_(_TEXT), "array<string>"),
    ]
    own = pages.select(key, F.col(url).alias("__address"), html)
    return _rows(own, key, html, fields, read, keep=("__address",)).drop("__address")


def page_signals(pages: DataFrame, key: str = "page_id", html: str = "html", limit: int | None = None) -> DataFrame:
    """Title, h1, description and visible text per page."""
    fields = [(n, _TEXT, "string") for n in ("title", "h1", "meta_description", "visible_text")]
    return _rows(pages, key, html, fields, lambda value: [mk.page_signals(value, limit)])


_SIGNAL = [
    ("name", _TEXT, "string"),
    ("value_json", _TEXT, "string"),
    ("confidence", _DOUBLE, "double"),
    ("kind", _TEXT, "string"),
    ("source_ref", _TEXT, "string"),
    ("excerpt", _TEXT, "string"),
]


def _signal(row: tuple) -> tuple:
    name, value, confidence, kind, ref = row
    shown = value if isinstance(value, str) else str(value) if not isinstance(value, list) else mk.json.dumps(value, ensure_ascii=False)
    if isinstance(value, str):
        value = mk.compact(value)
    return name, mk.canonical_json(value), confidence, kind, ref, shown


def html_signals(assets: DataFrame, key: str = "asset_id", html: str = "html") -> DataFrame:
    """Field signals of a page: meta, itemprop, labelled elements, tables, title and JSON-LD."""

    def read(value):
        signals, blocks, _ = mk.discover(value)
        found = list(map(_signal, signals))
        for ref, block in blocks:
            found += map(_signal, mk.json_signals(block, ref))
        return found

    return _rows(assets, key, html, _SIGNAL, read)


def visible_lines(assets: DataFrame, key: str = "asset_id", html: str = "html") -> DataFrame:
    """The visible text pieces of a page as lines (input of the label-value reader)."""
    return _rows(assets, key, html, [("text", _TEXT, "string")], lambda v: [("\n".join(mk.discover(v)[2]),)])


def jsonld_signals(assets: DataFrame, key: str = "asset_id", text: str = "json", path: str = "$") -> DataFrame:
    """Signals of a JSON column, nested objects included."""
    return _rows(assets, key, text, _SIGNAL, lambda value: list(map(_signal, mk.json_signals(value, path))))


def jsonld_objects(assets: DataFrame, key: str = "asset_id", html: str = "html") -> DataFrame:
    """Every JSON-LD object of a page, one row per plain member; malformed blocks get one flagged row.

    key, block_ref, object_no, source_ref, object_type, name, value_json, object_json, malformed.
    """

    def read(value):
        rows, number = [], 0
        for ref, block in mk.discover(value)[1]:
            try:
                root = mk.json.loads(block)
            except ValueError:
                rows.append((ref, None, ref, None, None, None, None, True))
                continue
            for place, node in mk.json_nodes(root, ref):
                kind, whole = node.get("@type"), None
                for name, child in node.items():
                    if child in (None, "") or not (
                        mk._plain(child) or (isinstance(child, list) and child and all(map(mk._plain, child)))
                    ):
                        continue
                    whole = whole or mk.canonical_json(node)
                    rows.append((ref, number, place, None if kind is None else str(kind), str(name), mk.canonical_json(child), whole, False))
                number += 1
        return rows

    fields = [
        ("block_ref", _TEXT, "string"),
        ("object_no", _INT, "int"),
        ("source_ref", _TEXT, "string"),
        ("object_type", _TEXT, "string"),
        ("name", _TEXT, "string"),
        ("value_json", _TEXT, "string"),
        ("object_json", _TEXT, "string"),
        ("malformed", pa.bool_(), "boolean"),
    ]
    return _rows(assets, key, html, fields, read)
