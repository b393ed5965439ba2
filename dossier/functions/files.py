"""Text of one file's bytes, by signature first and by name second."""

from __future__ import annotations

import codecs
import io
import re
import zipfile
from datetime import datetime, timedelta
from xml.etree import ElementTree

from dossier.functions.markup import compact

# Size limits of an office archive, formats, and frequent Russian letter groups.
MEMBER_BYTES = 64 * 1024 * 1024
TOTAL_BYTES = 256 * 1024 * 1024
RATIO_FLOOR, MAX_RATIO = 1_048_576, 1_000
SUPPORTED = (".txt", ".md", ".doc", ".docx", ".rtf", ".pdf", ".xlsx", ".pptx", ".xls", ".html", ".htm", ".xml", ".csv", ".json")
RU_GROUPS = (
    "про", "ени", "ого", "ост", "ние", "ств", "при", "зак", "тех",
    "док", "ени", "ова", "ани", "тер", "тор", "пол", "ель", "раб",
)
_RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
OFFICE_MEMBERS = {"word/document.xml": ".docx", "xl/workbook.xml": ".xlsx", "ppt/presentation.xml": ".pptx"}


# Byte-order marks, longest first.
MARKS = (
    (codecs.BOM_UTF32_LE, "utf-32"),
    (codecs.BOM_UTF32_BE, "utf-32"),
    (codecs.BOM_UTF16_LE, "utf-16"),
    (codecs.BOM_UTF16_BE, "utf-16"),
    (codecs.BOM_UTF8, "utf-8-sig"),
)


class Refused(ValueError):
    """An archive that expands too far to be read."""


def decode(content: bytes) -> str:
    """The text by its byte-order mark, as UTF-8, or in the Cyrillic charset that makes more of its letter groups known."""
    for mark, charset in MARKS:
        if content.startswith(mark):
            return content.decode(charset, "replace")
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        known = {}
        for charset, lead in (("cp1251", 1), ("koi8-r", 0)):
            text = content.decode(charset, "replace")
            known[text] = sum(map(text.lower().count, RU_GROUPS)) + lead
        return max(known, key=known.get)


class Package:
    """An office archive: its members, and what its main member says it is."""

    def __init__(self, content: bytes) -> None:
        self.archive = zipfile.ZipFile(io.BytesIO(content))
        self.sizes = {m.filename: (m.file_size, m.compress_size) for m in self.archive.infolist()}
        self.kind = next((kind for member, kind in OFFICE_MEMBERS.items() if member in self.sizes), None)

    def check(self) -> None:
        """Refuse an archive of which a member, its rate of packing, or the whole is beyond the limits."""
        whole = sum(size for size, _ in self.sizes.values())
        swollen = any(size > MEMBER_BYTES or RATIO_FLOOR < size > MAX_RATIO * max(packed, 1) for size, packed in self.sizes.values())
        if swollen or whole > TOTAL_BYTES:
            raise Refused("archive expands too far")

    def __contains__(self, member: str) -> bool:
        return member in self.sizes

    def root(self, member: str):
        data = self.archive.read(member)
        if re.search(rb"<!(DOCTYPE|ENTITY)", data, re.IGNORECASE):
            raise ValueError("document types are not read")
        return ElementTree.fromstring(data)

    def targets(self, member: str) -> dict[str, str]:
        """Relationship id -> target of the member's relationships; none when it has none."""
        folder, _, name = member.rpartition("/")
        relations = f"{folder}/_rels/{name}.rels"
        return {n.get("Id"): n.get("Target", "") for n in _all(self.root(relations), "Relationship")} if relations in self else {}


def package(content: bytes) -> Package | None:
    try:
        return Package(content) if content.startswith(b"PK") else None
    except (OSError, zipfile.BadZipFile):
        return None


def sniff(content: bytes) -> str | None:
    if content.startswith(b"%PDF-"):
        return ".pdf"
    found = package(content)
    return found.kind if found else None


def _local(node) -> str:
    return node.tag.rsplit("}", 1)[-1]


def _all(node, name: str) -> list:
    return [n for n in node.iter() if _local(n) == name]


def _said(node) -> str:
    return "".join(n.text or "" for n in _all(node, "t"))


def _grid(table, cell_text) -> list[list[str]]:
    """Cell texts of a table, row by row."""
    return [[cell_text(c) for c in row if _local(c) == "tc"] for row in table if _local(row) == "tr"]


def docx(content: bytes) -> str:
    """Paragraphs and tables of the body, in order; a table row is one line of its filled cells."""
    found = Package(content)
    found.check()
    (body, *_) = [*_all(found.root("word/document.xml"), "body"), ()]
    cell = lambda c: _said(c).strip()
    read = {
        "p": lambda block: [_said(block).strip()],
        "tbl": lambda block: ["\t".join(filter(None, row)) for row in _grid(block, cell)],
    }
    return "\n".join(line for block in body if _local(block) in read for line in read[_local(block)](block) if line)


def pptx(content: bytes) -> str:
    """Slides in the order of the presentation, then by number: the paragraphs of shapes, and table rows."""
    found = Package(content)
    found.check()
    number = {n: int(m.group(1)) for n in found.sizes if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n))}
    place: dict[str, int] = {}
    if "ppt/presentation.xml" in found:
        targets = found.targets("ppt/presentation.xml")
        for shown in _all(found.root("ppt/presentation.xml"), "sldId"):
            place.setdefault("ppt/slides/" + targets.get(shown.get(f"{{{_RELS}}}id"), "").rsplit("/", 1)[-1], len(place))
    cell = lambda c: " ".join(map(_said, _all(c, "p"))).strip()

    def said(node) -> list[str]:
        if _local(node) == "tbl":
            return ["\t".join(row) for row in _grid(node, cell) if any(row)]
        if _local(node) == "sp":
            return [line for body in node if _local(body) == "txBody" for p in _all(body, "p") if (line := _said(p).strip())]
        return []

    lines: list[str] = []
    for nth, name in enumerate(sorted(number, key=lambda n: (place.get(n, len(place)), number[n])), start=1):
        told = [line for node in found.root(name).iter() for line in said(node)]
        lines += [f"=== Slide {nth} ({name}) ===", *told] if told else []
    return "\n".join(lines)


# Built-in number formats that show dates or times.
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])


def _date_styles(found: Package) -> set[int]:
    if "xl/styles.xml" not in found:
        return set()
    root = found.root("xl/styles.xml")
    own = {int(n.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", n.get("formatCode", "")) for n in _all(root, "numFmt")}
    dates = DATE_FORMATS | {i for i, code in own.items() if re.search("[dmyhs]", code, re.I)}
    cells = next(iter(_all(root, "cellXfs")), [])
    return {i for i, xf in enumerate(cells) if int(xf.get("numFmtId", "0")) in dates}


def _cell(cell, shared: list[str], dates: set[int]) -> str:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return _said(cell)
    raw = next((n.text or "" for n in cell if _local(n) == "v"), "")
    if raw == "":
        return ""
    if kind == "s":
        return shared[int(raw)]
    if kind == "b":
        return str(raw == "1")
    if kind == "n":
        if int(cell.get("s", "0")) in dates:
            return str(datetime(1899, 12, 30) + timedelta(seconds=round(float(raw) * 86_400)))
        return str(float(raw)) if re.search("[.eE]", raw) else raw
    return raw


def _column(ref: str | None, after: int) -> int:
    letters = re.match("[A-Z]+", ref or "")
    if not letters:
        return after + 1
    number = 0
    for letter in letters.group():
        number = number * 26 + ord(letter) - 64
    return number


def xlsx(content: bytes) -> str:
    found = Package(content)
    found.check()
    shared = [_said(n) for n in _all(found.root("xl/sharedStrings.xml"), "si")] if "xl/sharedStrings.xml" in found else []
    dates, links = _date_styles(found), found.targets("xl/workbook.xml")
    lines = []
    for sheet in _all(found.root("xl/workbook.xml"), "sheet"):
        target = links.get(sheet.get(f"{{{_RELS}}}id"), "")
        member = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        if member not in found:
            continue
        rows: list[str] = []
        for row in _all(found.root(member), "row"):
            rows += [""] * (int(row.get("r", len(rows) + 1)) - len(rows) - 1)
            cells: list[str] = []
            for cell in (n for n in row if _local(n) == "c"):
                cells += [""] * (_column(cell.get("r"), len(cells)) - len(cells) - 1)
                cells.append(_cell(cell, shared, dates))
            rows.append("\t".join(cells))
        if rows:
            lines += [f"=== {sheet.get('name')} ===", *rows]
    return "\n".join(lines)


def html(content: bytes) -> str:
    text = re.sub(r"(?is)<(script|style)[^>]*>.*?</\1>", "", decode(content))
    return compact(re.sub(r"<[^>]+>", " ", text))


def _parsed(source) -> str | None:
    try:
        return ElementTree.tostring(ElementTree.fromstring(source), encoding="unicode", method="xml")
    except (ElementTree.ParseError, ValueError):
        return None


def xml(content: bytes) -> str:
    """The document parsed and written out again, so that element names survive; by its declared charset if it can be."""
    return _parsed(content) or _parsed(decode(content)) or ""


READERS = {
    ".txt": decode, ".md": decode, ".csv": decode, ".json": decode,
    ".docx": docx, ".pptx": pptx, ".xlsx": xlsx, ".html": html, ".htm": html, ".xml": xml,
}


def file_text(path: str, content: bytes | None, max_chars: int | None = None) -> tuple[str, str, str]:
    """(format, status, text): extracted, empty, unsupported, refused (an archive that expands too far) or failed.

    PDF pages and the legacy binary formats need external converters; they come out empty here.
    """
    if content is None:
        return "", "failed", ""
    suffix = re.search(r"\.[A-Za-z0-9]+$", path.rsplit("/", 1)[-1])
    kind = sniff(content) or (suffix.group().lower() if suffix else "")
    if not content:
        return kind, "empty", ""
    text = ""
    if kind in READERS:
        try:
            text = READERS[kind](content)
        except Refused:
            return kind, "refused", ""
        except Exception:  # noqa: BLE001 - a damaged file must not end the job
            text = ""
    if text.strip():
        return kind, "extracted", text if max_chars is None else text[:max_chars]
    return kind, "empty" if kind in SUPPORTED else "unsupported", text
