"""Offer cards: elements that signal an offer, each grown to the largest element around it that shows one offer.

Pages are shuffled once, as they are, so that those of one key stand together; nothing else of them is written or sent.
A task reads the tree of a page into rows, matches words of the rows in columns, and reads the rows of a key again as one
group: what lies inside an element is counted by passing every mark on to the elements above it, and a card's limit is
found among the few elements above its anchor. Pages of one key meet by the numbers of their elements.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions import markup as mk
from dossier.functions.text import collapse_space
from dossier.operators.blocks import in_batches, kind_of, leveled, runs_of_keys

# Word patterns that mark offers, actions, benefits, validity and controls.
FLAGS = "(?iU)"
OFFER = (
    r"(?:скид\w*|промокод\w*|к[еэ]шб\w*|бонус\w*|бесплат\w*|подар\w*|сертификат\w*|"
    r"coupon\w*|promo\w*|discount\w*|cashback\w*|bonus\w*|sale\w*|gift\w*|"
    r"\bдо\s*\d{1,3}\s*%|[-−]\s*\d[\d\s]{0,8}\s*(?:₽|руб)|\d{1,3}\s*%)"
)
ACTION = (
    r"(?:открыть|показать|активировать|получить|применить|использовать|скопировать|"
    r"open|show|reveal|get|apply|use|copy)\s+(?:промокод\w*|код\b|акци\w*|coupon\w*|promo\w*|deal\w*)"
)
BENEFIT = (
    r"(?:скид\w*|промокод\w*|дешевле|подар\w*|бонус\w*|к[еэ]шб\w*|бесплат\w*|"
    r"discount\w*|coupon\w*|promo\w*|cashback\w*|bonus\w*|free\b|gift\w*)"
)
VALIDITY = r"(?:срок\s+действия|остал(?:ось|ись)\s+(?:дн|час)|действует\s+до|активен\s+ещ[её]|valid\s+until|expires?)"
CONTROL = (
    r"(?:добавить|предложить|разместить|submit|add|share)\s+(?:свой\s+)?"
    r"(?:промокод\w*|купон\w*|скидк\w*|offer\w*|promo\w*|coupon\w*|deal\w*)"
)
CONTACT = r"^(?:@[A-Za-z0-9_.-]+|[A-Za-z0-9_.+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|[A-Za-z0-9.-]+\.[A-Za-z]{2,})$"
OFFER_ID = r"(?i)[?&]offer_id=([^&#]+)"
CARD_WORDS = ("offer", "promo", "coupon", "deal", "discount", "card", "item", "product", "promotion")
NAVIGATION = ("nav", "header", "footer", "aside")
HEADINGS = ("h1", "h2", "h3", "h4")
ROOTS = ("html", "body")
ENDS = ("article", "li")


def _says(pattern: str) -> Column:
    return F.col("text").rlike(FLAGS + pattern)


def _attr(name: str) -> Column:
    return F.coalesce(F.try_element_at("attrs", F.lit(name)), F.lit(""))


def _first(*names: str) -> Column:
    """The first of these attributes that says something; null when none does."""
    return F.coalesce(*[F.when(_attr(n) != "", _attr(n)) for n in names])


_TEXT, _INT, _BOOL, _DOUBLE = pa.string(), pa.int32(), pa.bool_(), pa.float64()
_ATTRS = pa.map_(_TEXT, _TEXT)

_ELEMENT = [
    ("page", _INT, "int"),
    ("no", _INT, "int"),
    ("parent", _INT, "int"),
    ("path", _TEXT, "string"),
    ("tag", _TEXT, "string"),
    ("attrs", _ATTRS, "map<string,string>"),
    ("words", _TEXT, "string"),
    ("text", _TEXT, "string"),
    ("nav", _BOOL, "boolean"),
    ("link", _TEXT, "string"),
    ("root_step", _INT, "int"),
    ("may_offer", _BOOL, "boolean"),
    ("may_end", _BOOL, "boolean"),
]

# OFFER and VALIDITY match no text without one of these, letters taken as small ones.
OFFER_STEMS = (
    "скид", "промокод", "кешб", "кэшб", "бонус", "бесплат", "подар", "сертификат", "coupon", "promo", "discount", "cashback",
    "bonus", "sale", "gift", "₽", "руб",
)
PERCENT = re.compile(r"\d\s*%")
VALIDITY_STEMS = ("срок", "остал", "действует", "активен", "valid", "expire")


def may_say(page: list[dict]) -> tuple[bool, bool]:
    """Whether any element of a page can match OFFER, and VALIDITY: their texts are parts of those of the outermost."""
    whole = "\n".join(row["text"] for row in page if not row["above"])
    low = whole.upper().lower().replace("\u0307", "")
    return PERCENT.search(whole) is not None or any(x in low for x in OFFER_STEMS), any(x in low for x in VALIDITY_STEMS)


def taken(pages: list[list[dict]]) -> dict[int, tuple[bool, str | None, int | None]]:
    """What the elements of each number take from themselves and those above: navigation, nearest link, steps to the root."""
    own = defaultdict(list)
    for row in (row for page in pages for row in page):
        own[row["no"]].append((row["tag"] in NAVIGATION, row["attrs"].get("href") or None if row["tag"] == "a" else None, row["tag"] in ROOTS))
    found: dict[int, tuple] = {}
    for row in (row for page in pages for row in page):
        nav, link, link_step, root_step = found.get(row["no"], (False, None, None, None))
        for step, up in enumerate([row["no"], *row["above"]]):
            for leads, href, root in own[up]:
                nav = nav or leads
                if href is not None and (link_step is None or step < link_step):
                    link, link_step = href, step
                if root and (root_step is None or step < root_step):
                    root_step = step
        found[row["no"]] = nav, link, link_step, root_step
    return {no: (nav, link, root_step) for no, (nav, link, _, root_step) in found.items()}


def _elements(assets: DataFrame, key: str, html: str = "html") -> DataFrame:
    """A row for every element of every page; those of one key stand together in a task. A page without key has none."""
    schema = ", ".join([f"{key} {kind_of(assets, key)}", *(f"{name} {kind}" for name, _, kind in _ELEMENT)])

    def read(batches) -> Iterator[tuple[object, tuple, int]]:
        for held, rows in runs_of_keys(batches):
            pages = [mk.tree(value) for (value,) in rows]
            above = taken(pages)
            for number, page in enumerate(pages):
                may = may_say(page)
                for row in page:
                    parent = row["above"][0] if row["above"] else None
                    words, attrs = " ".join(row["words"]), list(row["attrs"].items())
                    told = (number, row["no"], parent, row["path"], row["tag"], attrs, words, row["text"], *above[row["no"]], *may)
                    yield held, told, 256 + len(row["path"]) + 2 * len(row["text"])

    def run(batches):
        first = next(batches, None)
        if first is not None:
            yield from in_batches(read(_chain(first, batches)), key, first.schema.field(0).type, _ELEMENT)

    own = assets.where(F.col(key).isNotNull()).select(key, html)
    return leveled(own, key).sortWithinPartitions(key).mapInArrow(run, schema)


def _chain(first, rest):
    yield first
    yield from rest


def _marked(page: DataFrame, minimum: float, card_chars: int | None, label_chars: int | None) -> DataFrame:
    """What every element shows by itself, in words or attributes. Its text goes no further."""
    promo = _first("data-promocode", "data-promo-code")
    coupon = collapse_space(_attr("data-coupon-id"))
    press = F.col("tag").isin("a", "button")
    rows = page.select(
        "*",
        _attr("href").alias("href"),
        promo.isNotNull().alias("value"),
        (promo.isNotNull() | (_attr("data-coupon-id") != "")).alias("machine"),
        F.when(coupon != "", F.concat(F.lit("coupon:"), coupon))
        .when(promo.isNotNull(), F.concat(F.lit("promo:"), collapse_space(promo)))
        .alias("unit"),
        F.when(F.col("tag") == "a", F.nullif(F.regexp_extract(_attr("href"), OFFER_ID, 1), F.lit(""))).alias("offer_id"),
        (press & _says(CONTROL)).alias("control"),
        (press & _says(ACTION)).alias("said"),
        press.alias("press"),
    )
    script = (F.col("tag") == "a") & F.lower("href").rlike("^(?:javascript|mailto|tel):")
    offered = (F.col("tag") == "a") & (F.col("href") != "") & (F.col("text") != "") & F.col("may_offer") & _says(OFFER)
    if label_chars is not None:
        offered = offered & (F.char_length("text") <= label_chars)
    acts = F.contains("href", F.lit("offer_id=")) | (
        ~(F.col("nav") | F.col("control") | script | F.col("text").rlike(CONTACT)) & (F.col("said") | offered)
    )
    rows = rows.withColumn("action", F.col("press") & acts)
    rows = rows.withColumn("explicit", F.col("said") & F.col("offer_id").isNull() & ~F.col("nav") & ~F.col("control"))
    usable = F.col("text") != ""
    if card_chars is not None:
        usable = usable & (F.char_length("text") <= card_chars)
    rank = _rank()
    broad = ~F.col("nav") & (F.coalesce(rank["confidence"], F.lit(-1.0)) >= minimum) & (F.char_length("text") >= 6) & F.col("may_offer") & _says(OFFER)
    rows = rows.select(
        *[c for c in page.columns if c not in ("text", "may_offer", "may_end")],
        "value",
        "machine",
        "unit",
        "offer_id",
        "action",
        "explicit",
        (F.col("action") & F.col("offer_id").isNull() & ~F.col("explicit")).alias("benefit"),
        (F.col("tag").isin(*HEADINGS[1:]) & ~F.col("nav") & ~_says(CONTROL) & _says(BENEFIT)).alias("titles"),
        usable.alias("usable"),
        (F.col("tag").isin(*ENDS) | (F.col("may_end") & _says(VALIDITY))).alias("ends"),
        F.when(broad, rank["priority"]).alias("rank"),
        F.when(broad, rank["confidence"]).alias("rank_confidence"),
    )
    shows = F.col("action") | F.col("machine") | F.col("titles") | F.col("offer_id").isNotNull() | F.col("rank").isNotNull()
    return rows.withColumn("shows", shows)


def _rank() -> Column:
    """Broad containers by their rank."""
    about = F.concat_ws(" ", *[_attr(n) for n in ("class", "id", "role", "itemtype", "itemprop")])
    named = F.arrays_overlap(F.split(F.lower(about), "[^a-z0-9_-]+"), F.array(*[F.lit(w) for w in CARD_WORDS]))

    def level(priority: int, confidence: float) -> Column:
        return F.struct(F.lit(priority).alias("priority"), F.lit(confidence).alias("confidence"))

    return (
        F.when(F.col("tag") == "article", level(4, 0.92))
        .when(F.col("tag") == "li", level(3, 0.89))
        .when(F.col("tag").isin("div", "section") & named, level(3, 0.87))
        .when((F.col("tag") == "a") & (F.col("href") != ""), level(2, 0.84))
    )


class _Element:
    """A marked element; ``above`` are the numbers of the elements above it, nearest first."""

    def __init__(self, names: list[str], row: tuple) -> None:
        self.__dict__.update(zip(names, row))
        self.attrs = dict(self.attrs)
        self.inside: list[_Element] = []
        self.heading = False

    def attr(self, *names: str) -> str | None:
        """The first of these attributes that says something."""
        return next((self.attrs[n] for n in names if self.attrs.get(n)), None)

    def text(self) -> str:
        """Its own words, then those of the elements inside it."""
        parts, todo = [], [self]
        while todo:
            element = todo.pop()
            if element.words:
                parts.append(element.words)
            todo += reversed(element.inside)
        return " ".join(parts)


def _standing(names: list[str], rows: list[tuple]) -> list[_Element]:
    found, at = [], {}
    for row in rows:
        element = _Element(names, row)
        around = None if element.parent is None else at[element.page, element.parent]
        element.above = [] if around is None else [around.no, *around.above]
        if around is not None:
            around.inside.append(element)
        at[element.page, element.no] = element
        found.append(element)
    return found


def _by_number(elements: list[_Element]) -> dict[int, list[_Element]]:
    found = defaultdict(list)
    for element in elements:
        found[element.no].append(element)
    return found


class _Inside:
    """What lies in and below the elements of a number."""

    def __init__(self) -> None:
        self.action = self.explicit = self.benefit = self.machine = self.heading = 0
        self.units: set[str] = set()
        self.offers: set[str] = set()

    @property
    def crowd(self) -> bool:
        return (len(self.units) or self.machine) > 1

    @property
    def several(self) -> bool:
        return max(self.explicit, self.benefit, self.heading, len(self.offers)) > 1 or self.crowd


def _counted(elements: list[_Element]) -> tuple[list[_Element], dict[int, _Inside]]:
    """Elements with whether they title an offer, one for each element that is their parent; counts by number."""
    inside: dict[int, _Inside] = defaultdict(_Inside)
    for e in elements:
        if e.action or e.explicit or e.machine or e.offer_id is not None:
            for at in (e.no, *e.above):
                sums = inside[at]
                sums.action += e.action
                sums.explicit += e.explicit
                sums.benefit += e.benefit
                sums.machine += e.machine
                sums.units |= {e.unit} - {None}
                sums.offers |= {e.offer_id} - {None}
    numbered, found = _by_number(elements), []
    for e in elements:
        for parent in numbered[e.parent] if e.parent is not None else [None]:
            titles_list = (
                parent is not None
                and parent.tag not in ENDS
                and e.link is None
                and inside[parent.no].action - parent.action - inside[e.no].action > 1
            )
            row = e if parent is None or len(numbered[e.parent]) == 1 else _copy(e)
            row.heading = e.titles and not titles_list
            found.append(row)
    for e in found:
        if e.heading:
            for at in (e.no, *e.above):
                inside[at].heading += 1
    return found, inside


def _copy(e: _Element) -> _Element:
    other = object.__new__(_Element)
    other.__dict__.update(e.__dict__)
    return other


def _grown(anchors: list[_Element], numbered: dict[int, list[_Element]], inside: dict[int, _Inside]) -> dict[int, tuple[int, bool]]:
    """By number of anchor: the element it grows to, and whether several units stand around it."""
    ways = defaultdict(set)
    crowded = defaultdict(bool)
    for e in anchors:
        # Elements above the anchor, nearest first, up to the page's root.
        near = e.above if e.root_step is None else e.above[: max(e.root_step - 1, 0)]
        for step, up in enumerate(near):
            crowded[e.no] |= inside[up].crowd
            ways[e.no] |= {(step, up, inside[up].several, x.ends) for x in numbered[up] if x.usable}
    found = {}
    for e in anchors:
        way = sorted(ways[e.no])
        stop = min((step for step, _, several, _ in way if several), default=None)
        way = [x for x in way if stop is None or x[0] < stop]
        edge = min((step for step, _, _, ends in way if ends), default=None)
        reached = [x for x in way if edge is None or x[0] <= edge]
        found[e.no] = reached[-1][1] if reached else e.no, crowded[e.no]
    return found


def _signals(elements: list[_Element], numbered: dict[int, list[_Element]], inside: dict[int, _Inside]) -> Iterator[tuple]:
    """(card, priority, no, kind, confidence) of every signal of every element."""
    anchors = [e for e in elements if e.offer_id is not None or e.machine or e.action or e.heading]
    grown = _grown(anchors, numbered, inside)
    for e in anchors:
        card, crowded = grown[e.no]
        kinds = (
            (e.offer_id is not None, 12, "action", 0.99),
            (e.value and e.action, 11, "action", 0.995),
            (e.value and not e.action, 10, "machine", 0.995),
            (e.heading and e.link is not None, 9, "heading", 0.97),
            (e.action and e.offer_id is None and not e.value and not crowded, 8, "action", 0.96),
            (e.heading and e.link is None, 7, "heading", 0.95),
            (e.machine and not e.value, 6, "machine", 0.99),
        )
        yield from ((card, priority, e.no, kind, confidence) for holds, priority, kind, confidence in kinds if holds)


def _containers(elements: list[_Element]) -> Iterator[tuple]:
    """Broad containers of a key without signals. One inside another of the same or a higher rank does not count."""
    broad = [e for e in elements if e.rank is not None]
    ranks = defaultdict(int)
    for e in broad:
        ranks[e.no] = max(ranks[e.no], e.rank)
    nested = {e.no for e in broad if any(up in ranks and ranks[up] >= e.rank for up in e.above)}
    return ((e.no, e.rank, e.no, "fallback", e.rank_confidence) for e in broad if e.no not in nested)


_CARD = [
    ("position", _INT, "int"),
    ("priority", _INT, "int"),
    ("kind", _TEXT, "string"),
    ("confidence", _DOUBLE, "double"),
    ("path", _TEXT, "string"),
    ("tag", _TEXT, "string"),
    ("text", _TEXT, "string"),
    ("action_href", _TEXT, "string"),
    ("action_text", _TEXT, "string"),
    ("heading", _TEXT, "string"),
    ("strong", _TEXT, "string"),
    ("href", _TEXT, "string"),
    ("link_text", _TEXT, "string"),
    ("image_src", _TEXT, "string"),
    ("image_alt", _TEXT, "string"),
    ("data", _ATTRS, "map<string,string>"),
]


def _described(best: dict[int, tuple], elements: list[_Element], numbered: dict[int, list[_Element]]) -> Iterator[tuple]:
    """The records' own attributes, taken from their cards and anchors."""
    within = defaultdict(list)
    for e in sorted(elements, key=lambda e: e.no):
        for at in (e.no, *e.above):
            if at in best:
                within[at].append(e)

    def first(card: int, *tags: str) -> _Element | None:
        return next((e for e in within[card] if e.tag in tags), None)

    for card, (priority, no, kind, confidence) in best.items():
        titled = next((text for e in within[card] if e.heading and (text := e.text())), None)
        heading, strong, link, image = (first(card, *tags) for tags in (HEADINGS, ("strong", "b"), ("a",), ("img",)))
        data: dict[str, str] = {}
        for e in within[card]:
            for name, said in e.attrs.items():
                if said and name.startswith("data-"):
                    data.setdefault(name, said)
        parts = (
            titled or (heading and heading.text()) or None,
            (strong and strong.text()) or None,
            link and link.attr("href"),
            (link and link.text()) or None,
            image and image.attr("src", "data-src", "data-lazy-src"),
            image and image.attr("alt"),
            list(data.items()),
        )
        for shown in numbered[card]:
            for anchor in numbered[no]:
                pressed = anchor.attr("href") if anchor.tag in ("a", "button") else None
                action = pressed if pressed is not None or kind != "heading" else anchor.link
                yield (no, priority, kind, confidence, shown.path, shown.tag, shown.text(), action, anchor.text() or None, *parts)


def _cards(names: list[str], rows: list[tuple]) -> Iterator[tuple]:
    """The cards of the pages of a key."""
    elements, inside = _counted(_standing(names, rows))
    numbered = _by_number(elements)
    best: dict[int, tuple] = {}
    for card, priority, no, kind, confidence in [*_signals(elements, numbered, inside)] or _containers(elements):
        if card not in best or (-priority, no) < (-best[card][0], best[card][1]):
            best[card] = priority, no, kind, confidence
    return _described(best, elements, numbered)


def offer_cards(
    assets: DataFrame,
    key: str = "asset_id",
    minimum: float = 0.80,
    card_chars: int | None = None,
    label_chars: int | None = None,
) -> DataFrame:
    """One record per card path of each page: its strongest signal, the first in the page on ties.

    ``card_chars``: a card does not grow to an element with a longer text; ``label_chars``: longer link texts are no
    offers by their words alone. Neither limits by default.
    """
    marked = _marked(_elements(assets, key), minimum, card_chars, label_chars)
    names = marked.columns[1:]
    schema = ", ".join([f"{key} {kind_of(assets, key)}", *(f"{name} {kind}" for name, _, kind in _CARD)])

    def read(batches) -> Iterator[tuple[object, tuple, int]]:
        for held, rows in runs_of_keys(batches, "shows"):
            for card in _cards(names, rows):
                yield held, card, 512 + 2 * sum(len(x) for x in card if isinstance(x, str))

    def run(batches):
        first = next(batches, None)
        if first is not None:
            yield from in_batches(read(_chain(first, batches)), key, first.schema.field(0).type, _CARD)

    return marked.mapInArrow(run, schema)
