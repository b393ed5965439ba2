"""Markup, cards, fields, records, profiles and result stores on small hand-made input."""

import json

from pyspark.sql import functions as F

from dossier.functions import markup
from dossier.operators import cards
from dossier.operators import fields as fl
from dossier.operators import profiles as pr
from dossier.operators import records as rc


def best(spark, *pages):
    """Cards of each page, in path order."""
    table = spark.createDataFrame(list(enumerate(pages)), "asset_id int, html string")
    found = cards.offer_cards(table).collect()
    return [sorted((r for r in found if r.asset_id == i), key=lambda r: r.path) for i in range(len(pages))]


CASES = {
    "article and list item win over what they contain": (
        "<article><h3>20% discount today</h3><a href='/a'>Show promo code</a></article>"
        "<ul><li><a href='/b'>Shop sale 30% get coupon</a></li></ul>",
        [("article", "/a"), ("li", "/b")],
    ),
    "free links are records of their own": (
        "<section><a href='/1'>Alpha 70%</a><a href='/2'>Beta 25%</a><a href='/about'>Company</a></section>",
        [("a", "/1"), ("a", "/2")],
    ),
    "a list of two buttons is not one record": (
        "<section><div><h3>Discount 1</h3><button>Open promo</button></div><div><h3>Discount 2</h3><button>Open promo</button></div></section>",
        [("div", None), ("div", None)],
    ),
    "navigation, footer, contact and script links are ignored": (
        "<nav><a href='/p'>All discounts</a></nav><main><a href='mailto:promo@x.test'>promo@x.test</a>"
        "<a href='javascript:go()'>Promos 18</a><h3>Submit promo</h3><div><h3>Discount 25%</h3></div></main><footer><h3>Discounts</h3></footer>",
        [("main", "mailto:promo@x.test")],
    ),
    "a heading above several links labels the list": (
        "<section><h2>Active discounts</h2><a href='/a'>Alpha 70%</a><a href='/b'>Beta 25%</a></section>",
        [("a", "/a"), ("a", "/b")],
    ),
    "plain filter buttons are nothing": ("<section><button>Discount</button><button>Bonus</button></section>", []),
    "side links are nothing": ("<aside><a href='/x'>Discount 20%</a></aside>", []),
    "pages without offers have none": ("<main><h1>About us</h1><p>News</p></main>", []),
}


def test_cards(spark):
    for (name, (_, expected)), found in zip(CASES.items(), best(spark, *[html for html, _ in CASES.values()])):
        if name.startswith("navigation"):
            assert len(found) == 1 and found[0].heading == "Discount 25%"
        else:
            assert [(c.tag, c.href) for c in found] == expected, name


def test_card_attributes_and_arbitration(spark):
    pages = best(
        spark,
        "<article><h3>Discount 15%</h3><img data-src='/l.png' alt='Shop'>"
        "<button data-coupon-id='42' data-promocode='SAVE'>Get promo</button></article>",
        "<div class='offer' data-coupon-id='7'><h3>Discount 20%</h3></div>",
        "<section><div data-coupon-id='1'><h3>Sale discount A</h3><button data-coupon-id='1'>Show promo</button></div>"
        "<div data-coupon-id='2'><h3>Discount B</h3><button data-coupon-id='2'>Show promo</button></div></section>",
        "<div><a href='/?offer_id=7'>Sale</a><a href='/?offer_id=7'>Show promo</a></div>",
        "<div><div><a href='/1'><h3>Promo Alpha</h3></a><p>x</p></div><div><a href='/2'><h3>Discount Beta</h3></a><p>y</p></div></div>",
        "<article>sale 5% <li>gift bonus</li></article><div class='x card'>discount day</div><div class='y'>discount</div>",
        "<section><p>x</p><div><h3>Discount 5%</h3><a href='/d'>Open deal</a><i>valid until May</i></div></section>",
    )
    (card,), (linked,), (a, b), (same,), titled, broad, (ended,) = pages
    assert card.kind == "action" and card.confidence == 0.995
    assert card.data == {"data-src": "/l.png", "data-coupon-id": "42", "data-promocode": "SAVE"}
    assert (card.image_src, card.image_alt, card.heading) == ("/l.png", "Shop", "Discount 15%")
    assert linked.kind == "heading"
    assert [a.data["data-coupon-id"], b.data["data-coupon-id"]] == ["1", "2"]
    assert same.action_href == "/?offer_id=7" and same.tag == "div"
    assert [(c.kind, c.action_href) for c in titled] == [("heading", "/1"), ("heading", "/2")]
    assert [(c.tag, c.kind, c.confidence) for c in broad] == [("article", "fallback", 0.92), ("div", "fallback", 0.87)]
    assert ended.tag == "div"


def test_long_cards_and_labels_count_unless_limited(spark):
    page = "<div><h3>Discount 5%</h3><p>" + "words " * 600 + "</p></div><a href='/a'>" + "x" * 400 + " sale</a>"
    table = spark.createDataFrame([(1, page)], "asset_id int, html string")
    assert [r.tag for r in cards.offer_cards(table).orderBy("path").collect()] == ["a", "div"]
    assert [r.tag for r in cards.offer_cards(table, card_chars=2200, label_chars=280).collect()] == ["h3"]


def test_anchors_and_base():
    base, found = markup.anchors("<base href=' /b/ '><base href='/c'><a href=' x '>one <b>two</b></a><a>no</a><a rel='A nofollow' href='y'/>z</a>")
    assert base == "/b/" and found == [("x", "one two", []), ("y", "", ["a", "nofollow"])]
    assert len(markup.anchors("<a href=1>a</a><a href=2>b</a>", limit=1)[1]) == 1


def test_page_signals():
    page = "<title>T &amp; t</title><meta property='og:description' content=' d '><svg>no</svg><h1>H <i>h</i></h1>v<script>no</script>"
    assert markup.page_signals(page) == ("T & t", "H h", "d", "T & t H h v")


def test_json_walk_keeps_paths_and_zero():
    found = markup.json_signals('{"a":{"b":[{"c":0},{"d":["x",1]}],"e":"","f":null}}', "$")
    assert [(s[0], s[1], s[4]) for s in found] == [("c", 0, "$.a.b[0].c"), ("d", ["x", 1], "$.a.b[1].d")]
    assert markup.json_signals("{broken", "$") == []


SPECS = [fl.FieldSpec("price", value_type="number", aliases=("cost",)), fl.FieldSpec("ok", value_type="boolean"), fl.FieldSpec("n", value_type="integer")]


def test_coercion(spark):
    cases = [
        ('" 1 200,5 "', "number", 1200.5), ('"x"', "number", None), ("7", "number", 7), ("true", "number", None), ('"1d"', "number", None),
        ('" 1 000"', "integer", 1000), ('"1_000"', "integer", 1000), ('"1.5"', "integer", None), ("false", "integer", None),
        ('"ДА"', "boolean", True), ('"0"', "boolean", False), ('"maybe"', "boolean", None), ("true", "boolean", True),
        ("5", "string", "5"), ('"a\\"b"', "string", 'a"b'), ("[1]", "auto", [1]),
    ]
    df = spark.createDataFrame([(i, v, t) for i, (v, t, _) in enumerate(cases)], "i int, v string, t string")
    got = {r.i: r.c for r in df.select("i", fl.coerce(F.col("v"), F.col("t")).alias("c")).collect()}
    for i, (raw, kind, expected) in enumerate(cases):
        assert (None if got[i] is None else json.loads(got[i])) == expected, (raw, kind, got[i])


def test_candidate_and_record_ids_are_canonical(spark):
    import hashlib

    row = spark.createDataFrame([('a"b\\é\n',)], "v string").select(
        fl.candidate_id(F.lit("f"), F.lit("p"), fl.json_text(F.col("v"))).alias("c"), rc.record_id(F.col("v"), F.lit("p"), F.lit("r")).alias("r")
    ).first()
    dump = lambda d: json.dumps(d, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    value = 'a"b\\é\n'
    assert row.c == hashlib.sha256(dump({"field_key": "f", "provider": "p", "value": value}).encode()).hexdigest()[:20]
    assert row.r == "rec_" + hashlib.sha256(dump({"parent_asset_id": value, "provider": "p", "source_ref": "r"}).encode()).hexdigest()[:24]


def test_label_lines(spark, rows):
    df = spark.createDataFrame([(1, "Price : 5\r\nA—B\x0bTotal - 7 - 8\n: x\nno label\nLong – v")], "asset_id long, text string")
    assert rows(fl.text_label_values(df).select("name", "value_json", "source_ref")) == [
        ("Long", '"v"', "line:6"), ("Price", '"5"', "line:1"), ("Total", '"7 - 8"', "line:3"),
    ]


def test_resolution_rules(spark):
    cands = spark.createDataFrame(
        [("a", "price", 0.9, "p1", "x", "1"), ("a", "price", 0.7, "p2", "y", "2"), ("b", "price", 0.9, "p1", "x", "1"), ("b", "price", 0.85, "p2", "y", "2"),
         ("c", "price", 0.5, "p1", "x", "1")],
        "asset_id string, field_key string, confidence double, provider string, candidate_id string, value_json string",
    )
    assets = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "asset_id string")
    out = {r.asset_id: (r.status, r.selected_id) for r in fl.resolve_fields(assets, cands, SPECS[:1]).collect()}
    assert out == {"a": ("auto_selected", "x"), "b": ("needs_confirmation", "x"), "c": ("needs_confirmation", "x"), "d": ("unresolved", None)}


def test_attribute_record_cap_is_reported(spark):
    df = spark.createDataFrame([("a", [{"k": "1"}, {"k": "2"}, {"k": "3"}])], "asset_id string, records array<map<string,string>>")
    out = rc.attribute_records(df, max_records=2).collect()
    assert [r.ordinal for r in out] == [0, 1] and {r.warning for r in out} == {"max_records:2"}


def test_semantic_records_frame(spark):
    df = spark.createDataFrame([("p", CASES["article and list item win over what they contain"][0]), ("q", None)], "asset_id string, html string")
    out = rc.semantic_html_records(df).orderBy("ordinal").collect()
    assert [(r.asset_id, r.tag, r.ordinal) for r in out] == [("p", "article", 0), ("p", "li", 1)]


def test_decay_equals_the_stepwise_fold(spark):
    import random

    rng = random.Random(2)
    day, half = 86_400, 30 * 86_400
    events, as_of = [], 2000 * day
    for key in range(12):
        at = rng.randint(0, 900 * day)
        while at < as_of:
            events.append((f"fp{key}", at, rng.random() < 0.6))
            at += rng.choice([3_600, 5 * day, 60 * day, 181 * day])
    df = spark.createDataFrame([("s", "f", *e) for e in events], "site_key string, field_key string, fingerprint string, at long, positive boolean")
    out = {r.fingerprint: r for r in pr.decay_profiles(df, F.lit(as_of)).collect()}
    for key in range(12):
        up = down = 0.0
        last = None
        for fp, at, positive in sorted(e for e in events if e[0] == f"fp{key}"):
            if last is not None:
                factor = 0 if at - last >= 180 * day else 0.5 ** ((at - last) / half)
                up, down = up * factor, down * factor
            up, down, last = up + positive, down + (not positive), at
        if last is None:
            continue
        factor = 0 if as_of - last >= 180 * day else 0.5 ** ((as_of - last) / half)
        row = out[f"fp{key}"]
        assert abs(row.confirmations - up * factor) < 1e-9 and abs(row.rejections - down * factor) < 1e-9


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fields_of_all_assets_are_never_broadcast(spark, rows):
    cands = spark.createDataFrame(
        [("a", "price", 0.9, "p1", "x", "1"), ("a", "price", 0.7, "p2", "y", "2"), ("b", "price", 0.9, "p1", "x", "1"), ("b", "price", 0.85, "p2", "y", "2")],
        "asset_id string, field_key string, confidence double, provider string, candidate_id string, value_json string",
    )
    decided = fl.resolve_fields(cands.select("asset_id").distinct(), cands, SPECS[:1])
    picked = spark.createDataFrame([("a", "price", "y"), ("b", "price", "y")], "asset_id string, field_key string, selected_id string")
    confirmed = fl.apply_confirmations(decided, picked, cands)
    quality = fl.extraction_quality(decided)
    better = fl.prefer_rendered(quality, fl.extraction_quality(confirmed))
    records = spark.createDataFrame([("a", 0.9, False), ("b", 0.9, False), ("c", 0.9, True)], "record_id string, confidence double, rejected boolean")
    status = rc.record_status(records, decided.withColumnRenamed("asset_id", "record_id"))
    for df in (decided, confirmed, better, fl.values(decided), status):
        assert "Broadcast" not in plan_of(df)
    assert rows(confirmed.select("asset_id", "status", "value_json", "code")) == [("a", "auto_selected", "1", "not_reviewable"), ("b", "confirmed", "2", None)]
    assert rows(better) == [("a", False), ("b", True)]
    assert rows(status) == [("a", "ready"), ("b", "needs_confirmation"), ("c", "rejected")]


def test_elements_of_all_pages_are_never_broadcast(spark):
    pages = spark.createDataFrame([("p", CASES["article and list item win over what they contain"][0]), ("q", None)], "asset_id string, html string")
    found = cards.offer_cards(pages)
    assert "Broadcast" not in plan_of(found) and sorted(r.tag for r in found.collect()) == ["article", "li"]


def test_pages_are_shuffled_once_and_never_as_elements(spark):
    """The only thing that travels is the page; every element has the text of all below it, many times the page."""
    nested = "<div>" * 12 + "<h3>Discount <b>5%</b> today</h3>and<a href='/d'>Open <i>deal</i> code</a>" + "</div>" * 12
    pages = spark.createDataFrame([(1, nested), (2, CASES["article and list item win over what they contain"][0]), (None, nested), (3, None)], "asset_id int, html string")
    found = cards.offer_cards(pages)
    plan = plan_of(found)
    assert plan.count("Exchange") == 1 and plan.count("Scan ExistingRDD") == 1 and "checkpoint" not in plan
    shown = [(r.asset_id, r.path, r.text) for r in found.collect()]
    assert {i for i, _, _ in shown} == {1, 2}
    texts = {(i, row["path"]): row["text"] for i, html in ((r.asset_id, r.html) for r in pages.collect()) for row in markup.tree(html)}
    assert all(texts[i, path] == text for i, path, text in shown)


def test_words_are_looked_for_wherever_they_can_match():
    for offer in ("SALE", "ſale", "gıft", "DİSCOUNT", "Кэшбэк", "до 5 %", "5<b>%</b>", "- 7 <i>₽</i>", "скидка"):
        assert cards.may_say(markup.tree(f"<div><p>a {offer}</p></div>")) == (True, False), offer
    for end in ("Valid <b>until</b>", "EXPİRES", "Срок действия", "осталось 3 дня", "активен ещё"):
        assert cards.may_say(markup.tree(f"<p>a</p><div><p>{end}</p></div>")) == (False, True), end
    assert cards.may_say(markup.tree("<p>a % b</p>")) == (False, False) == cards.may_say(markup.tree(None))
