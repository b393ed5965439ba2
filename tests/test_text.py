import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from dossier.functions import markup as mk
from dossier.functions import text as tx
from dossier.functions import urls
from dossier.operators import chunking, fields


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v"))).first()[0]


def test_normalisation_matches_python_whitespace(spark):
    odd = "  a b\r\n\x1c c\x85　d\t\n\n e  "
    assert one(spark, odd, tx.normalize_text) == " ".join(odd.split())
    assert one(spark, "x\x1f", tx.strip) == "x"


def test_casefold_and_entity_key(spark):
    for word in ("Straße ﬁn ΣΟΦΟΣ ſ", "ÄÖÜ", "plain", "Ёлка"):
        assert one(spark, word, tx.casefold) == word.casefold()
    assert one(spark, " ﬀ Ａｂ  Straße ", tx.entity_key) == "ff ab strasse"


def test_has_term_is_whole_word_and_literal(spark):
    hit = lambda text, term: one(spark, text, lambda c: tx.has_term(c, F.lit(term)))
    assert hit("a C++ book", "c++") and not hit("cat", "at") and hit("x at, y", "AT")
    assert not hit("éat", "at") and hit("q\\Ez here", "q\\Ez")


def test_occurrences_do_not_overlap(spark):
    assert one(spark, "aaaaa", lambda c: tx.occurrences(c, F.lit("aa"))) == "aaaaa".count("aa")
    assert one(spark, "éàéà", lambda c: tx.occurrences(c, F.lit("éà"))) == 2


def brute_chunks(text, size, overlap, minimum):
    """The rule written down directly: window, last space, advance, drop short and repeated."""
    if len(text) < minimum:
        return [(0, len(text), text)] if text else []
    size, out, seen, start = max(size, minimum), [], set(), 0
    overlap = min(overlap, size // 2)
    while start < len(text):
        end = min(len(text), start + size)
        if end < len(text):
            spaces = [i for i, c in enumerate(text[start:end]) if c == " "]
            if spaces and spaces[-1] >= minimum // 2:
                end = start + spaces[-1] + 1
        piece = text[start:end].strip()
        if len(piece) >= minimum and piece not in seen:
            seen.add(piece)
            out.append((start, end, piece))
        if end == len(text):
            break
        start = max(end - overlap, start + 1)
        while start < len(text) and text[start] == " ":
            start += 1
    return out


def test_spans_against_the_rule():
    rng = random.Random(5)
    for _ in range(300):
        words = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 60))]
        text = " ".join(words)
        size, overlap, minimum = rng.randint(1, 60), rng.randint(0, 40), rng.randint(1, 20)
        if len(text) >= minimum and min(overlap, max(minimum, size) // 2) < minimum:
            with pytest.raises(ValueError):
                list(chunking.spans(text, size, overlap, minimum))
        else:
            assert list(chunking.spans(text, size, overlap, minimum)) == brute_chunks(text, size, overlap, minimum)


def test_chunk_rows(spark):
    text = " ".join(f"word{i}" for i in range(600))
    rows = chunking.chunk_documents(spark.createDataFrame([(1, text), (2, ""), (3, "tiny")], "id long, text string"), ["id"]).collect()
    mine = [r for r in rows if r.id == 1]
    assert [r.ordinal for r in sorted(mine, key=lambda r: r.ordinal)] == list(range(len(mine)))
    for r in rows:
        assert r.content_hash == hashlib.sha256(r.chunk_text.encode()).hexdigest()
        assert r.token_estimate == max(1, len(r.chunk_text) // 4)
    assert [(r.id, r.chunk_text) for r in rows if r.id != 1] == [(3, "tiny")]


def test_dedupe_renumbers(spark, rows):
    df = spark.createDataFrame([(1, "h1", 0), (1, "h2", 1), (1, "h1", 2), (1, "h3", 3), (2, "h1", 5)], "d long, content_hash string, ordinal int")
    assert rows(chunking.dedupe_chunks(df, "d").select("d", "content_hash", "ordinal")) == [
        (1, "h1", 0), (1, "h2", 1), (1, "h3", 2), (2, "h1", 0),
    ]


def test_canonical_urls():
    c = urls.canonical
    assert c("https://A.test./x/y", "../z?q=1#f") == "https://a.test/z?q=1"
    assert c("https://a.test/x", "//B.test:443") == "https://b.test/"
    assert c("http://a.test/x/", "p") == "http://a.test/x/p"
    assert c("http://a.test", "http://a.test:8080/") == "http://a.test:8080/"
    for bad in ("", "#top", "mailto:x@y.z", "ftp://a/b", "http://u:p@a/", "http://a:99999/", "https://"):
        assert c("http://a.test/", bad) is None


def test_site_key(spark):
    key = lambda u: one(spark, u, urls.site_key)
    assert key("https://U:p@Shop.Test.:443/a") == "shop.test"
    assert key("http://shop.test:8080") == "shop.test:8080"
    assert key("http://shop.test:443/") == "shop.test:443"
    assert key("nonsense") is None


def test_html_to_text(spark):
    page = "<p>a<SCRIPT x>var t='</p>'\n</script>b</p><style>p{}</style>\n c&amp;"
    expected = re.sub(r"\s+", " ", re.sub("<[^>]+>", " ", "<p>ab</p>\n c&amp;")).strip()
    assert one(spark, page, tx.html_to_text) == expected


def test_markup_is_read_without_counting_lines():
    recorder = mk._Recorder()
    recorder.feed("a\n<p>\n\nb</p>\n<!-- c\n --><br/>\n")
    recorder.close()
    assert recorder.getpos() == (1, 0)
    assert [e[:2] for e in recorder.events if e[0] != "text"] == [("open", "p"), ("close", "p"), ("open", "br"), ("close", "br")]


def test_compact_knows_every_space():
    spaces = [chr(c) for c in range(0x110000) if re.match(r"\s", chr(c))]
    odd = "".join(f"{s}a{s}{s}b" for s in spaces)
    assert mk.compact(odd) == re.sub(r"\s+", " ", odd).strip() and mk.compact(" \n") == mk.compact("") == ""


def test_hidden_elements_nest_and_need_not_close():
    page = "a<script>b</script></script>c<noscript>d<style>e</style>f</noscript>g</noscript>h<style>i</style>j<noscript>k"
    assert [text for text, shown in mk.outline(page)[1] if shown] == ["a", "c", "g", "h", "j"]


def test_names_are_keyed_once_and_json_needs_no_new_encoder(monkeypatch):
    fields.semantic_name.cache_clear()
    assert [fields.semantic_name(n) for n in ("Na-me ﬁ", "Na-me ﬁ", "", None)] == ["namefi", "namefi", "", ""]
    assert fields.semantic_name.cache_info().hits == 1
    monkeypatch.setattr(mk.json, "JSONEncoder", None)
    assert mk.canonical_json({"b": [1, "é"], "a": None}) == '{"a":null,"b":[1,"é"]}'
