"""Graph, crawl, search, stores, files and metrics on small hand-made input."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from dossier.functions.files import file_text
from dossier.operators import fusion as fu
from dossier.operators import graph as g
from dossier.operators import lexical as lx
from dossier.operators import memory as mem
from dossier.operators import metrics as m
from dossier.operators import web
from dossier.plans import load_all
from dossier.sources.files import extract_files


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = zipped({
    "word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>One </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p><w:p/>"
    "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    "</w:body></w:document>"
})
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
XLSX = zipped({
    "xl/workbook.xml": f'<workbook {R}><sheets><sheet name="S 1" r:id="r2"/><sheet name="Gone" r:id="r9"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r2" Target="worksheets/a.xml"/></Relationships>',
    "xl/sharedStrings.xml": "<sst><si><t>name</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>",
    "xl/styles.xml": '<styleSheet><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>',
    "xl/worksheets/a.xml": '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row>'
    '<row r="3"><c r="A3"><v>12</v></c><c r="B3"><v>1.50</v></c><c r="C3" t="b"><v>1</v></c><c r="D3" s="1"><v>45292</v></c></row></sheetData></worksheet>',
})
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'


def slide(text):
    return f"<p:sld {A}><p:cSld><p:spTree><p:sp><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp></p:spTree></p:cSld></p:sld>"


PPTX = zipped({
    "ppt/presentation.xml": f'<p:presentation {A} {R}><p:sldIdLst><p:sldId r:id="b"/><p:sldId r:id="a"/></p:sldIdLst></p:presentation>',
    "ppt/_rels/presentation.xml.rels": '<Relationships xmlns="x"><Relationship Id="a" Target="slides/slide1.xml"/><Relationship Id="b" Target="slides/slide2.xml"/></Relationships>',
    "ppt/slides/slide1.xml": slide("first"), "ppt/slides/slide2.xml": slide("second"),
})
RUSSIAN = "про технические документы и проверка закупок при поддержке отдела"
FILES = [
    ("a.bin", DOCX, (".docx", "extracted", "One two\na\tb")),
    ("b.dat", XLSX, (".xlsx", "extracted", "=== S 1 ===\nname\t\trich\n\n12\t1.5\tTrue\t2024-01-01 00:00:00")),
    ("c.pptx", PPTX, (".pptx", "extracted", "=== Slide 1 (ppt/slides/slide2.xml) ===\nsecond\n=== Slide 2 (ppt/slides/slide1.xml) ===\nfirst")),
    ("d.txt", RUSSIAN.encode("koi8-r"), (".txt", "extracted", RUSSIAN)),
    ("e.txt", "Привет".encode("cp1251"), (".txt", "extracted", "Привет")),
    ("f.md", "é".encode("utf-16"), (".md", "extracted", "é")),
    ("g.html", b"<p>a<script>x</script>b</p>", (".html", "extracted", "ab")),
    ("h.xml", b"<a><b/></a>", (".xml", "extracted", "<a><b /></a>")),
    ("i.xml", b"<a>", (".xml", "empty", "")),
    ("j.pdf", b"%PDF-1.4 x", (".pdf", "empty", "")),
    ("k.exe", b"MZ", (".exe", "unsupported", "")),
    ("l.csv", b"", (".csv", "empty", "")),
    ("m.docx", zipped({"word/document.xml": " " * 3_000_000}), (".docx", "refused", "")),
]


@pytest.mark.parametrize("name,content,expected", FILES, ids=[f[0] for f in FILES])
def test_file_text(name, content, expected):
    assert file_text(f"/x/{name}", content) == expected


def test_extract_files(spark, tmp_path):
    for name, content, _ in FILES:
        (tmp_path / name).write_bytes(content)
    out = {r.path.rsplit("/", 1)[-1]: (r.format, r.status, r.text) for r in extract_files(spark, str(tmp_path)).collect()}
    assert out == {name: expected for name, _, expected in FILES}


EDGES = [("e1", "a", "b", 3), ("e2", "b", "c", 2), ("e3", "a", "c", 1), ("e4", "c", "d", 4), ("e5", "d", "e", 5), ("e6", "x", "y", 6)]


def test_k_hop_depths_and_limit(spark):
    rel = spark.createDataFrame([(i, s, t, "t", "canonical", c) for i, s, t, c in EDGES], "relation_id string, source_id string, target_id string, relation_type string, status string, created int")
    starts = spark.createDataFrame([("a",), ("x",)], "start_id string")
    found = {(r.start_id, r.relation_id, r.depth, r.node) for r in g.k_hop(starts, rel, 5).collect()}
    assert found == {("a", "e1", 1, "a"), ("a", "e3", 1, "a"), ("a", "e2", 2, "b"), ("a", "e4", 2, "c"), ("a", "e5", 3, "d"), ("x", "e6", 1, "x")}
    cut = {(r.relation_id, r.depth) for r in g.k_hop(starts.where("start_id = 'a'"), rel, 3, limit=1).collect()}
    assert cut == {("e3", 1)}
    with pytest.raises(ValueError):
        g.k_hop(starts, rel, 0)


def test_relations_of_one_id_keep_the_first_created(spark):
    """Ids are equal when the joined parts are, so an empty part equals a missing one and a newline may stand in either part."""
    import hashlib

    rows = [
        ("a", "b", "t", None, 2), ("a", "b", "t ", "", 1), ("a\nb", "c", "t", None, 5), ("a", "b\nc", "t", None, 4),
        ("a", "c", "t", "k", 7), ("a", "c", "t", "k", 7), (None, "c", "t", "", 9), ("", "c", "t", None, 8),
    ]
    kinds = "source_id string, target_id string, relation_type string, collection_id string, created int"
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    edges = spark.createDataFrame(rows, kinds).select(
        "*", F.lit("Canonical").alias("status"), *none("int", "valid_from", "valid_to"), *none("string", "resource_id", "document_id", "chunk_id")
    )
    tables = [spark.createDataFrame([], schema) for schema in ("chunk_id string, document_id string", "document_id string, resource_id string", "resource_id string, collection_id string")]
    kept, refused = g.build_relations(edges, *tables)
    found = {(r.relation_id, r.source_id, r.target_id, r.relation_type, r.collection_id, r.created, r.status) for r in kept.collect()}
    first = [rows[1], rows[3], rows[4], rows[7]]
    assert found == {
        (hashlib.sha256("\n".join([s or "", t or "", "t", c or "", "", "", ""]).encode()).hexdigest(), s, t, "t", c, created, "canonical")
        for s, t, _, c, created in first
    }
    assert kept.count() == 4 and refused.count() == 0


def test_relations_travel_once_and_without_their_digest(spark):
    """Reviewing relations shuffles them one time, by what their ids are made of."""
    done = load_all()["review_relations"].run(spark, "/root/testdata/sf0.001")
    assert done.count() > 0
    done.collect()
    plan = done._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("partial_min") == 1 and "ReusedExchange" in plan
    assert "hashpartitioning(relation_id" not in plan


def test_crawl_limits_cut_in_discovery_order(spark):
    pages = spark.createDataFrame([("s",), ("b",), ("a",)], "source string")
    links = spark.createDataFrame(
        [("s", 0, "b", "B"), ("s", 1, "a", "A"), ("a", 0, "c", "from a"), ("b", 0, "d", "D"), ("b", 1, "c", "from b"), ("b", 2, "s", "back")],
        "source string, pos int, url string, text string",
    )
    seeds = spark.createDataFrame([("s", 0)], "url string, seed_no int")
    found, visited = web.crawl_frontier(pages, links, seeds, 2)
    assert [(r.url, r.anchor_text, r.depth) for r in found.orderBy("depth", "order_key").collect()] == [("b", "B", 1), ("a", "A", 1), ("d", "D", 2), ("c", "from b", 2)]
    assert {(r.url, r.depth, r.stored) for r in visited.collect()} == {("s", 0, True), ("b", 1, True), ("a", 1, True), ("d", 2, False), ("c", 2, False)}
    assert {r.url for r in web.crawl_frontier(pages, links, seeds, 2, max_urls=3)[0].collect()} == {"b", "a", "d"}
    assert {r.url for r in web.crawl_frontier(pages, links, seeds, 2, max_pages=2)[1].collect()} == {"s", "b"}


def test_crawl_without_a_depth_ends_at_the_last_page(spark):
    pages = spark.createDataFrame([(f"p{i}",) for i in range(8)], "source string")
    links = spark.createDataFrame([(f"p{i}", 0, f"p{(i + 1) % 8}", "next") for i in range(8)], "source string, pos int, url string, text string")
    seeds = spark.createDataFrame([("p0", 0)], "url string, seed_no int")
    found, visited = web.crawl_frontier(pages, links, seeds)
    assert {(r.url, r.depth) for r in found.collect()} == {(f"p{i}", i) for i in range(1, 8)}
    assert {(r.url, r.depth, r.stored) for r in visited.collect()} == {(f"p{i}", i, True) for i in range(8)}


def test_websearch_expressions(spark):
    docs = spark.createDataFrame([(1, "red fox jumps"), (2, "fox red"), (3, "blue bird"), (4, "red bird fox")], "chunk_id long, text string")
    postings = lx.build_postings(docs)
    hit = lambda query: sorted(r.chunk_id for r in lx.websearch_match(postings, docs, query).collect())
    assert hit("red fox") == [1, 2, 4] and hit('"red fox"') == [1] and hit("fox -jumps") == [2, 4]
    assert hit("blue or jumps") == [1, 3] and hit("-red") == [3] and hit("  ") == [] and hit('red -"red fox"') == [2, 4]


def test_expansion_collapses_and_limits(spark, rows):
    queries = spark.createDataFrame([(1, "Red Fox, red hen"), (2, "credit")], "query_id long, query string")
    words = fu.group_dictionary([{"aliases": ["red", "crimson"]}, {"aliases": ["red fox", "fox"]}])
    dictionary = spark.createDataFrame(words, "term_no int, term string, replacement_no int, replacement string")
    out = fu.expand_queries(queries, dictionary, 2)
    assert rows(out.select("query_id", "variant_no", "query")) == [(1, 1, "crimson Fox, red hen"), (1, 2, "fox, red hen")]


def test_rerank_keeps_unscored_hits_behind(spark):
    hits = spark.createDataFrame([(1, "a b", i, "", "a" if i == 3 else "x", i) for i in range(1, 5)], "query_id long, query string, chunk_id long, title string, text string, rank int")
    out = fu.rerank(hits, fu.token_overlap, 3).orderBy("place").collect()
    assert [r.chunk_id for r in out] == [3, 1, 2, 4] and out[3].rerank is None
    failed = fu.rerank(hits, lambda q, p: F.lit(None).cast("double"), 3).orderBy("place").collect()
    assert [r.chunk_id for r in failed] == [1, 2, 3, 4]


def test_memory_policies_against_a_stack(spark):
    rng = random.Random(4)
    writes = [(i, "c", f"s{rng.randint(0, 3)}" if rng.random() < 0.9 else None, rng.randint(0, 30), rng.choice(["append", "supersede", "reject"])) for i in range(120)]
    df = spark.createDataFrame(writes, "write_id long, collection_id string, subject_key string, at int, policy string")
    got = {r.write_id: r.status for r in mem.memory_conflicts(df, F.floor(F.col("at") / 4)).collect()}
    expected, stacks = {}, {}
    for wid, _, subject, at, policy in sorted(writes, key=lambda w: (w[3], w[0])):
        stack = stacks.setdefault(subject, []) if subject else []
        if policy == "reject" and stack:
            expected[wid] = "rejected"
            continue
        if policy == "supersede" and stack:
            expected[stack.pop()] = "superseded"
        stack.append(wid)
        expected[wid] = "active"
    assert got == expected


def slow_distance(a, b):
    """Edit distance by plain recursion over the last elements, remembered per pair of lengths."""
    known = {}

    def cost(i, j):
        if not i or not j:
            return i + j
        if (i, j) not in known:
            swap = cost(i - 1, j - 1) + (a[i - 1] != b[j - 1])
            known[i, j] = min(cost(i - 1, j) + 1, cost(i, j - 1) + 1, swap)
        return known[i, j]

    return cost(len(a), len(b))


def test_error_rates(spark):
    rng = random.Random(6)
    pairs = [(" ".join(rng.choices("a b cé d".split(), k=rng.randint(0, 9))), " ".join(rng.choices("a b cé e".split(), k=rng.randint(0, 9)))) for _ in range(60)]
    df = spark.createDataFrame(pairs, "r string, h string")
    for row in df.select("r", "h", m.word_error_rate("r", "h").alias("w"), m.character_error_rate(F.col("r"), F.col("h")).alias("c")).collect():
        want, have = row.r.split(), row.h.split()
        assert row.w == ((1.0 if have else 0.0) if not want else slow_distance(want, have) / len(want))
        assert row.c == ((1.0 if row.h else 0.0) if not row.r else slow_distance(row.r, row.h) / len(row.r))


def test_structure_needs_cells_in_order(spark):
    texts = spark.createDataFrame([("x", "Name:  Bo\na\tb c\td\n")], "artifact_id string, text string")
    cells = spark.createDataFrame([("x", ["a", "d"]), ("x", ["d", "a"]), ("x", ["b  c"])], "artifact_id string, cells array<string>")
    fields = spark.createDataFrame([("x", "Name:", "Bo"), ("x", "Bo", "Name:")], "artifact_id string, label string, value string")
    row = m.structure_score(texts, cells, fields).first()
    assert (row.matched, row.checks) == (3, 5)


def test_invariant_violations_are_counted(spark, rows):
    hits = spark.createDataFrame([(1, "c1", "u"), (1, "c2", "u"), (2, "c3", "v")], "query_id int, collection_id string, canonical_uri string")
    scope = spark.createDataFrame([(1, "c1"), (1, "c2"), (2, "c2")], "query_id int, collection_id string")
    decisions = spark.createDataFrame([("t1", "t2", "allowed"), ("t1", "t1", "allowed")], "own_tenant string, policy_tenant string, decision string")
    conflicts = spark.createDataFrame([(2, "w"), (2, "v")], "query_id int, canonical_uri string")
    stale = spark.createDataFrame([("r", "h", "h", True), ("s", "h", "i", True), ("t", "h", "h", False)], "resource_id string, hash_before string, hash_after string, in_index boolean")
    assert dict(rows(m.hit_invariants(hits, scope, decisions, conflicts, stale))) == {
        "collection_isolation": 1, "tenant_isolation": 1, "one_winner_per_uri": 1, "conflicting_sources_kept": 1, "stale_evidence_kept": 2,
    }
