"""Link-graph and page queries over the stored pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.functions import urls
from dossier.operators import markup, web
from dossier.operators.blocks import leveled
from dossier.plans import sqltext as q
from dossier.plans.registry import Tables, query
from dossier.session import cut_lineage


def unescape(x: str) -> str:
    for entity, char in (("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return x


ANCHORS_SQL = f"""
    raw AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1)) AS href,
        unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS text,
        generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1), 1) - 1 AS pos FROM pages),
    anchors AS (SELECT page_id, url, pos, {unescape("href")} AS href, {q.norm(unescape("text"))} AS text FROM raw)"""

CANON = (
    "lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) || "
    "CASE WHEN regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) END || "
    "regexp_extract(url, '(\\?[^#]*)', 1)"
)
LINKS_SQL = f"""{ANCHORS_SQL},
    links AS (SELECT page_id, {CANON} AS source, pos, regexp_extract(url, '^(https?://[^/?#]+)', 1) || href AS link, text FROM anchors)"""


@query("extract_anchors", "H1", f"WITH {ANCHORS_SQL} SELECT page_id, pos, href, text, '' AS rel FROM anchors")
def extract_anchors(spark, d):
    found = markup.extract_anchors(Tables(spark, d).pages)
    return found.select("page_id", F.col("pos").cast("long"), "href", "text", F.array_join("rel", " ").alias("rel"))


@query("canonicalize_url", "H2", f"SELECT page_id, {CANON} AS canonical FROM pages")
def canonicalize_url(spark, d):
    return Tables(spark, d).pages.select("page_id", urls.canonicalize_url(F.col("url"), F.col("url")).alias("canonical"))


@query("page_links", "H2", f"WITH {LINKS_SQL} SELECT page_id, source, pos, link AS url, text FROM links")
def page_links(spark, d):
    return web.page_links(Tables(spark, d).pages).select("page_id", "source", F.col("pos").cast("long"), "url", "text")


@query(
    "scope_filter",
    "H3",
    f"""WITH {LINKS_SQL}, seeds AS (SELECT DISTINCT regexp_extract(url, '^(https?://[^/?#]+)', 1) AS o FROM pages WHERE url LIKE 'https%')
    SELECT page_id, pos, link AS url FROM links WHERE regexp_extract(link, '^(https?://[^/?#]+)', 1) IN (SELECT o FROM seeds)
      OR regexp_extract(link, '^https?://([^/:?#]+)', 1) LIKE 'spam-farm.example.%'""",
)
def scope_filter(spark, d):
    pages = Tables(spark, d).pages
    hosts = ["spam-farm.example.com", "spam-farm.example.net", "Spam-Farm.example.org."]
    kept = web.scope_filter(web.page_links(pages), pages.where("url LIKE 'https%'"), hosts, same_origin=False)
    return kept.select("page_id", F.col("pos").cast("long"), "url")


# The stored pages as one site: page n links to pages 10n+1 .. 10n+10, to a nofollow page, a
# picture and whatever its own markup links to.
def _site(t: Tables):
    n = F.col("page_id")
    kids = F.array_join(
        F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.concat(F.lit('<a href="p'), n * 10 + i, F.lit('?#x">page</a>'))), ""
    )
    extra = F.concat(F.lit('<a rel="x NoFollow" href="/hidden">h</a><a href="/img/'), n, F.lit('.PNG">i</a>'))
    return t.pages.select(
        "page_id", F.concat(F.lit("https://Site.test:443/p"), n).alias("url"), F.concat(kids, extra, "html").alias("html")
    )


def _crawl(spark, d):
    site = _site(Tables(spark, d))
    every = web.page_links(site)
    pages = site.select(urls.canonicalize_url(F.col("url"), F.col("url")).alias("source"), "page_id")
    # A crawl of the whole table: it starts at the pages that no page links to and ends when nothing new is found.
    seeds = pages.withColumnRenamed("source", "url").join(every.select("url").distinct(), "url", "left_anti")
    seeds = cut_lineage(seeds.select("url", F.col("page_id").cast("int").alias("seed_no")))
    return web.crawl_frontier(pages.select("source"), web.scope_filter(every, seeds), seeds)


CRAWL_SQL = f"""{ANCHORS_SQL},
    level AS (SELECT page_id AS n, length(CAST(9 * page_id + 1 AS VARCHAR)) - 1 AS depth FROM pages),
    own AS (SELECT n, depth, 'https://site.test/p' || (n * 10 + i) AS url, 'page' AS text, i - 1 AS pos FROM level, range(1, 11) r(i)),
    other AS (SELECT n, depth, 'https://site.test' || href AS url, text, 12 + pos AS pos FROM level JOIN anchors ON page_id = n
      WHERE href LIKE '/%'),
    firsts AS (SELECT * FROM (SELECT * FROM own UNION ALL SELECT * FROM other) WHERE url <> 'https://site.test/p0'
      QUALIFY row_number() OVER (PARTITION BY url ORDER BY depth, n, pos) = 1)"""


@query(
    "crawl_frontier",
    "H4",
    f"WITH {CRAWL_SQL} SELECT url, 'https://site.test/p' || n AS parent_url, text AS anchor_text, depth + 1 AS depth FROM firsts",
)
def crawl_frontier(spark, d):
    return _crawl(spark, d)[0].select("url", "parent_url", "anchor_text", "depth")


@query(
    "crawl_visited",
    "H4",
    f"""WITH {CRAWL_SQL}, v AS (SELECT url, depth + 1 AS depth FROM firsts UNION ALL SELECT 'https://site.test/p0', 0)
    SELECT depth, count(*) AS urls, count_if(url IN (SELECT 'https://site.test/p' || page_id FROM pages)) AS stored FROM v GROUP BY depth""",
)
def crawl_visited(spark, d):
    return _crawl(spark, d)[1].groupBy("depth").agg(F.count("*").alias("urls"), F.count_if("stored").alias("stored"))


TITLE = q.norm(unescape("regexp_extract(html, '<title>([^<]*)</title>', 1)"))
H1 = q.norm(unescape("regexp_extract(html, '<h1>([^<]*)</h1>', 1)"))
VISIBLE = q.norm(unescape(q.html_text("html")))
LISTS = {
    "discount": ["the", "la", "of in"],
    "strong": ["fr", "en"],
    "merchant": ["de"],
    "negative": ["es", "login"],
    "navigation": ["en"],
}


def _page_entries(t: Tables):
    signals = markup.page_signals(t.pages).select("page_id", "title")
    return t.pages.select("page_id", "url").join(signals, "page_id").withColumnRenamed("title", "anchor_text")


SEG = "regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1)"


@query(
    "link_relevance",
    "H5",
    f"""WITH e AS (SELECT page_id, {SEG} AS seg, contains(url, '?page=') AS paged, lower({TITLE}) AS a FROM pages),
    s AS (SELECT *, CAST(contains(a, 'the') AS INT) + CAST(contains(a, 'la') AS INT) + CAST(contains(a, 'of in') AS INT) AS hits FROM e)
    SELECT page_id, seg = 'es' AS negative, round(CASE WHEN seg = 'es' THEN -100 ELSE CASE WHEN seg IN ('fr', 'en') THEN 3.5 ELSE 0 END
      + CASE WHEN seg = 'de' THEN 1.25 ELSE 0 END + CASE WHEN seg = 'en' THEN -1.5 ELSE 0 END + CASE WHEN paged THEN -2 ELSE 0 END
      + least(2, 0.75 * hits) END::DOUBLE, 6) AS score,
      CASE WHEN seg = 'es' THEN 'hard_negative_segment=es' ELSE concat_ws(';', CASE WHEN seg IN ('fr', 'en') THEN 'discount_path=' || seg END,
        CASE WHEN seg = 'de' THEN 'merchant_path=de' END, CASE WHEN seg = 'en' THEN 'navigation_path=en' END,
        CASE WHEN paged THEN 'pagination_or_view=page' END, CASE WHEN hits > 0 THEN 'discount_terms=' || concat_ws(',',
          CASE WHEN contains(a, 'the') THEN 'the' END, CASE WHEN contains(a, 'la') THEN 'la' END, CASE WHEN contains(a, 'of in') THEN 'of in' END) END)
      END AS evidence FROM s""",
)
def link_relevance(spark, d):
    scored = web.link_relevance(_page_entries(Tables(spark, d)), **LISTS)
    text = F.array_join(F.transform("evidence", lambda e: F.concat_ws("=", e["signal"], e["detail"])), ";")
    return scored.select("page_id", "negative", "score", text.alias("evidence"))


@query(
    "page_signals",
    "H6",
    f"""SELECT page_id, {TITLE} AS title, {H1} AS h1, '' AS meta_description, sha256({VISIBLE}) AS text_hash FROM pages""",
)
def page_signals(spark, d):
    out = markup.page_signals(Tables(spark, d).pages)
    return out.select("page_id", "title", "h1", "meta_description", F.sha2("visible_text", 256).alias("text_hash"))


def _count(text: str, terms: list[str]) -> str:
    return " + ".join(f"CAST(contains({text}, '{t}') AS INT)" for t in terms)


def _total(text: str, terms: list[str]) -> str:
    return " + ".join(f"(length({text}) - length(replace({text}, '{t}', ''))) // {len(t)}" for t in terms)


TERMS = ["the", "aich", "erin the"]
CALLS = ["and the", "of the", "que la"]
CONTENT_SQL = f"""
    texts AS (SELECT page_id, url, {q.fold(TITLE)} AS t, {q.fold(H1)} AS h, {q.fold(VISIBLE)} AS v FROM pages),
    content AS (SELECT page_id, url, round((CASE WHEN t = 'zz' THEN -2.5 ELSE 0 END
      + CASE WHEN {_count("t", TERMS)} > 0 THEN 2 ELSE 0 END + CASE WHEN {_count("h", TERMS)} > 0 THEN 2 ELSE 0 END
      + least(3, 0.5 * ({_count("v", TERMS)})) + CASE WHEN {_total("v", TERMS)} >= 8 THEN 2 WHEN {_total("v", TERMS)} >= 3 THEN 1 ELSE 0 END
      + least(1.5, 0.75 * ({_count("v", CALLS)})))::DOUBLE, 6) AS score FROM texts)"""


@query("content_relevance", "H7", f"WITH {CONTENT_SQL} SELECT page_id, score FROM content")
def content_relevance(spark, d):
    signals = markup.page_signals(Tables(spark, d).pages)
    return web.content_relevance(signals, TERMS, CALLS, ["zz"]).select("page_id", "score")


def _assessed(t: Tables):
    n = F.col("page_id")
    links = t.pages.select(
        "url",
        n.alias("discovery_index"),
        F.when(n % 11 == 0, F.lit(-100.0)).otherwise(((n * 7 % 13) - 3).cast("double")).alias("score"),
        (n % 11 == 0).alias("negative"),
    )
    contents = t.pages.select("url", F.when(n % 17 != 0, ((n * 5 % 9) - 2).cast("double")).alias("content_score"))
    return links, contents


ASSESSED_SQL = """
    links AS (SELECT url, page_id, page_id % 11 = 0 AS negative, CASE WHEN page_id % 11 = 0 THEN -100 ELSE page_id * 7 % 13 - 3 END AS base,
      CASE WHEN page_id % 17 <> 0 THEN page_id * 5 % 9 - 2 END AS content FROM pages),
    probes AS (SELECT page_id FROM links WHERE NOT negative ORDER BY base DESC, page_id LIMIT 60),
    scored AS (SELECT *, page_id IN (SELECT page_id FROM probes) AS probed,
      CASE WHEN page_id IN (SELECT page_id FROM probes) AND content IS NOT NULL THEN base + content ELSE base END AS s FROM links),
    final AS (SELECT url, page_id AS discovery_index, CAST(s AS DOUBLE) AS score, probed, CASE WHEN negative THEN 'non_target' WHEN NOT probed THEN 'unprobed'
      WHEN s >= 5 THEN 'target' WHEN s >= 2 OR content IS NULL THEN 'candidate' ELSE 'non_target' END AS status FROM scored)"""


@query("classify_links", "H8", f"WITH {ASSESSED_SQL} SELECT discovery_index, score, probed, status FROM final")
def classify_links(spark, d):
    return web.classify_links(*_assessed(Tables(spark, d)), 60).select("discovery_index", "score", "probed", "status")


@query(
    "select_targets",
    "H8",
    f"""WITH {ASSESSED_SQL} SELECT discovery_index, status, score FROM final WHERE status IN ('target', 'candidate', 'unprobed')
    ORDER BY CASE status WHEN 'target' THEN 0 WHEN 'candidate' THEN 1 ELSE 2 END, score DESC, discovery_index LIMIT 80""",
)
def select_targets(spark, d):
    done = web.classify_links(*_assessed(Tables(spark, d)), 60)
    return web.select_targets(done, 80, include_unprobed=True).select("discovery_index", "status", "score")


@query(
    "limit_reasons",
    "H8",
    f"""WITH {ASSESSED_SQL} SELECT concat_ws(',', CASE WHEN (SELECT count(*) FROM links WHERE NOT negative) > 60 THEN 'max_probe_pages' END,
      CASE WHEN (SELECT count(*) FROM final WHERE status IN ('target', 'candidate')) > 20 THEN 'max_selected_urls' END) AS limit_reasons""",
)
def limit_reasons(spark, d):
    return web.limit_reasons(web.classify_links(*_assessed(Tables(spark, d)), 60), 60, 20)


# Sitemap b lists urlset b (the page URLs of block b) and sitemaps 10b+1 .. 10b+10.
def _sitemaps(t: Tables):
    block = F.floor(F.col("page_id") / 50)
    locs = t.pages.groupBy(block.alias("b")).agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("page_id", "url"))),
                lambda p: F.concat(F.lit("<url><loc> "), F.replace(p["url"], F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>")),
            ),
            "",
        ).alias("body")
    )
    b = F.col("b")
    ns = "http://www.sitemaps.org/schemas/sitemap/0.9"
    sets = locs.select(
        F.concat(F.lit("u"), b).alias("url"),
        F.when(b % 7 == 3, F.concat(F.lit("<urlset>"), "body"))
        .otherwise(F.concat(F.lit(f'<urlset xmlns="{ns}">'), "body", F.lit("</urlset>")))
        .alias("xml"),
    )
    kids = F.array_join(
        F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.concat(F.lit("<sitemap><loc>m"), b * 10 + i, F.lit("</loc></sitemap>"))), ""
    )
    maps = locs.select(
        F.concat(F.lit("m"), b).alias("url"),
        F.concat(F.lit("<sitemapindex><sitemap><loc>u"), b, F.lit("</loc></sitemap>"), kids, F.lit("</sitemapindex>")).alias("xml"),
    )
    return maps.unionByName(sets)


def _expanded(spark, d):
    roots = spark.createDataFrame([("m0", 1)], "url string, root_no int")
    return web.expand_sitemaps(_sitemaps(Tables(spark, d)), roots, max_depth=8)


@query("expand_sitemaps", "H9", "SELECT DISTINCT url FROM pages WHERE (page_id // 50) % 7 <> 3")
def expand_sitemaps(spark, d):
    return _expanded(spark, d)[0].select("url")


@query(
    "invalid_sitemaps",
    "H9",
    "SELECT DISTINCT 'sitemap_invalid:u' || (page_id // 50) AS warning FROM pages WHERE (page_id // 50) % 7 = 3",
)
def invalid_sitemaps(spark, d):
    return _expanded(spark, d)[1].select("warning")


SHELL = '<html><body><div id="root"></div><script src="a"></script><script src="b"></script></body></html>'
NOSCRIPT = "<html><body><noscript>You need to enable JavaScript to run this app, says the page at length, more than once.</noscript>hi</body></html>"


@query(
    "render_need",
    "H10",
    f"""WITH p AS (SELECT page_id, 0 AS form, html FROM pages UNION ALL SELECT page_id, 1, '{SHELL}' FROM pages
      UNION ALL SELECT page_id, 2, '{NOSCRIPT}' FROM pages UNION ALL SELECT page_id, 3, '<p></p>' FROM pages)
    SELECT page_id, form, CASE form WHEN 0 THEN length({q.html_text("html")}) WHEN 2 THEN 2 ELSE 0 END AS visible_chars,
      CASE form WHEN 0 THEN (length(html) - length(replace(html, '<script', ''))) // 7 WHEN 1 THEN 2 ELSE 0 END AS scripts,
      CASE form WHEN 1 THEN 'client_rendered_shell' WHEN 2 THEN 'javascript_required_message' WHEN 3 THEN 'empty_html' END AS reason FROM p""",
)
def render_need(spark, d):
    pages = Tables(spark, d).markup
    forms = F.array(
        F.struct(F.lit(0).alias("form"), F.col("html").alias("body")),
        *[F.struct(F.lit(i).alias("form"), F.lit(text).alias("body")) for i, text in ((1, SHELL), (2, NOSCRIPT), (3, "<p></p>"))],
    )
    rows = pages.select("page_id", F.explode(forms).alias("f")).select("page_id", "f.form", "f.body")
    return web.render_need(rows, "body").select(
        "page_id", "form", F.col("visible_chars").cast("long"), F.col("scripts").cast("long"), "reason"
    )


FAILURES_SQL = """
    failures AS (SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'TimeoutError' ELSE 'OSError' END AS error_type,
      'cannot read <url> after ' || user_id || repeat(' and again', user_id) AS m FROM events WHERE event_type = 'error')"""


def _failures(t: Tables):
    u = F.col("user_id")
    log = leveled(t.events.where("event_type = 'error'"), "event_id").select(
        "event_id",
        F.when(u % 3 == 0, "TimeoutError").otherwise("OSError").alias("error_type"),
        F.concat(F.lit("cannot read HTTPS://h.test/"), u, F.lit("?a=b after "), u, F.repeat(F.lit(" and again"), u.cast("int"))).alias("message"),
    )
    return web.crawl_failures(log)


@query(
    "crawl_failures",
    "H11",
    f"""WITH {FAILURES_SQL} SELECT event_id, error_type, m AS message FROM failures""",
)
def crawl_failures(spark, d):
    return _failures(Tables(spark, d))


@query("failure_counts", "H11", f"WITH {FAILURES_SQL} SELECT error_type, count(*) AS failures FROM failures GROUP BY 1")
def failure_counts(spark, d):
    return web.failure_counts(_failures(Tables(spark, d)))
