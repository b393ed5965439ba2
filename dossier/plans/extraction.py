"""Field, record and profile queries over markup and text built from the star-schema rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.operators import fields as fl
from dossier.operators import markup
from dossier.operators import profiles as pr
from dossier.operators import records as rc
from dossier.operators.blocks import leveled
from dossier.operators.fields import FieldSpec
from dossier.plans.registry import Tables, query

# Customers as pages with every kind of field signal.


def customer_pages(t: Tables):
    key = F.col("c_custkey").cast("string")
    return leveled(t.customer, "c_custkey").select(
        F.col("c_custkey").alias("asset_id"),
        F.concat(
            F.lit("<html><head><title> "), "c_name", F.lit(' &amp; co</title><meta name="segment" content="'), "c_mktsegment",
            F.lit('"></head><body><style>p{}</style><div itemprop="balance" content="'), F.col("c_nationkey").cast("string"),
            F.lit('"></div><span data-field="nation">n<b> '), F.col("c_nationkey").cast("string"),
            F.lit("</b></span><dl><dt>Key</dt><dd>"), key,
            F.lit("</dd></dl><table><tr><th>Kind</th><td>vip</td><td>old</td></tr></table><label>Lone</label><dd>x</dd>"),
            F.lit('<script type="application/ld+json; charset=utf-8">{"@type":"Person","account":{"id":'), key,
            F.lit(',"tags":["a","b"],"open":true,"none":null,"blank":""}}</script>'),
            F.lit("<script>var x = 1;</script></body></html>"),
        ).alias("html"),
    )


@query(
    "html_signals",
    "I1",
    """WITH s AS (
      SELECT c_custkey AS asset_id, 'title' AS name, '"' || c_name || ' & co"' AS value_json, 0.74 AS confidence, 'document_title' AS kind, 'title' AS source_ref FROM customer
      UNION ALL SELECT c_custkey, 'segment', '"' || c_mktsegment || '"', 0.93, 'html_meta', 'segment' FROM customer
      UNION ALL SELECT c_custkey, 'balance', '"' || c_nationkey || '"', 0.90, 'html_itemprop', 'balance' FROM customer
      UNION ALL SELECT c_custkey, 'nation', '"n ' || c_nationkey || '"', 0.88, 'html_semantic_element', 'nation' FROM customer
      UNION ALL SELECT c_custkey, 'Key', '"' || c_custkey || '"', 0.84, 'html_label_value', 'dt/dd:Key' FROM customer
      UNION ALL SELECT c_custkey, 'Kind', '"vip"', 0.84, 'html_label_value', 'th/td:Kind' FROM customer
      UNION ALL SELECT c_custkey, '@type', '"Person"', 0.96, 'jsonld', 'script[1].@type' FROM customer
      UNION ALL SELECT c_custkey, 'id', CAST(c_custkey AS VARCHAR), 0.96, 'jsonld', 'script[1].account.id' FROM customer
      UNION ALL SELECT c_custkey, 'tags', '["a","b"]', 0.94, 'jsonld', 'script[1].account.tags' FROM customer
      UNION ALL SELECT c_custkey, 'open', 'true', 0.96, 'jsonld', 'script[1].account.open' FROM customer)
    SELECT asset_id, name, value_json, CAST(confidence AS DOUBLE) AS confidence, kind, source_ref FROM s""",
)
def html_signals(spark, d):
    return markup.html_signals(customer_pages(Tables(spark, d))).drop("excerpt")


@query(
    "page_field_signals",
    "I1",
    """WITH t AS (SELECT page_id, trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\\s+', ' ', 'g')) AS raw FROM pages)
    SELECT page_id AS asset_id, 'title' AS name, replace(replace(raw, '&quot;', '"'), '&amp;', '&') AS value, 'document_title' AS kind FROM t WHERE raw <> ''""",
)
def page_field_signals(spark, d):
    pages = Tables(spark, d).pages.withColumnRenamed("page_id", "asset_id")
    value = F.get_json_object(F.concat(F.lit('{"v":'), "value_json", F.lit("}")), "$.v")
    return markup.html_signals(pages).select("asset_id", "name", value.alias("value"), "kind")


# Parts as documents with label lines, a title, a meta tag and a JSON-LD block.


def part_assets(t: Tables):
    n, size = F.col("p_partkey"), F.col("p_size").cast("string")
    price = F.replace(F.col("p_partkey").cast("string"), F.lit("x"), F.lit("y"))
    text = F.concat(
        F.lit(" Name :  "), "p_name", F.lit("\nBrand — "), "p_brand", F.lit("\r\nSize: "), size, F.lit("\nCost - "), price, F.lit(",5\n"),
        F.when(n % 3 == 0, F.concat(F.lit("Size: "), (F.col("p_size") + 1).cast("string"), F.lit("\n"))).otherwise(""),
        F.lit("free text without a label"),
    )
    html = F.concat(
        F.lit("<title>"), "p_name", F.lit("</title>"),
        F.when(n % 2 == 0, F.concat(F.lit('<meta property="BRAND" content="'), "p_brand", F.lit('">'))).otherwise(""),
        F.when(n % 4 == 0, F.concat(F.lit('<script type="application/ld+json">{"name":"'), "p_name", F.lit('","size":'), size, F.lit("}</script>"))).otherwise(""),
    )
    return leveled(t.part, "p_partkey").select(n.alias("asset_id"), text.alias("text"), html.alias("html"))


SPECS = [
    FieldSpec("name", required=True, aliases=("title",)),
    FieldSpec("brand", required=True),
    FieldSpec("size", value_type="integer", min_confidence=0.7),
    FieldSpec("price", value_type="number", aliases=("Cost!",), min_confidence=0.7),
    FieldSpec("weight", required=True),
]

TEXT_SQL = """
    text_signals AS (
      SELECT p_partkey AS asset_id, 'Name' AS name, '"' || p_name || '"' AS value_json, 0.72::DOUBLE AS confidence, 'text_label_value' AS kind, 'line:1' AS source_ref FROM part
      UNION ALL SELECT p_partkey, 'Brand', '"' || p_brand || '"', 0.72, 'text_label_value', 'line:2' FROM part
      UNION ALL SELECT p_partkey, 'Size', '"' || p_size || '"', 0.72, 'text_label_value', 'line:3' FROM part
      UNION ALL SELECT p_partkey, 'Cost', '"' || p_partkey || ',5"', 0.72, 'text_label_value', 'line:4' FROM part
      UNION ALL SELECT p_partkey, 'Size', '"' || (p_size + 1) || '"', 0.72, 'text_label_value', 'line:5' FROM part WHERE p_partkey % 3 = 0)"""

SIGNALS_SQL = f"""{TEXT_SQL},
    signals AS (
      SELECT * FROM text_signals
      UNION ALL SELECT p_partkey, 'title', '"' || p_name || '"', 0.74, 'document_title', 'title' FROM part
      UNION ALL SELECT p_partkey, 'BRAND', '"' || p_brand || '"', 0.93, 'html_meta', 'BRAND' FROM part WHERE p_partkey % 2 = 0
      UNION ALL SELECT p_partkey, 'name', '"' || p_name || '"', 0.96, 'jsonld', 'script[1].name' FROM part WHERE p_partkey % 4 = 0
      UNION ALL SELECT p_partkey, 'size', CAST(p_size AS VARCHAR), 0.96, 'jsonld', 'script[1].size' FROM part WHERE p_partkey % 4 = 0),
    matches AS (
      SELECT asset_id, CASE lower(name) WHEN 'title' THEN 'name' WHEN 'cost' THEN 'price' ELSE lower(name) END AS field_key, value_json,
        CASE WHEN lower(name) IN ('title', 'cost') THEN confidence - 0.02::DOUBLE ELSE confidence END AS confidence, kind, source_ref,
        CASE lower(name) WHEN 'title' THEN 'title' WHEN 'cost' THEN 'Cost!' ELSE lower(name) END AS term FROM signals)"""


def _signals(t: Tables):
    assets = part_assets(t)
    return fl.text_label_values(assets).unionByName(markup.html_signals(assets))


def _matches(t: Tables):
    return fl.match_fields(_signals(t), SPECS)


@query("text_label_values", "I2", f"WITH {TEXT_SQL} SELECT asset_id, name, value_json, source_ref FROM text_signals")
def text_label_values(spark, d):
    return fl.text_label_values(part_assets(Tables(spark, d))).select("asset_id", "name", "value_json", "source_ref")


@query(
    "document_label_values",
    "I2",
    r"""WITH d AS (SELECT doc_id, replace(text, ', ', ': ') AS text FROM documents),
    l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM d),
    c AS (SELECT doc_id, line_no, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS line FROM l)
    SELECT doc_id AS asset_id, line_no, regexp_extract(line, '^\s*(.+?)\s*(?::|—|–|-)\s+(.+?)\s*$', 1) AS name FROM c
    WHERE regexp_matches(line, '^\s*(.+?)\s*(?::|—|–|-)\s+(.+?)\s*$')""",
)
def document_label_values(spark, d):
    # Prose holds no labels: a comma after a word makes one.
    labelled = F.replace("text", F.lit(", "), F.lit(": "))
    found = fl.text_label_values(Tables(spark, d).texts.select(F.col("doc_id").alias("asset_id"), labelled.alias("text")))
    return found.select("asset_id", F.substring("source_ref", 6, 20).cast("long").alias("line_no"), "name")


@query(
    "jsonld_signals",
    "I3",
    """SELECT event_id AS asset_id, 'k' AS name, json_extract_string(props, '$.k') AS value_json, 0.96::DOUBLE AS confidence, '$.k' AS source_ref
    FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""",
)
def jsonld_signals(spark, d):
    events = Tables(spark, d).events.select(F.col("event_id").alias("asset_id"), F.col("props").alias("json"))
    return markup.jsonld_signals(events).select("asset_id", "name", "value_json", "confidence", "source_ref")


@query(
    "match_fields",
    "I4",
    f"WITH {SIGNALS_SQL} SELECT asset_id, field_key, term, value_json, round(confidence, 6) AS confidence, kind, source_ref FROM matches",
)
def match_fields(spark, d):
    return _matches(Tables(spark, d)).select(
        "asset_id", "field_key", "term", "value_json", F.round("confidence", 6).alias("confidence"), "kind", "source_ref"
    )


def cid(value: str, provider: str = "auto_discovery") -> str:
    return f"""substr(sha256('{{"field_key":"' || field_key || '","provider":"{provider}","value":' || {value} || '}}'), 1, 20)"""


CANDIDATES_SQL = f"""{SIGNALS_SQL},
    candidates AS (
      SELECT asset_id, field_key, value_json, least(0.99::DOUBLE, max(confidence) + least(0.09::DOUBLE, 0.03::DOUBLE * (count(DISTINCT kind) - 1))) AS confidence,
        count(DISTINCT (kind, source_ref)) AS evidence, {cid("value_json")} AS candidate_id FROM matches GROUP BY asset_id, field_key, value_json)"""


@query(
    "corroborate",
    "I5",
    f"WITH {CANDIDATES_SQL} SELECT asset_id, field_key, value_json, round(confidence, 6) AS confidence, evidence, candidate_id FROM candidates",
)
def corroborate(spark, d):
    return fl.corroborate(_matches(Tables(spark, d))).select(
        "asset_id", "field_key", "value_json", F.round("confidence", 6).alias("confidence"), F.size("evidence").cast("long").alias("evidence"), "candidate_id"
    )


@query(
    "coerce",
    "I6",
    """WITH v AS (
      SELECT l_orderkey, l_linenumber, l_partkey, unnest(['integer', 'number', 'boolean', 'string']) AS kind, l_quantity, l_discount, l_returnflag, l_suppkey FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, kind, CASE kind
      WHEN 'integer' THEN CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_partkey AS VARCHAR) END
      WHEN 'number' THEN CAST(l_quantity + 0.5 AS VARCHAR)
      WHEN 'boolean' THEN CASE l_returnflag WHEN 'A' THEN 'true' WHEN 'N' THEN 'false' END
      ELSE '"' || l_suppkey || '"' END AS value FROM v""",
)
def coerce(spark, d):
    as_json = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    part = F.col("l_partkey").cast("string")
    inputs = F.array(
        F.struct(
            F.lit("integer").alias("kind"),
            F.when(F.col("l_linenumber") % 2 == 0, as_json(F.concat(F.lit(" "), F.substring(part, 1, 1), F.lit(" "), F.substring(part, 2, 20))))
            .otherwise(as_json(F.concat(part, F.lit("x"))))
            .alias("raw"),
        ),
        F.struct(F.lit("number").alias("kind"), as_json(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(",5 "))).alias("raw")),
        F.struct(
            F.lit("boolean").alias("kind"),
            F.when(F.col("l_returnflag") == "A", as_json(F.lit(" Да"))).when(F.col("l_returnflag") == "N", as_json(F.lit("No"))).otherwise(as_json(F.lit("maybe"))).alias("raw"),
        ),
        F.struct(F.lit("string").alias("kind"), F.col("l_suppkey").cast("string").alias("raw")),
    )
    rows = Tables(spark, d).lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.explode(inputs).alias("i"))
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("i.kind").alias("kind"), fl.coerce(F.col("i.raw"), F.col("i.kind")).alias("value")
    )


def _candidates(t: Tables):
    return fl.coerce_candidates(fl.corroborate(_matches(t)), SPECS)


def _decisions(t: Tables):
    return fl.resolve_fields(part_assets(t).select("asset_id"), _candidates(t), SPECS)


DECISIONS_SQL = f"""{CANDIDATES_SQL},
    typed AS (SELECT asset_id, field_key, confidence, CASE field_key WHEN 'size' THEN replace(value_json, '"', '')
      WHEN 'price' THEN replace(replace(value_json, '"', ''), ',', '.') ELSE value_json END AS value_json FROM candidates),
    ided AS (SELECT *, {cid("value_json")} AS candidate_id FROM typed),
    ranked AS (SELECT *, row_number() OVER w AS rn, lead(confidence) OVER w AS second, count(*) OVER (PARTITION BY asset_id, field_key) AS n FROM ided
      WINDOW w AS (PARTITION BY asset_id, field_key ORDER BY confidence DESC, candidate_id)),
    specs(field_key, required, min_c) AS (VALUES ('name', true, 0.8), ('brand', true, 0.8), ('size', false, 0.7), ('price', false, 0.7), ('weight', true, 0.8)),
    decisions AS (
      SELECT p_partkey AS asset_id, s.field_key, required, CASE WHEN confidence IS NULL THEN 'unresolved' WHEN confidence < min_c OR coalesce(confidence - second < 0.1, false)
        THEN 'needs_confirmation' ELSE 'auto_selected' END AS status, candidate_id AS selected_id, value_json, confidence, coalesce(n, 0) AS candidates
      FROM part CROSS JOIN specs s LEFT JOIN ranked r ON r.asset_id = p_partkey AND r.field_key = s.field_key AND rn = 1)"""


@query(
    "resolve_fields",
    "I7",
    f"WITH {DECISIONS_SQL} SELECT asset_id, field_key, required, status, selected_id, value_json, round(confidence, 6) AS confidence, candidates FROM decisions",
)
def resolve_fields(spark, d):
    return _decisions(Tables(spark, d)).withColumn("confidence", F.round("confidence", 6)).withColumn("candidates", F.col("candidates").cast("long"))


@query(
    "attribute_candidates",
    "I8",
    f"""WITH a AS (
      SELECT p_partkey AS asset_id, 'name' AS field_key, '"' || p_name || '"' AS v FROM part
      UNION ALL SELECT p_partkey, 'brand', '"' || p_brand || '"' FROM part WHERE p_partkey % 5 <> 0
      UNION ALL SELECT p_partkey, 'size', '"' || p_size || '"' FROM part)
    SELECT asset_id, field_key, v AS value_json, 0.95::DOUBLE AS confidence, {cid("v", "attributes")} AS candidate_id FROM a""",
)
def attribute_candidates(spark, d):
    assets = Tables(spark, d).part.select(
        F.col("p_partkey").alias("asset_id"),
        F.create_map(
            F.lit("nm"), F.col("p_name"), F.lit("br"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand")).otherwise(""), F.lit("sz"), F.col("p_size").cast("string")
        ).alias("attributes"),
    )
    mapping = {"name": "nm", "brand": "br", "size": "sz", "weight": "absent"}
    return fl.attribute_candidates(assets, mapping).select("asset_id", "field_key", "value_json", "confidence", "candidate_id")


@query(
    "apply_confirmations",
    "I9",
    f"""WITH {DECISIONS_SQL}, asked AS (SELECT *, asset_id % 3 AS k FROM decisions WHERE field_key IN ('name', 'size') OR asset_id % 7 = 0)
    SELECT d.asset_id, d.field_key, CASE WHEN k IS NULL OR d.status <> 'needs_confirmation' OR k = 2 THEN d.status WHEN k = 0 THEN 'confirmed' ELSE 'rejected' END AS status,
      CASE WHEN k = 1 AND d.status = 'needs_confirmation' THEN NULL ELSE d.value_json END AS value_json,
      CASE WHEN k IS NOT NULL AND d.status <> 'needs_confirmation' THEN 'not_reviewable' WHEN k = 2 THEN 'unknown_candidate' END AS code
    FROM decisions d LEFT JOIN asked a USING (asset_id, field_key)""",
)
def apply_confirmations(spark, d):
    t = Tables(spark, d)
    decisions, candidates = _decisions(t), _candidates(t)
    k = F.col("asset_id") % 3
    selections = decisions.where(F.col("field_key").isin("name", "size") | (F.col("asset_id") % 7 == 0)).select(
        "asset_id", "field_key", F.when(k == 0, F.col("selected_id")).when(k == 2, "zzz").alias("selected_id")
    )
    return fl.apply_confirmations(decisions, selections, candidates).select("asset_id", "field_key", "status", "value_json", "code")


QUALITY_SQL = """asset_id, count_if(required AND status IN ('unresolved', 'rejected')) AS unresolved_required,
      count_if(required AND status = 'needs_confirmation') AS review_required, count_if(status IN ('unresolved', 'rejected')) AS unresolved_total,
      count_if(status = 'needs_confirmation') AS review_total, count_if(status IN ('auto_selected', 'confirmed')) AS accepted_total"""


@query("extraction_quality", "I10", f"WITH {DECISIONS_SQL} SELECT {QUALITY_SQL} FROM decisions GROUP BY asset_id")
def extraction_quality(spark, d):
    return fl.extraction_quality(_decisions(Tables(spark, d)))


@query(
    "prefer_rendered",
    "I10",
    f"""WITH {DECISIONS_SQL}, st AS (SELECT asset_id, field_key, required, CASE WHEN field_key = 'weight' THEN 'unresolved' WHEN field_key IN ('size', 'price')
        AND NOT (field_key = 'size' AND asset_id % 3 = 0) THEN 'auto_selected' ELSE 'needs_confirmation' END AS status FROM decisions),
    a AS (SELECT {QUALITY_SQL} FROM st GROUP BY asset_id), b AS (SELECT {QUALITY_SQL} FROM decisions GROUP BY asset_id)
    SELECT asset_id, (-b.unresolved_required, -b.review_required, -b.unresolved_total, -b.review_total, b.accepted_total) >
      (-a.unresolved_required, -a.review_required, -a.unresolved_total, -a.review_total, a.accepted_total) AS prefer_rendered FROM a JOIN b USING (asset_id)""",
)
def prefer_rendered(spark, d):
    t = Tables(spark, d)
    assets = part_assets(t)
    static = fl.corroborate(fl.match_fields(fl.text_label_values(assets), SPECS))
    decided = fl.resolve_fields(assets.select("asset_id"), fl.coerce_candidates(static, SPECS), SPECS)
    return fl.prefer_rendered(fl.extraction_quality(decided), fl.extraction_quality(_decisions(t)))


@query(
    "values",
    "I11",
    f"""WITH {DECISIONS_SQL} SELECT asset_id,
      coalesce(string_agg(field_key || '=' || value_json, ';' ORDER BY field_key) FILTER (status = 'auto_selected'), '') AS accepted,
      string_agg(field_key, ',' ORDER BY field_key) FILTER (required AND status = 'unresolved') AS unresolved_required FROM decisions GROUP BY asset_id""",
)
def values(spark, d):
    out = fl.values(_decisions(Tables(spark, d)))
    pairs = F.transform(F.map_entries("values"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return out.select(
        "asset_id", F.array_join(pairs, ";").alias("accepted"), F.array_join("unresolved_required", ",").alias("unresolved_required")
    )


def rid(asset: str, provider: str, ref: str) -> str:
    return f"""'rec_' || substr(sha256('{{"parent_asset_id":"' || {asset} || '","provider":"{provider}","source_ref":"' || {ref} || '"}}'), 1, 24)"""


@query(
    "attribute_records",
    "I12",
    f"""WITH o AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS ordinal FROM lineitem)
    SELECT l_orderkey AS asset_id, ordinal, {rid("l_orderkey", "attribute_records", "'attributes.records[' || ordinal || ']'")} AS record_id,
      CAST(l_linenumber AS VARCHAR) || '/' || l_partkey AS content FROM o""",
)
def attribute_records(spark, d):
    t = Tables(spark, d)
    # Maps do not sort, so the rows are ordered before they become maps.
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("asset_id")).agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))).alias("rows")
    )
    assets = lines.select(
        "asset_id",
        F.transform(
            "rows", lambda x: F.create_map(F.lit("line"), x["l_linenumber"].cast("string"), F.lit("part"), x["l_partkey"].cast("string"))
        ).alias("records"),
    )
    out = rc.attribute_records(assets)
    return out.select(
        "asset_id", F.col("ordinal").cast("long"), "record_id", F.concat_ws("/", F.col("attributes")["line"], F.col("attributes")["part"]).alias("content")
    )


def _jsonld_parts(t: Tables):
    n = F.col("p_partkey")
    return leveled(t.part, "p_partkey").select(
        n.alias("asset_id"),
        F.concat(
            F.lit('<script type="application/ld+json">{"@type":"List","items":[{"@type":"Product","name":"'), "p_name", F.lit('","Brand":"'), "p_brand",
            F.lit('"},{"name":"'), "p_name", F.lit('"},{"name":"x","brand":"y","size":'), F.col("p_size").cast("string"), F.lit(',"cost":[1,2]}]}</script>'),
            F.when(n % 10 == 0, F.lit('<script type="application/ld+json">{broken</script>')).otherwise(""),
        ).alias("html"),
    )


@query(
    "jsonld_records",
    "I13",
    f"""WITH r AS (SELECT p_partkey AS asset_id, 0 AS ordinal, 'script[1].items[0]' AS ref, 0.96 AS confidence, 'brand,name' AS f FROM part
      UNION ALL SELECT p_partkey, 1, 'script[1].items[2]', 0.98, 'brand,name,price,size' FROM part)
    SELECT asset_id, ordinal, ref AS source_ref, {rid("asset_id", "jsonld_records", "ref")} AS record_id, CAST(confidence AS DOUBLE) AS confidence, f AS matched_fields FROM r""",
)
def jsonld_records(spark, d):
    records, _ = rc.jsonld_records(_jsonld_parts(Tables(spark, d)), SPECS)
    return records.select(
        "asset_id", "ordinal", "source_ref", "record_id", F.round("confidence", 6).alias("confidence"), F.array_join("matched_fields", ",").alias("matched_fields")
    )


@query("jsonld_warnings", "I13", "SELECT p_partkey AS asset_id, 'malformed_jsonld:script[2]' AS warning FROM part WHERE p_partkey % 10 = 0")
def jsonld_warnings(spark, d):
    return rc.jsonld_records(_jsonld_parts(Tables(spark, d)), SPECS)[1]


def _offers(t: Tables):
    n = F.col("c_custkey").cast("string")
    return t.customer.select(
        F.col("c_custkey").alias("asset_id"),
        F.concat(
            F.lit("<html><body><nav><a href='/sale'>sale</a></nav><ul><li><h3>Discount "), n, F.lit("%</h3><a href='/go?offer_id="), n,
            F.lit("'>Open promo code</a></li><li data-promocode='P"), n, F.lit("'><p>Bonus</p></li></ul></body></html>"),
        ).alias("html"),
    )


@query(
    "semantic_html_records",
    "I14",
    f"""WITH r AS (SELECT c_custkey AS asset_id, 'document/html[1]/body[1]/ul[1]' AS ref, 0 AS ordinal, 'machine' AS kind, 0.995 AS confidence,
        'Discount ' || c_custkey || '% Open promo code Bonus' AS text, NULL AS action FROM customer
      UNION ALL SELECT c_custkey, 'document/html[1]/body[1]/ul[1]/li[1]', 1, 'action', 0.99, 'Discount ' || c_custkey || '% Open promo code', '/go?offer_id=' || c_custkey FROM customer)
    SELECT asset_id, ordinal, ref AS source_ref, {rid("asset_id", "semantic_html_records", "ref")} AS record_id, kind, CAST(confidence AS DOUBLE) AS confidence, text,
      action AS action_href FROM r""",
)
def semantic_html_records(spark, d):
    return rc.semantic_html_records(_offers(Tables(spark, d))).select(
        "asset_id", "ordinal", "source_ref", "record_id", "kind", "confidence", "text", "action_href"
    )


@query("page_records", "I14")
def page_records(spark, d):
    pages = Tables(spark, d).pages.withColumnRenamed("page_id", "asset_id")
    return rc.semantic_html_records(pages).select("asset_id", "ordinal", "source_ref", "record_id", "kind", "confidence")


@query(
    "record_status",
    "I15",
    f"""WITH {DECISIONS_SQL}, p AS (SELECT asset_id, bool_or(status = 'needs_confirmation') AS review, bool_or(required AND status = 'unresolved' AND asset_id % 4 <> 1) AS open
      FROM decisions GROUP BY asset_id)
    SELECT asset_id AS record_id, CASE WHEN asset_id % 13 = 0 THEN 'rejected' WHEN (asset_id % 8) / 8 + 0.2 < 0.8 OR review THEN 'needs_confirmation'
      WHEN open THEN 'incomplete' ELSE 'ready' END AS status FROM p""",
)
def record_status(spark, d):
    t = Tables(spark, d)
    n = F.col("record_id")
    decisions = _decisions(t).withColumnRenamed("asset_id", "record_id").withColumn("required", F.col("required") & (n % 4 != 1))
    records = t.part.select(F.col("p_partkey").alias("record_id")).select(
        n, ((n % 8) / 8 + 0.2).alias("confidence"), (n % 13 == 0).alias("rejected")
    )
    return rc.record_status(records, decisions)


@query(
    "evidence_fingerprints",
    "I16",
    f"""WITH {SIGNALS_SQL}, terms AS (SELECT asset_id, field_key, value_json, '"' || string_agg(DISTINCT lower(term), '","' ORDER BY lower(term)) || '"' AS terms FROM matches GROUP BY ALL)
    SELECT DISTINCT asset_id, field_key, {cid("value_json")} AS candidate_id, '["' || kind || '","' ||
      regexp_replace(regexp_replace(source_ref, '\\[\\d+\\]', '[*]', 'g'), 'line:\\d+', 'line:*', 'g') || '",[' || terms || ']]' AS fingerprint
    FROM matches JOIN terms USING (asset_id, field_key, value_json)""",
)
def evidence_fingerprints(spark, d):
    found = fl.corroborate(_matches(Tables(spark, d)))
    return pr.evidence_fingerprints(found).select("asset_id", "field_key", "candidate_id", "fingerprint")


# Orders as reviews: every line is a candidate with one fingerprint, line 1 may be selected.
def _reviews(t: Tables):
    n = F.col("l_orderkey")
    lines = t.lineitem.select(
        n.alias("review_id"),
        F.concat(F.lit("f"), n % 3).alias("field_key"),
        F.col("l_linenumber").cast("string").alias("candidate_id"),
        F.concat(F.lit("fp"), F.col("l_suppkey") % 20).alias("fingerprint"),
        F.concat(F.lit("site"), n % 5).alias("site_key"),
        (F.col("l_discount") * 5 + 0.4).alias("confidence"),
    )
    selections = lines.select("review_id", "site_key", "field_key").distinct().withColumn(
        "selected_id", F.when(F.col("review_id") % 4 != 0, "1")
    )
    return lines, selections


PROFILES_SQL = """
    lines AS (SELECT l_orderkey AS n, 'f' || (l_orderkey % 3) AS field_key, CAST(l_linenumber AS VARCHAR) AS candidate_id, 'fp' || (l_suppkey % 20) AS fingerprint,
      'site' || (l_orderkey % 5) AS site_key, l_discount * 5 + 0.4 AS confidence FROM lineitem),
    reviews AS (SELECT n, site_key, field_key, fingerprint, bool_or(candidate_id = '1' AND n % 4 <> 0) AS pos FROM lines GROUP BY ALL),
    profiles AS (SELECT site_key, field_key, fingerprint, count_if(pos) AS confirmations, count_if(NOT pos) AS rejections FROM reviews GROUP BY ALL)"""


@query("learn_profiles", "I17", f"WITH {PROFILES_SQL} SELECT * FROM profiles")
def learn_profiles(spark, d):
    lines, selections = _reviews(Tables(spark, d))
    return pr.learn_profiles(selections, lines.drop("site_key", "confidence"))


@query(
    "adjust_confidence",
    "I18",
    f"""WITH {PROFILES_SQL}, small AS (SELECT site_key, field_key, fingerprint, confirmations % 6 AS c, rejections % 5 AS r FROM profiles),
    j AS (SELECT n, l.field_key, candidate_id, confidence, least(0.18::DOUBLE, c * 0.06::DOUBLE) - least(0.24::DOUBLE, r * 0.08::DOUBLE) AS delta
      FROM lines l JOIN small USING (site_key, field_key, fingerprint)),
    p AS (SELECT n, field_key, candidate_id, confidence, coalesce(max(delta) FILTER (delta > 0), 0) + coalesce(min(delta) FILTER (delta < 0), 0) AS a FROM j GROUP BY ALL)
    SELECT n AS asset_id, candidate_id, round(confidence, 6) AS confidence, round(a, 6) + 0.0 AS adjustment,
      round(CASE WHEN a = 0 THEN confidence ELSE greatest(0, least(0.99, confidence + a)) END, 6) AS adjusted FROM p""",
)
def adjust_confidence(spark, d):
    lines, selections = _reviews(Tables(spark, d))
    profiles = pr.learn_profiles(selections, lines.drop("site_key", "confidence"))
    small = profiles.withColumn("confirmations", F.col("confirmations") % 6).withColumn("rejections", F.col("rejections") % 5)
    out = pr.adjust_confidence(lines.withColumnRenamed("review_id", "asset_id"), small)
    return out.select(
        "asset_id", "candidate_id", F.round("confidence", 6).alias("confidence"), (F.round("adjustment", 6) + 0.0).alias("adjustment"), F.round("adjusted", 6).alias("adjusted")
    )


# Events as profile feedback; time is stretched a hundredfold so that long silences occur.
FEEDBACK_SQL = """
    fb AS (SELECT event_type AS site_key, 'f' || (user_id % 10) AS field_key, 'fp' || user_id AS fingerprint, event_id,
      CAST(floor(epoch(ts)) AS BIGINT) * 100 - 170400000000 AS seen, CAST(json_extract(props, '$.k') AS INT) % 3 <> 0 AS pos FROM events),
    gaps AS (SELECT *, CASE WHEN seen - lag(seen) OVER (PARTITION BY site_key, field_key, fingerprint ORDER BY seen, event_id) >= 180 * 86400 THEN seen END AS cut FROM fb),
    lastcut AS (SELECT site_key, field_key, fingerprint, max(cut) AS cut, max(seen) AS updated_at FROM gaps GROUP BY ALL),
    decayed AS (
      SELECT g.site_key, g.field_key, g.fingerprint, any_value(updated_at) AS updated_at,
        CASE WHEN 271500000 - any_value(updated_at) >= 180 * 86400 THEN 0 ELSE coalesce(sum(pow(0.5, (271500000 - seen) / (30 * 86400.0::DOUBLE))) FILTER (pos AND (c.cut IS NULL OR seen >= c.cut)), 0) END AS confirmations,
        CASE WHEN 271500000 - any_value(updated_at) >= 180 * 86400 THEN 0 ELSE coalesce(sum(pow(0.5, (271500000 - seen) / (30 * 86400.0::DOUBLE))) FILTER (NOT pos AND (c.cut IS NULL OR seen >= c.cut)), 0) END AS rejections
      FROM gaps g JOIN lastcut c USING (site_key, field_key, fingerprint) GROUP BY ALL),
    marked AS (SELECT *, 271500000 - updated_at >= 180 * 86400 OR confirmations + rejections <= 0.01 AS prune FROM decayed)"""


def _decayed(t: Tables):
    u = F.col("user_id")
    feedback = t.events.select(
        F.col("event_type").alias("site_key"),
        F.concat(F.lit("f"), u % 10).alias("field_key"),
        F.concat(F.lit("fp"), u).alias("fingerprint"),
        (F.unix_seconds(F.col("ts").cast("timestamp")) * 100 - 170400000000).alias("at"),
        (F.get_json_object("props", "$.k").cast("int") % 3 != 0).alias("positive"),
    )
    return pr.decay_profiles(feedback, F.lit(271500000))


@query(
    "decay_profiles",
    "I19",
    f"""WITH {FEEDBACK_SQL} SELECT site_key, field_key, fingerprint, updated_at, round(confirmations, 6) AS confirmations, round(rejections, 6) AS rejections, prune FROM marked""",
)
def decay_profiles(spark, d):
    out = _decayed(Tables(spark, d))
    return out.withColumn("confirmations", F.round("confirmations", 6)).withColumn("rejections", F.round("rejections", 6))


@query(
    "prune_report",
    "I19",
    f"""WITH {FEEDBACK_SQL}, f AS (SELECT site_key, field_key, bool_and(prune) AS gone FROM marked GROUP BY ALL)
    SELECT (SELECT count_if(prune) FROM marked) AS removed_patterns, (SELECT count_if(gone) FROM f) AS removed_fields,
      (SELECT count(*) FROM (SELECT site_key FROM f GROUP BY 1 HAVING bool_and(gone))) AS removed_sites""",
)
def prune_report(spark, d):
    return pr.prune_report(_decayed(Tables(spark, d)))
