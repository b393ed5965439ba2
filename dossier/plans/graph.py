"""Entity-graph queries over the star-schema tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions.text import entity_key
from dossier.operators import graph as g
from dossier.plans.registry import Tables, query


def tag(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


@query(
    "normalize_entity_value",
    "G1",
    r"""SELECT kind, id, trim(regexp_replace(lower(v), '\s+', ' ', 'g')) AS normalized FROM (
      SELECT 'c' AS kind, c_custkey AS id, '  ' || c_name || chr(9) || c_mktsegment AS v FROM customer
      UNION ALL SELECT 'p', p_partkey, upper(p_name) || '  ' || p_type FROM part
      UNION ALL SELECT 's', s_suppkey, s_name || chr(10) FROM supplier)""",
)
def normalize_entity_value(spark, d):
    t = Tables(spark, d)
    values = (
        t.customer.select(F.lit("c").alias("kind"), F.col("c_custkey").alias("id"), F.concat(F.lit("  "), "c_name", F.lit("\t"), "c_mktsegment").alias("v"))
        .unionByName(t.part.select(F.lit("p").alias("kind"), F.col("p_partkey").alias("id"), F.concat(F.upper("p_name"), F.lit("  "), "p_type").alias("v")))
        .unionByName(t.supplier.select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("id"), F.concat("s_name", F.lit("\n")).alias("v")))
    )
    return values.select("kind", "id", entity_key(F.col("v")).alias("normalized"))


def _entities(t: Tables) -> DataFrame:
    return t.part.select(tag("p", "p_partkey").alias("entity_id"), F.lit("part").alias("entity_type"), F.col("p_name").alias("canonical_name")).unionByName(
        t.supplier.select(tag("s", "s_suppkey").alias("entity_id"), F.lit("supplier").alias("entity_type"), F.col("s_name").alias("canonical_name"))
    )


def _aliases(t: Tables) -> DataFrame:
    parts = t.part.select(
        tag("p", "p_partkey").alias("entity_id"),
        F.posexplode(
            F.array(
                F.struct(F.lit("brand").alias("kind"), F.col("p_brand").alias("value")),
                F.struct(F.lit("name").alias("kind"), F.upper("p_name").alias("value")),
                F.struct(F.lit("brand").alias("kind"), F.concat(F.lit(" "), F.lower("p_brand")).alias("value")),
                F.struct(F.lit("name").alias("kind"), F.concat("p_name", F.lit(" "), "p_type").alias("value")),
                F.struct(F.lit("name").alias("kind"), F.lit("  ").alias("value")),
            )
        ).alias("pos", "a"),
    )
    return parts.select("entity_id", (F.col("pos") + 1).alias("position"), "a.kind", "a.value")


ALIASES_SQL = """
    aliases AS (
      SELECT 'p' || p_partkey AS entity_id, 'part' AS entity_type, 'name' AS kind, lower(p_name) AS normalized, p_name AS value FROM part
      UNION ALL SELECT 'p' || p_partkey, 'part', 'brand', lower(p_brand), p_brand FROM part
      UNION ALL SELECT 'p' || p_partkey, 'part', 'name', lower(p_name || ' ' || p_type), p_name || ' ' || p_type FROM part
      UNION ALL SELECT 's' || s_suppkey, 'supplier', 'name', lower(s_name), s_name FROM supplier)"""


@query("build_aliases", "G2", f"WITH {ALIASES_SQL} SELECT * FROM aliases")
def build_aliases(spark, d):
    t = Tables(spark, d)
    return g.build_aliases(_entities(t), _aliases(t)).drop("position")


@query(
    "resolve_entities",
    "G3",
    f"""WITH {ALIASES_SQL}, mentions AS (
      SELECT 'l' || l_orderkey || '-' || l_linenumber || '-' || l_partkey AS mention_id, 'part' AS entity_type,
        lower(p_name || CASE WHEN l_linenumber % 2 = 0 THEN ' ' || p_type ELSE '' END) AS normalized
      FROM lineitem JOIN part ON p_partkey = l_partkey
      UNION ALL SELECT 's' || s_suppkey, 'supplier', lower(s_name) FROM supplier
      UNION ALL SELECT 'c' || c_custkey, 'supplier', lower(c_name) FROM customer),
    found AS (SELECT entity_type, normalized, count(DISTINCT entity_id) AS n, min(entity_id) AS first_id FROM aliases
      WHERE kind = 'name' GROUP BY ALL)
    SELECT mention_id, m.normalized, coalesce(n, 0) AS candidates,
      CASE WHEN n IS NULL THEN 'unresolved' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status,
      CASE WHEN n = 1 THEN first_id END AS entity_id
    FROM mentions m LEFT JOIN found f USING (entity_type, normalized)""",
)
def resolve_entities(spark, d):
    t = Tables(spark, d)
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat(tag("l", "l_orderkey"), F.lit("-"), "l_linenumber", F.lit("-"), "l_partkey").alias("mention_id"),
        F.lit("part").alias("entity_type"),
        F.concat(
            F.lit(" "),
            F.upper("p_name"),
            F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("  "), "p_type")).otherwise(""),
        ).alias("value"),
    )
    names = t.supplier.select(tag("s", "s_suppkey").alias("mention_id"), F.lit("supplier").alias("entity_type"), F.col("s_name").alias("value")).unionByName(
        t.customer.select(tag("c", "c_custkey").alias("mention_id"), F.lit("supplier").alias("entity_type"), F.col("c_name").alias("value"))
    )
    mentions = lines.unionByName(names).withColumn("kind", F.lit("name"))
    return g.resolve_entities(mentions, g.build_aliases(_entities(t), _aliases(t)))


# Order lines as relations; the chunk of an order belongs to its customer's document.
def _edges(t: Tables):
    n = F.col("l_orderkey")
    tagged = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    return t.lineitem.join(t.orders, n == F.col("o_orderkey")).select(
        tagged("o", n).alias("source_id"),
        F.when(n % 31 == 0, tagged("o", n)).otherwise(tagged("p", F.col("l_partkey"))).alias("target_id"),
        F.when(n % 37 == 0, F.lit(" ")).otherwise(F.lit("contains")).alias("relation_type"),
        F.when(F.col("l_returnflag") == "R", "proposed").when(F.col("l_returnflag") == "A", "Canonical").otherwise("rejected").alias("status"),
        F.col("l_linenumber").alias("valid_from"),
        F.when(n % 41 == 0, F.lit(0)).otherwise(F.lit(10)).alias("valid_to"),
        F.when(n % 43 == 0, F.lit("elsewhere")).otherwise(F.lit(None).cast("string")).alias("collection_id"),
        F.lit(None).cast("string").alias("resource_id"),
        F.when(n % 47 == 0, F.lit("d-1")).otherwise(F.lit(None).cast("string")).alias("document_id"),
        F.when(F.col("l_linenumber") == 3, F.lit(None).cast("string")).otherwise(tagged("k", n)).alias("chunk_id"),
        F.struct("l_linenumber", "l_suppkey", "l_shipdate", "l_extendedprice").alias("created"),
    )


def _provenance(t: Tables):
    chunks = t.orders.select(tag("k", "o_orderkey").alias("chunk_id"), tag("d", "o_custkey").alias("document_id"))
    docs = t.customer.select(tag("d", "c_custkey").alias("document_id"), tag("r", "c_nationkey").alias("resource_id"))
    resources = t.nation.select(tag("r", "n_nationkey").alias("resource_id"), tag("g", "n_regionkey").alias("collection_id"))
    return chunks, docs, resources


RELATIONS_SQL = """
    edges AS (
      SELECT 'o' || l_orderkey AS source_id, CASE WHEN l_orderkey % 31 = 0 THEN 'o' || l_orderkey ELSE 'p' || l_partkey END AS target_id,
        CASE WHEN l_orderkey % 37 = 0 THEN '' ELSE 'contains' END AS relation_type,
        CASE l_returnflag WHEN 'R' THEN 'proposed' WHEN 'A' THEN 'canonical' ELSE 'rejected' END AS status,
        l_linenumber, l_suppkey, l_shipdate, l_extendedprice,
        l_linenumber AS valid_from, CASE WHEN l_orderkey % 41 = 0 THEN 0 ELSE 10 END AS valid_to, l_orderkey AS n,
        CASE WHEN l_linenumber = 3 THEN NULL ELSE 'k' || l_orderkey END AS chunk_id, o_custkey, c_nationkey, n_regionkey
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
    coded AS (
      SELECT *, CASE WHEN source_id = target_id THEN 'self_loop' WHEN relation_type = '' THEN 'blank_type'
        WHEN valid_to < valid_from THEN 'invalid_interval'
        WHEN status = 'proposed' AND chunk_id IS NULL THEN 'proposed_without_chunk'
        WHEN n % 47 = 0 AND chunk_id IS NOT NULL THEN 'chunk_document_mismatch'
        WHEN n % 47 = 0 THEN 'missing_document'
        WHEN n % 43 = 0 AND chunk_id IS NOT NULL THEN 'resource_collection_mismatch' END AS code,
        CASE WHEN chunk_id IS NOT NULL THEN 'g' || n_regionkey WHEN n % 43 = 0 THEN 'elsewhere' ELSE '' END AS collection_id,
        CASE WHEN chunk_id IS NOT NULL THEN 'r' || c_nationkey ELSE '' END AS resource_id,
        CASE WHEN chunk_id IS NOT NULL THEN 'd' || o_custkey ELSE '' END AS document_id FROM edges),
    relations AS (
      SELECT *, sha256(source_id || chr(10) || target_id || chr(10) || relation_type || chr(10) || collection_id || chr(10) ||
        resource_id || chr(10) || document_id || chr(10) || coalesce(chunk_id, '')) AS relation_id FROM coded WHERE code IS NULL
      QUALIFY row_number() OVER (PARTITION BY relation_id
        ORDER BY l_linenumber, l_suppkey, l_shipdate, l_extendedprice, status) = 1)"""


@query(
    "build_relations",
    "G4",
    f"""WITH {RELATIONS_SQL} SELECT relation_id, source_id, target_id, relation_type, status, valid_from, valid_to,
      nullif(collection_id, '') AS collection_id, nullif(document_id, '') AS document_id, chunk_id FROM relations""",
)
def build_relations(spark, d):
    t = Tables(spark, d)
    kept, _ = g.build_relations(_edges(t), *_provenance(t))
    return kept.drop("created", "resource_id", "relation_line")


@query(
    "refused_relations",
    "G4",
    f"WITH {RELATIONS_SQL} SELECT code, count(*) AS edges FROM coded WHERE code IS NOT NULL GROUP BY code",
)
def refused_relations(spark, d):
    t = Tables(spark, d)
    _, refused = g.build_relations(_edges(t), *_provenance(t))
    return refused.groupBy("code").agg(F.count("*").alias("edges"))


# The star schema as one graph: region <- nation <- customer/supplier, customer <- order.
def star_relations(t: Tables) -> DataFrame:
    parts = [
        t.nation.select(tag("n", "n_nationkey").alias("source_id"), tag("r", "n_regionkey").alias("target_id"), F.lit("in_region").alias("relation_type"), F.col("n_nationkey").cast("long").alias("created")),
        t.customer.select(tag("c", "c_custkey").alias("source_id"), tag("n", "c_nationkey").alias("target_id"), F.lit("located_in").alias("relation_type"), F.col("c_custkey").alias("created")),
        t.supplier.select(tag("s", "s_suppkey").alias("source_id"), tag("n", "s_nationkey").alias("target_id"), F.lit("located_in").alias("relation_type"), F.col("s_suppkey").alias("created")),
        t.orders.select(tag("o", "o_orderkey").alias("source_id"), tag("c", "o_custkey").alias("target_id"), F.lit("ordered_by").alias("relation_type"), F.col("o_orderkey").alias("created")),
    ]
    edges = reduce(DataFrame.unionByName, parts)
    return edges.withColumn("relation_id", F.concat_ws(">", "source_id", "target_id")).withColumn("status", F.lit("canonical"))


STAR_SQL = """
    star AS (
      SELECT 'n' || n_nationkey AS s, 'r' || n_regionkey AS t, 'in_region' AS relation_type, CAST(n_nationkey AS BIGINT) AS created FROM nation
      UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'located_in', c_custkey FROM customer
      UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'located_in', s_suppkey FROM supplier
      UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'ordered_by', o_orderkey FROM orders),
    ends AS (SELECT s AS node, t AS other FROM star UNION ALL SELECT t, s FROM star)"""


@query(
    "neighbors",
    "G5",
    f"""WITH {STAR_SQL} SELECT s || '>' || t AS relation_id, relation_type, created FROM star
    WHERE s = 'c1' OR t = 'c1'""",
)
def neighbors(spark, d):
    return g.neighbors(star_relations(Tables(spark, d)), "c1").select("relation_id", "relation_type", "created")


@query(
    "neighbors_inbound",
    "G5",
    f"""WITH {STAR_SQL} SELECT s || '>' || t AS relation_id, created FROM star
    WHERE t = 'n3' AND relation_type = 'located_in' ORDER BY created, relation_id LIMIT 40""",
)
def neighbors_inbound(spark, d):
    found = g.neighbors(star_relations(Tables(spark, d)), "n3", "inbound", "located_in", k=40)
    return found.select("relation_id", "created")


@query(
    "k_hop",
    "G6",
    f"""WITH RECURSIVE {STAR_SQL}, reach AS (
      SELECT 'r' || r_regionkey AS start_id, 'r' || r_regionkey AS node, 0 AS depth FROM region
      UNION SELECT start_id, other, depth + 1 FROM reach JOIN ends USING (node) WHERE depth < 3),
    first AS (SELECT start_id, node, min(depth) AS depth FROM reach GROUP BY ALL)
    SELECT f.start_id, s || '>' || t AS relation_id, min(f.depth) + 1 AS depth, any_value(relation_type) AS relation_type
    FROM first f JOIN star ON node = s OR node = t WHERE f.depth < 3 GROUP BY f.start_id, s, t""",
)
def k_hop(spark, d):
    t = Tables(spark, d)
    starts = t.region.select(tag("r", "r_regionkey").alias("start_id"))
    return g.k_hop(starts, star_relations(t), 3).select("start_id", "relation_id", "depth", "relation_type")


@query(
    "review_relations",
    "G7",
    f"""WITH {RELATIONS_SQL} SELECT relation_id,
      CASE WHEN status = 'proposed' AND n % 3 = 0 THEN 'canonical' WHEN status = 'proposed' AND n % 3 = 1 THEN 'rejected' ELSE status END AS status,
      CASE WHEN status = 'proposed' AND n % 3 < 2 THEN 'rev' || (n % 5) END AS reviewer,
      CASE WHEN n % 3 = 2 AND n % 2 = 0 THEN 'invalid_decision' WHEN n % 3 < 2 AND status <> 'proposed' THEN 'not_proposed' END AS code
    FROM relations""",
)
def review_relations(spark, d):
    t = Tables(spark, d)
    relations, _ = g.build_relations(_edges(t), *_provenance(t))
    n = F.substring(F.col("source_id"), 2, 20).cast("long")
    decisions = relations.where((n % 3 < 2) | (n % 2 == 0)).select(
        "relation_id",
        "relation_line",
        F.when(n % 3 == 0, " Canonical").when(n % 3 == 1, "rejected").otherwise("maybe").alias("decision"),
        F.concat(F.lit("rev"), (n % 5).cast("string")).alias("reviewer"),
    )
    return g.review_relations(relations, decisions, "relation_line").select("relation_id", "status", F.col("review.reviewer").alias("reviewer"), "code")


@query(
    "filter_suggestions",
    "G8",
    """SELECT 'alias' AS kind, 'p' || l_partkey AS entity_id, 'k' || l_orderkey AS chunk_id, count(*) AS n FROM lineitem
      JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey
      WHERE p_size > 10 AND o_orderstatus <> 'P' AND l_returnflag <> 'N' GROUP BY ALL
    UNION ALL
    SELECT 'relation', 'p' || l_partkey, 'k' || l_orderkey, count(*) FROM lineitem
      JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey JOIN part b ON b.p_partkey = l_suppkey
      WHERE part.p_size > 10 AND b.p_size > 10 AND o_orderstatus <> 'P' AND l_partkey <> l_suppkey GROUP BY ALL""",
)
def filter_suggestions(spark, d):
    t = Tables(spark, d)
    entities = t.part.where("p_size > 10").select(tag("p", "p_partkey").alias("entity_id"))
    chunks = t.orders.where("o_orderstatus <> 'P'").select(tag("k", "o_orderkey").alias("chunk_id"))
    aliases = t.lineitem.select(
        tag("p", "l_partkey").alias("entity_id"),
        tag("k", "l_orderkey").alias("chunk_id"),
        F.when(F.col("l_returnflag") == "N", "  ").otherwise(F.col("l_returnflag")).alias("alias"),
    )
    relations = t.lineitem.select(
        tag("p", "l_partkey").alias("source_id"),
        tag("p", "l_suppkey").alias("target_id"),
        tag("k", "l_orderkey").alias("chunk_id"),
        F.lit("made_by").alias("relation_type"),
    )
    kept_a = g.filter_alias_suggestions(aliases, entities, chunks).groupBy(F.lit("alias").alias("kind"), "entity_id", "chunk_id")
    kept_r = g.filter_relation_suggestions(relations, entities, chunks).groupBy(F.lit("relation").alias("kind"), F.col("source_id").alias("entity_id"), "chunk_id")
    return kept_a.agg(F.count("*").alias("n")).unionByName(kept_r.agg(F.count("*").alias("n")))
