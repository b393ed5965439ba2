"""Entities, aliases, relations and bounded traversal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.text import entity_key, strip
from dossier.operators.blocks import computed, kind_of, top_k
from dossier.session import cut_lineage

STATUSES = ("canonical", "proposed", "rejected")
# What the id of a relation is made of, in this order.
LINE = ("source_id", "target_id", "relation_type", "collection_id", "resource_id", "document_id", "chunk_id")


def build_aliases(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Alias rows per entity; the canonical name is an alias of kind ``name`` and comes first.

    entities: entity_id, entity_type, canonical_name; aliases: entity_id, position (from 1),
    kind, value. Blank kinds or values are dropped; the first of equal (kind, normalised) stays.
    """
    names = entities.select(
        "entity_id", "entity_type", F.lit(0).alias("position"), F.lit("name").alias("kind"), F.col("canonical_name").alias("value")
    )
    extra = aliases.join(entities.select("entity_id", "entity_type"), "entity_id").select(
        "entity_id", "entity_type", F.col("position").cast("int"), "kind", "value"
    )
    keyed = names.unionByName(extra).select(
        "entity_id",
        "entity_type",
        "position",
        strip(F.col("kind")).alias("kind"),
        strip(F.col("value")).alias("value"),
    )
    keyed = keyed.where((F.col("kind") != "") & (F.col("value") != "")).withColumn("normalized", entity_key(F.col("value")))
    return (
        keyed.where("normalized <> ''")
        .groupBy("entity_id", "entity_type", "kind", "normalized")
        .agg(F.min_by("value", "position").alias("value"), F.min("position").alias("position"))
    )


def resolve_entities(mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Exact normalised match of mentions (mention_id, entity_type, kind, value).

    Mentions are reduced to distinct keys before the alias join, so a popular name is
    matched once however often it is mentioned.
    """
    keyed = mentions.withColumn("normalized", entity_key(F.col("value")))
    key = ["entity_type", "kind", "normalized"]
    found = (
        aliases.join(keyed.select(*key).distinct(), key, "left_semi")
        .groupBy(*key)
        .agg(F.count_distinct("entity_id").alias("candidates"), F.min("entity_id").alias("first_id"))
    )
    count = F.coalesce("candidates", F.lit(0))
    return keyed.join(found, key, "left").select(
        "mention_id",
        "normalized",
        count.alias("candidates"),
        F.when(count == 0, "unresolved").when(count == 1, "resolved").otherwise("ambiguous").alias("status"),
        F.when(count == 1, F.col("first_id")).alias("entity_id"),
    )


def provenance_key(edges: DataFrame) -> DataFrame:
    """``__level`` and ``__id`` of the most specific id an edge carries.

    An edge without any has no level and so meets nothing; it keeps its source as id, since edges of one null key
    would all be shuffled to one task.
    """
    return edges.withColumn("__level", provenance_level()).withColumn("__id", provenance_id())


def provenance_level() -> Column:
    return (
        F.when(F.col("chunk_id").isNotNull(), "chunk").when(F.col("document_id").isNotNull(), "document").when(F.col("resource_id").isNotNull(), "resource")
    )


def provenance_id() -> Column:
    return F.coalesce(*[F.col(c).cast("string") for c in ("chunk_id", "document_id", "resource_id", "source_id")])


def build_relations(
    edges: DataFrame, chunks: DataFrame, documents: DataFrame, resources: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Validated relations with filled provenance, and refused edges with a code.

    edges: source_id, target_id, relation_type, status, valid_from, valid_to, collection_id,
    resource_id, document_id, chunk_id, created. Equal relation ids keep the first created.
    Relations carry ``relation_line``, what their id is the digest of, and are partitioned by it.
    """
    # The provenance chain is joined among the stored tables first; every edge then meets it
    # once, at the most specific id it carries.
    stored = resources.select(F.col("resource_id").alias("__resource"), F.col("collection_id").alias("__k"), F.lit(True).alias("__rh"))
    by_document = documents.select(F.col("document_id").alias("__document"), F.col("resource_id").alias("__r"), F.lit(True).alias("__dh")).join(
        stored, F.col("__r") == F.col("__resource"), "left"
    )
    by_chunk = chunks.select("chunk_id", F.col("document_id").alias("__d"), F.lit(True).alias("__c")).join(
        by_document, F.col("__d") == F.col("__document"), "left"
    )
    chain = ["__c", "__d", "__dh", "__r", "__rh", "__k"]
    text, flag = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    lookup = (
        by_chunk.select(F.lit("chunk").alias("__level"), F.col("chunk_id").cast("string").alias("__id"), *chain)
        .unionByName(
            by_document.select(
                F.lit("document").alias("__level"), F.col("__document").cast("string").alias("__id"), flag.alias("__c"), text.alias("__d"),
                "__dh", "__r", "__rh", "__k",
            )
        )
        .unionByName(
            stored.select(
                F.lit("resource").alias("__level"), F.col("__resource").cast("string").alias("__id"), flag.alias("__c"), text.alias("__d"),
                flag.alias("__dh"), text.alias("__r"), "__rh", "__k",
            )
        )
    )
    def meet(some: DataFrame) -> DataFrame:
        return (
            some.join(lookup, (provenance_level() == F.col("__level")) & (provenance_id() == F.col("__id")), "left")
            .withColumn("__document", F.coalesce("__d", "document_id"))
            .withColumn("__resource", F.coalesce("__r", "resource_id"))
            .withColumn("__collection", F.coalesce("__k", "collection_id"))
        )

    clash = lambda given, true: given.isNotNull() & true.isNotNull() & (given != true)
    kind, status = strip(F.col("relation_type")), F.lower(strip(F.col("status")))
    by_itself = (
        F.when(F.col("source_id") == F.col("target_id"), "self_loop")
        .when(kind == "", "blank_type")
        .when(~status.isin(*STATUSES), "invalid_status")
        .when(F.col("valid_to") < F.col("valid_from"), "invalid_interval")
        .when((status == "proposed") & F.col("chunk_id").isNull(), "proposed_without_chunk")
    )
    by_provenance = (
        F.when(F.col("chunk_id").isNotNull() & F.col("__c").isNull(), "missing_chunk")
        .when(clash(F.col("document_id"), F.col("__d")), "chunk_document_mismatch")
        .when(F.col("__document").isNotNull() & F.col("__dh").isNull(), "missing_document")
        .when(clash(F.col("resource_id"), F.col("__r")), "document_resource_mismatch")
        .when(F.col("__resource").isNotNull() & F.col("__rh").isNull(), "missing_resource")
        .when(clash(F.col("collection_id"), F.col("__k")), "resource_collection_mismatch")
    )
    refused = (
        meet(edges)
        .withColumn("code", F.coalesce(by_itself, by_provenance))
        .where("code IS NOT NULL")
        .select("source_id", "target_id", "relation_type", "created", "code")
    )
    # What an edge is refused for by itself is known before it travels to the stored tables.
    sound = computed(edges, relation_type=kind, status=status, __code=by_itself).where("__code IS NULL").drop("__code")
    filled = meet(sound).where(by_provenance.isNull()).select(
        "source_id",
        "target_id",
        "relation_type",
        "status",
        "valid_from",
        "valid_to",
        F.col("__collection").alias("collection_id"),
        F.col("__resource").alias("resource_id"),
        F.col("__document").alias("document_id"),
        "chunk_id",
        "created",
    )
    return first_of_line(filled), refused


def first_of_line(filled: DataFrame) -> DataFrame:
    """The first created of the relations of one id, with ``relation_id`` and ``relation_line``.

    Relations are grouped by the line itself, which holds every part: its digest and the parts would travel beside it.
    Parts that their line does not give back (empty, with a newline, of a type other than text and numbers) stay whole.
    """
    kinds = {c: kind_of(filled, c) for c in LINE}
    text = {c: F.col(c).cast("string") for c in LINE}
    unclear = F.lit(any(k not in ("string", "int", "bigint") for k in kinds.values()))
    for value in text.values():
        unclear = unclear | F.coalesce((value == "") | F.contains(value, F.lit("\n")), F.lit(False))
    line = F.concat_ws("\n", *[F.coalesce(value, F.lit("")) for value in text.values()])
    own = ["created", "status", "valid_from", "valid_to"]
    whole = F.struct(*own, F.when(unclear, F.struct(*LINE)).alias("parts"))
    lines = computed(filled, relation_line=line, r=whole).select("relation_line", "r")
    first = computed(lines.groupBy("relation_line").agg(F.min("r").alias("r")), told=F.split("relation_line", "\n"))
    parts = {
        c: F.when(F.col("r.parts").isNotNull(), F.col(f"r.parts.{c}")).otherwise(F.nullif(F.get("told", F.lit(i)), F.lit("")).cast(kinds[c]))
        for i, c in enumerate(LINE)
    }
    values = {**parts, **{c: F.col(f"r.{c}") for c in own}}
    return first.select(
        F.sha2("relation_line", 256).alias("relation_id"), *[values[c].alias(c) for c in filled.columns], "relation_line"
    )


def neighbors(
    relations: DataFrame,
    entity_id: str,
    direction: str = "both",
    relation_type: str | None = None,
    status: str | None = "canonical",
    k: int | None = None,
) -> DataFrame:
    """Relations of one entity, oldest first; the first ``k`` of them when given."""
    source, target = F.col("source_id") == entity_id, F.col("target_id") == entity_id
    scope: dict[str, Column] = {"outbound": source, "inbound": target, "both": source | target}
    if direction not in scope:
        raise ValueError("direction must be outbound, inbound or both")
    found = relations.where(scope[direction])
    if relation_type:
        found = found.where(F.col("relation_type") == relation_type.strip())
    if status is not None:
        found = found.where(F.col("status") == status)
    ordered = found.orderBy("created", "relation_id")
    return ordered if k is None else ordered.limit(k)


def k_hop(
    starts: DataFrame, relations: DataFrame, max_depth: int, relation_type: str | None = None, limit: int | None = None
) -> DataFrame:
    """Undirected breadth-first traversal from every start at once.

    starts: start_id; relations: relation_id, source_id, target_id, relation_type, status,
    created. Each relation appears once per start, at its smallest depth, with the node it
    was reached from. ``limit`` caps the relations read per node (by created, id) and the
    result per start; without it nothing is cut. One join with the frontier per level; the
    level's rows are checkpointed, so lost executors replay one level only.
    """
    if max_depth < 1:
        raise ValueError("max_depth must be positive")
    usable = relations.where(F.col("status") == "canonical")
    if relation_type:
        usable = usable.where(F.col("relation_type") == relation_type)
    cols = ["relation_id", "source_id", "target_id", "relation_type", "created"]
    ends = usable.select(F.col("source_id").alias("node"), F.col("target_id").alias("other"), *cols).unionByName(
        usable.select(F.col("target_id").alias("node"), F.col("source_id").alias("other"), *cols)
    )
    frontier = starts.select("start_id", F.col("start_id").alias("node")).distinct()
    visited = frontier
    found = None
    for depth in range(1, max_depth + 1):
        step = frontier.join(ends, "node")
        if limit is not None:
            step = step.withColumn("__pair", F.struct("start_id", "node"))
            step = top_k(step, "__pair", [F.col("created"), F.col("relation_id")], limit, "__nth").drop("__pair", "__nth")
        if found is not None:
            step = step.join(found.select("start_id", "relation_id"), ["start_id", "relation_id"], "left_anti")
        # A relation between two frontier nodes belongs to the smaller one.
        level = step.groupBy("start_id", "relation_id").agg(
            F.min_by(F.struct("node", "other", "source_id", "target_id", "relation_type", "created"), "node").alias("e")
        )
        level = cut_lineage(level.select("start_id", "relation_id", F.lit(depth).alias("depth"), "e.*"))
        found = level if found is None else found.unionByName(level)
        if depth == max_depth:
            break
        frontier = (
            level.select("start_id", F.col("other").alias("node"))
            .distinct()
            .join(visited, ["start_id", "node"], "left_anti")
        )
        frontier = cut_lineage(frontier)
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    if limit is not None:
        found = top_k(
            found, "start_id", [F.col("depth"), F.col("node"), F.col("created"), F.col("relation_id")], limit, "__nth"
        ).drop("__nth")
    return found.drop("other")


def review_relations(relations: DataFrame, decisions: DataFrame, key: str = "relation_id") -> DataFrame:
    """Apply canonical/rejected decisions to proposed relations; others carry an error code.

    ``key``: the column of both by which they meet, such as one that they are partitioned by.
    """
    joined = relations.join(decisions.select(key, "decision", "reviewer"), key, "left")
    decision = F.lower(strip(F.col("decision")))
    valid = decision.isin("canonical", "rejected")
    apply = F.coalesce(valid & (F.col("status") == "proposed"), F.lit(False))
    return joined.select(
        *[c for c in relations.columns if c != "status"],
        F.when(apply, decision).otherwise(F.col("status")).alias("status"),
        F.when(apply, F.struct(decision.alias("decision"), "reviewer")).alias("review"),
        F.when(F.col("decision").isNull() | apply, F.lit(None))
        .when(~valid, "invalid_decision")
        .otherwise("not_proposed")
        .alias("code"),
    )


def filter_alias_suggestions(suggested: DataFrame, entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """Alias suggestions about supplied entities and chunks only, non-blank."""
    return (
        suggested.withColumn("alias", strip(F.col("alias")))
        .where("alias <> ''")
        .join(entities.select("entity_id"), "entity_id", "left_semi")
        .join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    )


def filter_relation_suggestions(suggested: DataFrame, entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """Relation suggestions between two different supplied entities with a supplied chunk."""
    known = entities.select("entity_id")
    return (
        suggested.withColumn("relation_type", strip(F.col("relation_type")))
        .where((F.col("relation_type") != "") & (F.col("source_id") != F.col("target_id")))
        .join(known.withColumnRenamed("entity_id", "source_id"), "source_id", "left_semi")
        .join(known.withColumnRenamed("entity_id", "target_id"), "target_id", "left_semi")
        .join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    )


def multi_hop_eval(scenarios: DataFrame, traversal: DataFrame) -> DataFrame:
    """Check scenarios against a traversal whose rows carry an ``evidence`` flag.

    scenarios: scenario_id, start_id, target_id, max_depth, expected_depth, required_types,
    expected_evidence; traversal: start_id, depth, source_id, target_id, relation_type, evidence.
    """
    # The traversal is reduced to one row per (start, node) and per (start, type, depth), so
    # a scenario meets a handful of rows however large the neighbourhood of its start is.
    depth_of = (
        traversal.select("start_id", "depth", F.explode(F.array("source_id", "target_id")).alias("target_id"))
        .groupBy("start_id", "target_id")
        .agg(F.min("depth").alias("target_depth"))
    )
    by_type = traversal.groupBy("start_id", "relation_type", "depth").agg(F.count_if("evidence").alias("with_evidence"))
    near = F.col("target_depth") <= F.col("max_depth")
    reached_rows = scenarios.join(depth_of, ["start_id", "target_id"], "left").withColumn(
        "target_depth", F.when(near, F.col("target_depth"))
    )
    needed = (F.col("depth") <= F.col("max_depth")) & F.array_contains("required_types", F.col("relation_type"))
    per = (
        reached_rows.join(by_type, "start_id", "left")
        .groupBy("scenario_id", "expected_depth", "required_types", "expected_evidence", "target_depth")
        .agg(
            F.collect_set(F.when(needed, F.col("relation_type"))).alias("types"),
            F.coalesce(F.sum(F.when(needed, F.col("with_evidence"))), F.lit(0)).alias("evidence_edges"),
        )
    )
    reached = F.coalesce(F.col("target_depth") == F.col("expected_depth"), F.lit(False))
    typed = F.size(F.array_except("required_types", "types")) == 0
    complete = F.col("evidence_edges") >= F.col("expected_evidence")
    return per.select(
        "scenario_id",
        "target_depth",
        reached.alias("target_reached"),
        typed.alias("required_relations_found"),
        "evidence_edges",
        complete.alias("provenance_complete"),
        (reached & typed & complete).alias("passed"),
    )
