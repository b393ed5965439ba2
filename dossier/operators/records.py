"""Record boundaries inside larger assets, and record status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.operators.fields import FieldSpec, json_text, semantic_key, term_map
from dossier.operators.blocks import shuffled
from dossier.operators.cards import offer_cards
from dossier.operators.markup import jsonld_objects

ATTRIBUTE_RECORD_CONFIDENCE = 0.99
BOUNDARY_CONFIDENCE = 0.80


def record_id(asset: Column, provider: Column, source_ref: Column) -> Column:
    """``rec_`` and 24 hex digits over the canonical JSON of asset, provider and position."""
    payload = F.concat(
        F.lit('{"parent_asset_id":'), json_text(asset), F.lit(',"provider":'), json_text(provider), F.lit(',"source_ref":'), json_text(source_ref), F.lit("}")
    )
    return F.concat(F.lit("rec_"), F.substring(F.sha2(payload, 256), 1, 24))


def attribute_records(assets: DataFrame, attribute: str = "records", max_records: int | None = None, key: str = "asset_id") -> DataFrame:
    """Each mapping of an array column as one record; a cap, when given, is reported as a warning."""
    records = F.col(attribute)
    kept = records if max_records is None else F.slice(records, 1, max_records)
    warning = F.lit(None).cast("string")
    if max_records is not None:
        warning = F.when(F.size(records) > max_records, F.lit(f"max_records:{max_records}"))
    rows = assets.select(key, warning.alias("warning"), F.posexplode(kept).alias("ordinal", "attributes"))
    ref = F.concat(F.lit(f"attributes.{attribute}["), F.col("ordinal"), F.lit("]"))
    return rows.select(
        key,
        "ordinal",
        "attributes",
        ref.alias("source_ref"),
        record_id(F.col(key), F.lit("attribute_records"), ref).alias("record_id"),
        F.lit(ATTRIBUTE_RECORD_CONFIDENCE).alias("confidence"),
        "warning",
    )


def jsonld_records(
    assets: DataFrame, specs: Sequence[FieldSpec], min_fields: int = 2, max_records: int | None = None, key: str = "asset_id"
) -> tuple[DataFrame, DataFrame]:
    """JSON-LD objects that name enough wanted fields, and warnings per asset.

    Members are matched to fields by an equi join on the semantic key, then counted per object.
    """
    members = jsonld_objects(assets, key)
    need = min(min_fields, len(specs))
    place = [key, "object_no", "source_ref"]
    named = members.where(~F.col("malformed")).withColumn("skey", semantic_key("name"))
    found = (
        named.select("*", F.inline(F.try_element_at(term_map(specs), F.col("skey"))))
        .groupBy(*place)
        .agg(
            F.sort_array(F.collect_set("field_key")).alias("matched_fields"),
            F.first("object_type").alias("object_type"),
            F.first("object_json").alias("object_json"),
        )
        .where(F.size("matched_fields") >= need)
    )
    order = Window.partitionBy(key).orderBy("object_no")
    numbered = found.withColumn("ordinal", F.row_number().over(order) - 1)
    truncated = None
    if max_records is not None:
        truncated = numbered.where(F.col("ordinal") >= max_records).select(key, F.lit(f"max_records:{max_records}").alias("warning")).distinct()
        numbered = numbered.where(F.col("ordinal") < max_records)
    records = numbered.select(
        key,
        "ordinal",
        "source_ref",
        record_id(F.col(key), F.lit("jsonld_records"), F.col("source_ref")).alias("record_id"),
        F.least(F.lit(0.99), F.lit(0.92) + F.lit(0.02) * F.least(F.size("matched_fields"), F.lit(3))).alias("confidence"),
        "matched_fields",
        "object_type",
        "object_json",
    )
    warnings = members.where("malformed").select(key, F.concat(F.lit("malformed_jsonld:"), "block_ref").alias("warning"))
    return records, warnings if truncated is None else warnings.unionByName(truncated)


def semantic_html_records(assets: DataFrame, minimum: float = 0.80, max_records: int | None = None, key: str = "asset_id") -> DataFrame:
    """Offer cards of each page; equal card paths are settled by the strongest signal."""
    cards = offer_cards(assets, key, minimum)
    order = Window.partitionBy(key).orderBy("path")
    numbered = cards.withColumn("ordinal", F.row_number().over(order) - 1)
    if max_records is not None:
        numbered = numbered.where(F.col("ordinal") < max_records)
    return numbered.withColumnRenamed("path", "source_ref").withColumn(
        "record_id", record_id(F.col(key), F.lit("semantic_html_records"), F.col("source_ref"))
    )


def record_status(records: DataFrame, decisions: DataFrame, threshold: float = BOUNDARY_CONFIDENCE, key: str = "record_id") -> DataFrame:
    """rejected > boundary to confirm > field to confirm > incomplete > ready.

    records: record_id, confidence, rejected; decisions: record_id, field_key, required, status.
    """
    per = decisions.groupBy(key).agg(
        F.bool_or(F.col("status") == "needs_confirmation").alias("review"),
        F.bool_or(F.col("required") & F.col("status").isin("unresolved", "rejected")).alias("open"),
    )
    joined = records.join(shuffled(per), key, "left")
    return joined.select(
        key,
        F.when(F.col("rejected"), "rejected")
        .when((F.col("confidence") < threshold) | F.coalesce("review", F.lit(False)), "needs_confirmation")
        .when(F.coalesce("open", F.lit(False)), "incomplete")
        .otherwise("ready")
        .alias("status"),
    )
