"""Site profiles: evidence fingerprints learned from review, applied with limits and decay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.text import casefold, collapse_space, strip
from dossier.operators.fields import json_text

STEP_UP, STEP_DOWN, MAX_UP, MAX_DOWN, MAX_CONFIDENCE = 0.06, 0.08, 0.18, 0.24, 0.99
DAY = 86_400
HALF_LIFE_DAYS = 30.0
MAX_AGE_DAYS = 180.0
PRUNE_WEIGHT = 0.01


def normalized_ref(column: Column) -> Column:
    """Indexes become [*], line numbers line:*."""
    return F.regexp_replace(
        F.regexp_replace(collapse_space(column), r"\[\d+\]", "[*]"), r"(?i)\bline:\d+\b", "line:*"
    )


def evidence_fingerprints(candidates: DataFrame) -> DataFrame:
    """Distinct fingerprints per candidate (all candidate columns but evidence and terms are kept)."""
    terms = F.array_sort(
        F.array_distinct(
            F.filter(F.transform("matched_terms", lambda t: casefold(collapse_space(t))), lambda t: t != "")
        )
    )
    keep = [c for c in candidates.columns if c not in ("evidence", "matched_terms", "signal_kinds")]
    spread = candidates.select(*keep, terms.alias("__terms"), F.explode("evidence").alias("__e"))
    kind = casefold(strip(F.col("__e.kind")))
    ref = normalized_ref(F.col("__e.source_ref"))
    text = F.concat(
        F.lit("["), json_text(kind), F.lit(","), json_text(ref), F.lit(",["), F.array_join(F.transform("__terms", json_text), ","), F.lit("]]")
    )
    return (
        spread.where((strip(F.col("__e.kind")) != "") & (strip(F.col("__e.source_ref")) != ""))
        .select(*keep, text.alias("fingerprint"))
        .distinct()
    )


def learn_profiles(selections: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Confirmations and rejections per (site, field, fingerprint).

    selections: review_id, site_key, field_key, selected_id (null = all rejected);
    fingerprints: review_id, field_key, candidate_id, fingerprint. A fingerprint of the
    selected candidate counts for it even when other candidates share it.
    """
    seen = selections.join(fingerprints, ["review_id", "field_key"])
    per_review = seen.groupBy("review_id", "site_key", "field_key", "fingerprint").agg(
        F.bool_or(F.coalesce(F.col("candidate_id") == F.col("selected_id"), F.lit(False))).alias("positive")
    )
    return per_review.groupBy("site_key", "field_key", "fingerprint").agg(
        F.count_if("positive").alias("confirmations"), F.count_if(~F.col("positive")).alias("rejections")
    )


def adjustment(confirmations: Column, rejections: Column) -> Column:
    return F.least(F.lit(MAX_UP), confirmations * STEP_UP) - F.least(F.lit(MAX_DOWN), rejections * STEP_DOWN)


def adjust_confidence(fingerprints: DataFrame, profiles: DataFrame) -> DataFrame:
    """New confidence per candidate: best positive plus worst negative pattern of its site.

    fingerprints: asset_id, site_key, field_key, candidate_id, confidence, fingerprint.
    """
    delta = adjustment(F.col("confirmations"), F.col("rejections"))
    known = profiles.select("site_key", "field_key", "fingerprint", delta.alias("delta"))
    joined = fingerprints.join(known, ["site_key", "field_key", "fingerprint"], "left")
    per = joined.groupBy("asset_id", "field_key", "candidate_id", "confidence").agg(
        (
            F.coalesce(F.max(F.when(F.col("delta") > 0, F.col("delta"))), F.lit(0.0))
            + F.coalesce(F.min(F.when(F.col("delta") < 0, F.col("delta"))), F.lit(0.0))
        ).alias("adjustment")
    )
    moved = F.greatest(F.lit(0.0), F.least(F.lit(MAX_CONFIDENCE), F.col("confidence") + F.col("adjustment")))
    return per.withColumn("adjusted", F.when(F.col("adjustment") == 0, F.col("confidence")).otherwise(moved))


def decay_profiles(
    feedback: DataFrame, as_of: Column, half_life_days: float = HALF_LIFE_DAYS, max_age_days: float = MAX_AGE_DAYS
) -> DataFrame:
    """Decayed weights per (site_key, field_key, fingerprint) at ``as_of`` (whole seconds).

    feedback: site_key, field_key, fingerprint, at (seconds), positive. Each event halves every
    ``half_life_days``; a silence of ``max_age_days`` clears what came before. Events of one
    pattern and day collapse to one row before any ordering, so the window that looks for
    silences sees days, not events.
    """
    key = ["site_key", "field_key", "fingerprint"]
    age = (as_of - F.col("at")) / F.lit(half_life_days * DAY)
    weight = F.pow(F.lit(0.5), age)
    daily = (
        feedback.where(F.col("at") <= as_of)
        .groupBy(*key, F.floor(F.col("at") / DAY).alias("day"))
        .agg(
            F.min("at").alias("first_at"),
            F.max("at").alias("last_at"),
            F.sum(F.when(F.col("positive"), weight).otherwise(0.0)).alias("up"),
            F.sum(F.when(F.col("positive"), 0.0).otherwise(weight)).alias("down"),
        )
    )
    order = Window.partitionBy(*key).orderBy(F.desc("day"))
    silence = F.lead("last_at").over(order)
    breaks = F.coalesce((F.col("first_at") - silence) >= max_age_days * DAY, F.lit(False)).cast("int")
    after = F.sum("__break").over(order.rowsBetween(Window.unboundedPreceding, -1))
    live = daily.withColumn("__break", breaks).withColumn("__after", F.coalesce(after, F.lit(0)))
    current = F.col("__after") == 0
    per = live.groupBy(*key).agg(
        F.max("last_at").alias("updated_at"),
        F.sum(F.when(current, F.col("up")).otherwise(0.0)).alias("up"),
        F.sum(F.when(current, F.col("down")).otherwise(0.0)).alias("down"),
    )
    expired = (as_of - F.col("updated_at")) >= max_age_days * DAY
    return per.select(
        *key,
        "updated_at",
        F.when(expired, 0.0).otherwise(F.col("up")).alias("confirmations"),
        F.when(expired, 0.0).otherwise(F.col("down")).alias("rejections"),
    ).withColumn("prune", expired | (F.col("confirmations") + F.col("rejections") <= PRUNE_WEIGHT))


def prune_report(decayed: DataFrame) -> DataFrame:
    """Patterns, fields and sites that pruning removes."""
    fields = decayed.groupBy("site_key", "field_key").agg(F.bool_and("prune").alias("gone"), F.count_if("prune").alias("patterns"))
    sites = fields.groupBy("site_key").agg(
        F.bool_and("gone").alias("gone"), F.count_if("gone").alias("fields"), F.sum("patterns").alias("patterns")
    )
    return sites.agg(
        F.coalesce(F.sum("patterns"), F.lit(0)).alias("removed_patterns"),
        F.coalesce(F.sum("fields"), F.lit(0)).alias("removed_fields"),
        F.count_if("gone").alias("removed_sites"),
    )
