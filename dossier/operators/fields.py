"""Field extraction: label lines, matching, corroboration, coercion, resolution, confirmation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from dossier.functions.text import collapse_space, computed_once
from dossier.operators.blocks import computed, shuffled

LABEL_CONFIDENCE = 0.72
ALIAS_COST = 0.02
KIND_BONUS, MAX_BONUS, MAX_CONFIDENCE = 0.03, 0.09, 0.99
ATTRIBUTE_CONFIDENCE = 0.95
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1c-\x1e\x85\u2028\u2029]"
LABEL_VALUE = r"^\s*(.+?)\s*(?::|—|–|-)\s+(.+?)\s*$"


@dataclass(frozen=True)
class FieldSpec:
    """One wanted field: its key, aliases, type and acceptance limits."""

    key: str
    required: bool = False
    value_type: str = "auto"
    min_confidence: float = 0.80
    min_margin: float = 0.10
    aliases: tuple[str, ...] = ()

    def __post_init__(self):
        if not self.key.strip() or self.value_type not in ("auto", "string", "integer", "number", "boolean"):
            raise ValueError("a field needs a key and a known value type")
        if not (0 <= self.min_confidence <= 1 and 0 <= self.min_margin <= 1):
            raise ValueError("limits must lie between 0 and 1")
        if len({a.strip().casefold() for a in self.aliases}) != len(self.aliases):
            raise ValueError("aliases must be unique")


@lru_cache(maxsize=4096)
def semantic_name(value: str) -> str:
    """Members of many objects have the same few names, so a worker keeps those it met last."""
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFKC", value or "").casefold() if c.isalnum())


@computed_once
@F.pandas_udf(StringType())
def semantic_key(values: pd.Series) -> pd.Series:
    """Letters and digits of the NFKC case-folded name."""
    return values.map(semantic_name)


def json_text(column: Column) -> Column:
    """A string as a JSON string literal."""
    text = F.to_json(F.struct(column.cast("string").alias("v")))
    return F.substring(text, F.lit(6), F.char_length(text) - 6)


def text_label_values(assets: DataFrame, key: str = "asset_id", text: str = "text") -> DataFrame:
    """``label: value`` lines as signals."""
    raw = assets.select(key, F.posexplode(F.split(F.col(text), LINE_BREAK)).alias("pos", "raw"))
    lines = computed(raw, line=collapse_space(F.col("raw"))).select(key, (F.col("pos") + 1).alias("line_no"), "line")
    # One pass of the pattern per line: a matching line becomes label, mark, value.
    parts = F.split(F.regexp_replace("line", LABEL_VALUE, "$1\u0001$2"), "\u0001")
    split = (
        computed(lines.where(F.col("line").rlike("[:—–-]\\s")), parts=parts)
        .where(F.size("parts") == 2)
        .select(
            key,
            "line_no",
            "line",
            collapse_space(F.col("parts")[0]).alias("name"),
            collapse_space(F.col("parts")[1]).alias("value"),
        )
    )
    return split.where((F.col("name") != "") & (F.col("value") != "")).select(
        key,
        "name",
        json_text(F.col("value")).alias("value_json"),
        F.lit(LABEL_CONFIDENCE).alias("confidence"),
        F.lit("text_label_value").alias("kind"),
        F.concat(F.lit("line:"), "line_no").alias("source_ref"),
        F.col("line").alias("excerpt"),
    )


def _term_rows(specs: Sequence[FieldSpec]) -> list[tuple[str, str, str, float]]:
    """(semantic key, field, matched term, cost); the key beats aliases, earlier aliases later ones."""
    rows = {}
    for spec in specs:
        for term, cost in [(spec.key, 0.0), *[(a, ALIAS_COST) for a in spec.aliases]]:
            name = semantic_name(term)
            if name:
                rows.setdefault((name, spec.key), (name, spec.key, term, cost))
    return list(rows.values())


def term_map(specs: Sequence[FieldSpec]) -> Column:
    """Semantic key -> the fields it names, as a literal: matching then needs no join."""
    by_key: dict[str, list[Column]] = {}
    for skey, field, term, cost in _term_rows(specs):
        entry = F.struct(F.lit(field).alias("field_key"), F.lit(term).alias("term"), F.lit(cost).alias("cost"))
        by_key.setdefault(skey, []).append(entry)
    return F.create_map(*[x for skey, entries in by_key.items() for x in (F.lit(skey), F.array(*entries))])


def match_fields(signals: DataFrame, specs: Sequence[FieldSpec]) -> DataFrame:
    """Signals that name a wanted field by key or alias, with adjusted confidence."""
    keyed = signals.where((F.col("value_json") != '""') & (F.col("value_json") != "null")).withColumn(
        "skey", semantic_key("name")
    )
    return (
        keyed.select("*", F.inline(F.try_element_at(term_map(specs), F.col("skey"))))
        .withColumn("confidence", F.greatest(F.lit(0.0), F.col("confidence") - F.col("cost")))
        .drop("skey", "cost")
    )


def candidate_id(field: Column, provider: Column, value_json: Column) -> Column:
    """20 hex digits of the sha256 over the candidate's canonical JSON."""
    payload = F.concat(
        F.lit('{"field_key":'), json_text(field), F.lit(',"provider":'), json_text(provider), F.lit(',"value":'), value_json, F.lit("}")
    )
    return F.substring(F.sha2(payload, 256), 1, 20)


def corroborate(matches: DataFrame, key: str = "asset_id", provider: str = "auto_discovery") -> DataFrame:
    """One candidate per (asset, field, value): best confidence plus a bonus per further kind."""
    order = F.struct((-F.col("confidence")).alias("c"), "kind", "source_ref", "excerpt", "term")
    grouped = matches.groupBy(key, "field_key", "value_json").agg(
        F.max("confidence").alias("best"),
        F.count_distinct("kind").alias("kinds"),
        F.sort_array(F.collect_set(order)).alias("rows"),
    )
    bonus = F.least(F.lit(MAX_BONUS), F.lit(KIND_BONUS) * (F.col("kinds") - 1))
    evidence = F.array_distinct(
        F.transform("rows", lambda r: F.struct(r["kind"].alias("kind"), r["source_ref"].alias("source_ref"), r["excerpt"].alias("excerpt")))
    )
    return grouped.select(
        key,
        "field_key",
        "value_json",
        F.least(F.lit(MAX_CONFIDENCE), F.col("best") + bonus).alias("confidence"),
        F.lit(provider).alias("provider"),
        evidence.alias("evidence"),
        F.array_distinct(F.transform("rows", lambda r: r["term"])).alias("matched_terms"),
        F.array_distinct(F.transform("rows", lambda r: r["kind"])).alias("signal_kinds"),
        candidate_id(F.col("field_key"), F.lit(provider), F.col("value_json")).alias("candidate_id"),
    )


def attribute_candidates(assets: DataFrame, mapping: Mapping[str, str], key: str = "asset_id", provider: str = "attributes") -> DataFrame:
    """Mapped entries of the attribute map as candidates; blanks are skipped."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field_key"), F.lit(a).alias("attribute")) for f, a in mapping.items()])
    rows = assets.select(key, "attributes", F.explode(pairs).alias("p")).select(
        key, "p.field_key", "p.attribute", F.try_element_at("attributes", F.col("p.attribute")).alias("value")
    )
    rows = rows.where(F.col("value").isNotNull() & (F.col("value") != "")).withColumn("value_json", json_text(F.col("value")))
    return rows.select(
        key,
        "field_key",
        "value_json",
        F.lit(ATTRIBUTE_CONFIDENCE).alias("confidence"),
        F.lit(provider).alias("provider"),
        F.array(
            F.struct(
                F.lit("structured_attribute").alias("kind"), F.col("attribute").alias("source_ref"), F.col("value").alias("excerpt")
            )
        ).alias("evidence"),
        F.array().cast("array<string>").alias("matched_terms"),
        F.array().cast("array<string>").alias("signal_kinds"),
        candidate_id(F.col("field_key"), F.lit(provider), F.col("value_json")).alias("candidate_id"),
    )


# Words read as booleans.
TRUE_WORDS = ("true", "yes", "да", "1")
FALSE_WORDS = ("false", "no", "нет", "0")


def coerce(value_json: Column, value_type: Column) -> Column:
    """The value as JSON of the wanted type, null where it cannot be read as that type."""
    is_text = F.substring(value_json, 1, 1) == '"'
    is_flag = value_json.isin("true", "false")
    is_number = value_json.rlike(r"^-?[0-9]")
    # A JSON string literal decoded back to plain text.
    plain = F.when(is_text, F.get_json_object(F.concat(F.lit('{"v":'), value_json, F.lit("}")), "$.v")).otherwise(value_json)
    bare = F.regexp_replace(F.trim(plain), "[ \\u00a0]", "")
    whole = F.when(bare.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"), F.replace(bare, F.lit("_"), F.lit("")))
    integer = whole.try_cast("decimal(38,0)").cast("string")
    dotted = F.replace(bare, F.lit(","), F.lit("."))
    number = F.when(
        dotted.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), dotted.try_cast("double").cast("string")
    )
    word = F.lower(F.trim(plain))
    flag = F.when(word.isin(*TRUE_WORDS), "true").when(word.isin(*FALSE_WORDS), "false")
    return (
        F.when(value_type == "auto", value_json)
        .when(value_type == "string", F.when(is_text, value_json).otherwise(json_text(value_json)))
        .when(value_type == "integer", F.when(is_number & value_json.rlike(r"^-?[0-9]+$"), value_json).when(~is_flag, integer))
        .when(value_type == "number", F.when(is_number, value_json).when(~is_flag, number))
        .when(value_type == "boolean", F.when(is_flag, value_json).otherwise(flag))
    )


def coerce_candidates(candidates: DataFrame, specs: Sequence[FieldSpec]) -> DataFrame:
    """Candidates of wanted fields with their value in the wanted type; unreadable values are dropped."""
    types = F.create_map(*[F.lit(x) for s in specs for x in (s.key, s.value_type)])
    wanted = candidates.where(F.col("field_key").isin([s.key for s in specs]))
    typed = computed(wanted, value_json=coerce(F.col("value_json"), types[F.col("field_key")]))
    return typed.where(F.col("value_json").isNotNull()).withColumn(
        "candidate_id", candidate_id(F.col("field_key"), F.col("provider"), F.col("value_json"))
    )


def resolve_fields(assets: DataFrame, candidates: DataFrame, specs: Sequence[FieldSpec], key: str = "asset_id") -> DataFrame:
    """One decision per (asset, field): automatic, to be confirmed, or unresolved.

    The wanted fields are a short declared list, so each asset row is exploded by it; the
    candidates of one asset and field are a small sorted array.
    """
    wanted = F.array(
        *[
            F.struct(
                F.lit(s.key).alias("field_key"),
                F.lit(s.required).alias("required"),
                F.lit(float(s.min_confidence)).alias("min_confidence"),
                F.lit(float(s.min_margin)).alias("min_margin"),
            )
            for s in specs
        ]
    )
    asked = assets.select(key, F.explode(wanted).alias("s")).select(key, "s.*")
    best_first = F.struct((-F.col("confidence")).alias("c"), "provider", "candidate_id", "value_json")
    ranked = candidates.groupBy(key, "field_key").agg(F.sort_array(F.collect_list(best_first)).alias("ranked"))
    joined = asked.join(shuffled(ranked), [key, "field_key"], "left")
    top, second = F.get("ranked", F.lit(0)), F.get("ranked", F.lit(1))
    confidence = -top["c"]
    unsure = (confidence < F.col("min_confidence")) | F.coalesce(
        (confidence + second["c"]) < F.col("min_margin"), F.lit(False)
    )
    return joined.select(
        key,
        "field_key",
        "required",
        F.when(F.col("ranked").isNull(), "unresolved").when(unsure, "needs_confirmation").otherwise("auto_selected").alias("status"),
        top["candidate_id"].alias("selected_id"),
        top["value_json"].alias("value_json"),
        confidence.alias("confidence"),
        F.coalesce(F.size("ranked"), F.lit(0)).alias("candidates"),
    )


def apply_confirmations(decisions: DataFrame, selections: DataFrame, candidates: DataFrame, key: str = "asset_id") -> DataFrame:
    """Reviewer choices (key, field_key, selected_id; null rejects) on fields that need confirmation."""
    chosen = selections.select(key, "field_key", F.col("selected_id").alias("__pick"), F.lit(True).alias("__asked"))
    listed = candidates.select(key, "field_key", F.col("candidate_id").alias("__pick"), F.col("value_json").alias("__value")).dropDuplicates(
        [key, "field_key", "__pick"]
    )
    joined = decisions.join(shuffled(chosen), [key, "field_key"], "left").join(shuffled(listed), [key, "field_key", "__pick"], "left")
    asked, open_now = F.coalesce("__asked", F.lit(False)), F.col("status") == "needs_confirmation"
    reject = asked & open_now & F.col("__pick").isNull()
    confirm = asked & open_now & F.col("__value").isNotNull()
    return joined.select(
        key,
        "field_key",
        "required",
        F.when(reject, "rejected").when(confirm, "confirmed").otherwise(F.col("status")).alias("status"),
        F.when(reject, F.lit(None)).when(confirm, F.col("__pick")).otherwise(F.col("selected_id")).alias("selected_id"),
        F.when(reject, F.lit(None)).when(confirm, F.col("__value")).otherwise(F.col("value_json")).alias("value_json"),
        F.when(asked & ~open_now, "not_reviewable").when(asked & ~reject & ~confirm, "unknown_candidate").alias("code"),
    )


OPEN = ("unresolved", "rejected")
ACCEPTED = ("auto_selected", "confirmed")


def extraction_quality(decisions: DataFrame, key: str = "asset_id") -> DataFrame:
    """Five counts per result; better results have fewer open and more accepted fields."""
    is_open, review = F.col("status").isin(*OPEN), F.col("status") == "needs_confirmation"
    return decisions.groupBy(key).agg(
        F.count_if(F.col("required") & is_open).alias("unresolved_required"),
        F.count_if(F.col("required") & review).alias("review_required"),
        F.count_if(is_open).alias("unresolved_total"),
        F.count_if(review).alias("review_total"),
        F.count_if(F.col("status").isin(*ACCEPTED)).alias("accepted_total"),
    )


def prefer_rendered(static: DataFrame, rendered: DataFrame, key: str = "asset_id") -> DataFrame:
    """Whether the rendered extraction is strictly better, count by count."""
    def rank(side: str) -> Column:
        c = lambda n: F.col(f"{side}.{n}")
        return F.struct(
            (-c("unresolved_required")).alias("a"),
            (-c("review_required")).alias("b"),
            (-c("unresolved_total")).alias("c"),
            (-c("review_total")).alias("d"),
            c("accepted_total").alias("e"),
        )

    joined = static.alias("s").join(shuffled(rendered.alias("r")), key)
    return joined.select(key, (rank("r") > rank("s")).alias("prefer_rendered"))


def values(decisions: DataFrame, include_unconfirmed: bool = False, key: str = "asset_id") -> DataFrame:
    """Accepted values per asset as a map, and the required fields that are still open."""
    accepted = [*ACCEPTED, "needs_confirmation"] if include_unconfirmed else list(ACCEPTED)
    take = F.col("status").isin(accepted) & F.col("selected_id").isNotNull()
    return decisions.groupBy(key).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.when(take, F.struct("field_key", "value_json"))))).alias("values"),
        F.sort_array(F.collect_list(F.when(F.col("required") & F.col("status").isin(*OPEN), F.col("field_key")))).alias("unresolved_required"),
    )


def ranked_candidates(candidates: DataFrame, key: str = "asset_id") -> DataFrame:
    """Candidates with their rank inside (asset, field)."""
    order = Window.partitionBy(key, "field_key").orderBy(F.desc("confidence"), "provider", "candidate_id")
    return candidates.withColumn("rank", F.row_number().over(order))
