"""Usage metering, plan history and invoice rating. Money is integer minor units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.ids import stable_id
from dossier.operators.digests import sorted_digest
from dossier.operators.ordered import as_of, with_next

METER = ["operation", "unit"]


def usage_event_id() -> Column:
    return stable_id(F.col("consumer_id"), F.col("request_id"), F.col("operation"), F.col("unit"))


def dedupe_usage(events: DataFrame) -> DataFrame:
    """First arrival of each usage event id; billable when the status is 2xx or 3xx.

    events: tenant_id, consumer_id, request_id, operation, unit, quantity, status_code,
    created_at, arrival. min_by combines before the shuffle, so replays cost little.
    """
    keyed = events.withColumn("usage_event_id", usage_event_id())
    rest = [c for c in keyed.columns if c != "usage_event_id"]
    first = keyed.groupBy("usage_event_id").agg(F.min_by(F.struct(*rest), F.col("arrival")).alias("e"))
    return first.select("usage_event_id", "e.*").withColumn(
        "billable", (F.col("status_code") >= 200) & (F.col("status_code") < 400)
    )


def in_period(events: DataFrame, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Half-open period: since <= created_at < until."""
    if since is not None:
        events = events.where(F.col("created_at") >= since)
    if until is not None:
        events = events.where(F.col("created_at") < until)
    return events


def usage_summary(events: DataFrame) -> DataFrame:
    """Events, quantity and billable quantity per (tenant, consumer, operation, unit) and in total."""
    keys = ["tenant_id", "consumer_id", *METER]
    sets = [[F.col(k) for k in keys], []]
    return events.groupingSets(sets, *[F.col(k) for k in keys]).agg(
        (F.grouping_id(*keys) != 0).alias("is_total"),
        F.count("*").alias("events"),
        F.coalesce(F.sum("quantity"), F.lit(0)).alias("quantity"),
        F.coalesce(F.sum(F.when(F.col("billable"), F.col("quantity")).otherwise(0)), F.lit(0)).alias("billable_quantity"),
    )


def assign_plan(history: DataFrame, bucket: Column) -> DataFrame:
    """Plan history rows (tenant_id, catalog_id, effective_from) closed by their successor.

    Of equal starts only the first row (by catalog_id) is accepted: an assignment must start
    after the open one. ``bucket`` is non-decreasing in effective_from.
    """
    accepted = history.groupBy("tenant_id", "effective_from").agg(F.min("catalog_id").alias("catalog_id"))
    closed = with_next(accepted, ["tenant_id"], ["effective_from"], bucket, ["effective_from"], "__next")
    until = F.col("__next.effective_from")
    return closed.select(
        "tenant_id",
        "catalog_id",
        "effective_from",
        until.alias("effective_to"),
        F.when(until.isNull(), "active").otherwise("closed").alias("status"),
    )


def assignment_for_period(assignments: DataFrame, periods: DataFrame) -> DataFrame:
    """The assignment that covers each (tenant_id, period_start, period_end) completely.

    Assignments of a tenant follow one another, so only the latest one starting at or before
    the period start can cover it: an as-of lookup.
    """
    found = as_of(
        periods,
        assignments,
        ["tenant_id"],
        "period_start",
        "effective_from",
        lambda t: F.date_trunc("month", t),
        ["catalog_id", "effective_from", "effective_to"],
        "plan",
    )
    covers = F.col("plan.effective_to").isNull() | (F.col("plan.effective_to") >= F.col("period_end"))
    return found.where(F.col("plan").isNotNull() & covers).select(
        "tenant_id", "period_start", "period_end", "plan.catalog_id", "plan.effective_from"
    )


def billed_usage(events: DataFrame, periods: DataFrame) -> DataFrame:
    """Billable quantity per (tenant, half-open period, meter).

    A period is opened into its whole days, which meet day totals by an equi join; the few
    days that a period only touches in part meet the events themselves.
    """
    key = ["tenant_id", "period_start", "period_end"]
    billable = events.where("billable").withColumn("day", F.to_date("created_at"))
    daily = billable.groupBy("tenant_id", "day", *METER).agg(F.sum("quantity").alias("quantity"))
    first, last = F.to_date("period_start"), F.to_date("period_end")
    cut_first = F.col("period_start") > F.date_trunc("day", "period_start")
    cut_last = F.col("period_end") > F.date_trunc("day", "period_end")
    since = F.when(cut_first, F.date_add(first, 1)).otherwise(first)
    until = F.date_sub(last, 1)
    days = periods.select(*key).withColumn("day", F.explode(F.when(since <= until, F.sequence(since, until))))
    edges = F.array_distinct(F.array_compact(F.array(F.when(cut_first, first), F.when(cut_last, last))))
    touched = periods.select(*key).withColumn("day", F.explode(edges))
    inside = (F.col("created_at") >= F.col("period_start")) & (F.col("created_at") < F.col("period_end"))
    whole = daily.join(days, ["tenant_id", "day"])
    part = billable.join(touched, ["tenant_id", "day"]).where(inside)
    cols = [*key, *METER, "quantity"]
    return whole.select(cols).unionByName(part.select(cols)).groupBy(*key, *METER).agg(F.sum("quantity").alias("quantity"))


def rate_invoice_lines(usage: DataFrame, rules: DataFrame) -> DataFrame:
    """Included and chargeable quantity and amount per priced meter.

    usage: catalog_id, operation, unit, quantity (and any keys); rules: catalog_id,
    operation, unit, unit_price_minor, included_quantity.
    """
    rated = usage.join(rules, ["catalog_id", *METER])
    chargeable = F.greatest(F.lit(0), F.col("quantity") - F.col("included_quantity"))
    return rated.select(
        *usage.columns,
        F.least("quantity", "included_quantity").alias("included"),
        chargeable.alias("chargeable"),
        "unit_price_minor",
        (chargeable * F.col("unit_price_minor")).alias("amount_minor"),
    )


def unpriced_usage(usage: DataFrame, rules: DataFrame) -> DataFrame:
    """Meters with quantity and no rule; they block finalisation."""
    return usage.where(F.col("quantity") != 0).join(rules, ["catalog_id", *METER], "left_anti").select(usage.columns)


def invoice_totals(assigned: DataFrame, lines: DataFrame, unpriced: DataFrame, catalogs: DataFrame) -> DataFrame:
    """Preview per (tenant, period): base fee plus line amounts, and whether it can be finalised."""
    key = ["tenant_id", "period_start"]
    sums = lines.groupBy(*key).agg(F.sum("amount_minor").alias("lines_minor"), F.count("*").alias("lines"))
    open_meters = unpriced.groupBy(*key).agg(F.count("*").alias("unpriced"))
    joined = (
        assigned.join(catalogs, "catalog_id")
        .join(sums, key, "left")
        .join(open_meters, key, "left")
        .na.fill(0, ["lines_minor", "lines", "unpriced"])
    )
    return joined.select(
        *key,
        "period_end",
        "catalog_id",
        "base_fee_minor",
        "lines",
        (F.col("base_fee_minor") + F.col("lines_minor")).alias("total_minor"),
        "unpriced",
        (F.col("unpriced") == 0).alias("can_finalize"),
    )


def usage_snapshot_hash(events: DataFrame, group: list[str]) -> DataFrame:
    """Digest of the sorted ``id:operation:unit:quantity`` lines of the billable events."""
    line = F.concat_ws(":", "usage_event_id", "operation", "unit", F.col("quantity").cast("string"))
    return sorted_digest(events.where("billable"), group, "usage_event_id", line).select(
        *group, F.col("lines").alias("events"), F.col("digest").alias("usage_hash")
    )


def finalize_invoices(previews: DataFrame, existing: DataFrame) -> DataFrame:
    """Existing invoices unchanged, plus finalisable previews of periods not invoiced yet.

    Both carry invoice_id, tenant_id, period_start, period_end, total_minor, status.
    """
    key = ["tenant_id", "period_start", "period_end"]
    new = previews.where("can_finalize").join(existing.select(*key), key, "left_anti")
    return existing.unionByName(new.select(existing.drop("status").columns).withColumn("status", F.lit("finalized")))


def invoices_with_lines(
    invoices: DataFrame, lines: DataFrame, k: int = 100, tenant_id=None, status: str | None = None
) -> DataFrame:
    """Newest invoices first with their lines as an array sorted by meter; lines join the final k only."""
    if not 1 <= k <= 500:
        raise ValueError("limit must be between 1 and 500")
    scoped = invoices
    if tenant_id is not None:
        scoped = scoped.where(F.col("tenant_id") == tenant_id)
    if status is not None:
        scoped = scoped.where(F.col("status") == status.strip().lower())
    page = scoped.orderBy(F.desc("period_end"), F.desc("invoice_id")).limit(k)
    nested = (
        lines.join(page.select("invoice_id"), "invoice_id", "left_semi")
        .groupBy("invoice_id")
        .agg(F.sort_array(F.collect_list(F.struct(*METER, "quantity", "amount_minor"))).alias("lines"))
    )
    return page.join(nested, "invoice_id", "left")


def price_rule_audit(rules: DataFrame) -> DataFrame:
    """Findings per rule: blank meter, negative values, duplicate meter inside a catalog."""
    trimmed = rules.withColumn("operation", F.trim(F.coalesce("operation", F.lit("")))).withColumn(
        "unit", F.trim(F.coalesce("unit", F.lit("")))
    )
    repeated = trimmed.groupBy("catalog_id", *METER).agg((F.count("*") > 1).alias("__twice"))
    code = (
        F.when(F.col("operation") == "", "blank_operation")
        .when(F.col("unit") == "", "blank_unit")
        .when(F.coalesce("unit_price_minor", F.lit(0)) < 0, "negative_price")
        .when(F.coalesce("included_quantity", F.lit(0)) < 0, "negative_included")
        .when(F.col("__twice"), "duplicate_meter")
    )
    return (
        trimmed.join(repeated, ["catalog_id", *METER])
        .withColumn("code", code)
        .where("code IS NOT NULL")
        .select("catalog_id", *METER, "rule_no", "code")
    )


def catalogs_without_rules(catalogs: DataFrame, rules: DataFrame) -> DataFrame:
    """Catalogs that no rule names; the rules are reduced to their catalogs before they meet."""
    return catalogs.join(rules.select("catalog_id").distinct(), "catalog_id", "left_anti").select("catalog_id", F.lit("no_rules").alias("code"))


# The measures a tenant quota can limit.
QUOTA_MEASURES = (
    "max_collections_per_search",
    "max_results_per_search",
    "max_rerank_candidates",
    "max_query_variants",
)


def quota_violations(requests: DataFrame, quotas: DataFrame) -> DataFrame:
    """One row per request and exceeded measure.

    requests: request_id, tenant_id and the four measures; quotas: tenant_id and the four
    limits (null = unlimited).
    """
    limits = quotas.select("tenant_id", *[F.col(m).alias(f"__{m}") for m in QUOTA_MEASURES])
    checks = F.array(
        *[
            F.struct(F.lit(m).alias("measure"), F.col(m).cast("long").alias("actual"), F.col(f"__{m}").cast("long").alias("allowed"))
            for m in QUOTA_MEASURES
        ]
    )
    return (
        requests.join(limits, "tenant_id")
        .select("request_id", "tenant_id", F.explode(checks).alias("c"))
        .select("request_id", "tenant_id", "c.*")
        .where(F.col("actual") > F.col("allowed"))
        .withColumn("excess", F.col("actual") - F.col("allowed"))
    )
