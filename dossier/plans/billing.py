"""Metering and billing queries: events as the usage log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.operators import billing as b
from dossier.plans.registry import Tables, query


def usage_log(t: Tables, replay: bool = True) -> DataFrame:
    """events as usage: one request per user and hour, so later events of the hour repeat its id."""
    hour = F.date_format("ts", "yyyyMMddHH")
    log = t.events.select(
        F.concat(F.lit("t"), F.col("user_id") % 7).alias("tenant_id"),
        F.concat(F.lit("u"), "user_id").alias("consumer_id"),
        hour.alias("request_id"),
        F.col("event_type").alias("operation"),
        F.lit("call").alias("unit"),
        F.floor("value").cast("long").alias("quantity"),
        F.when(F.col("event_type") == "error", 500).when(F.col("event_id") % 9 == 0, 302).otherwise(200).alias("status_code"),
        F.col("ts").alias("created_at"),
        F.col("event_id").alias("arrival"),
    )
    if not replay:
        return log
    again = log.withColumn("arrival", F.col("arrival") + 1_000_000_000).withColumn("quantity", F.lit(999).cast("long"))
    return log.unionByName(again)


USAGE_SQL = """
    usage AS (
      SELECT sha256('u' || user_id || chr(0) || strftime(ts, '%Y%m%d%H') || chr(0) || event_type || chr(0) || 'call') AS usage_event_id,
        't' || (user_id % 7) AS tenant_id, 'u' || user_id AS consumer_id, event_type AS operation, 'call' AS unit,
        CAST(floor(value) AS BIGINT) AS quantity, CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 9 = 0 THEN 302 ELSE 200 END AS status_code,
        ts AS created_at, event_id AS arrival, event_type <> 'error' AS billable FROM events
      QUALIFY row_number() OVER (PARTITION BY usage_event_id ORDER BY event_id) = 1)"""


@query(
    "dedupe_usage",
    "L1",
    f"WITH {USAGE_SQL} SELECT usage_event_id, tenant_id, consumer_id, operation, quantity, status_code, arrival, billable FROM usage",
)
def dedupe_usage(spark, d):
    out = b.dedupe_usage(usage_log(Tables(spark, d)))
    return out.select("usage_event_id", "tenant_id", "consumer_id", "operation", "quantity", "status_code", "arrival", "billable")


@query(
    "usage_summary",
    "L2",
    f"""WITH {USAGE_SQL} SELECT tenant_id, consumer_id, operation, unit, grouping(tenant_id) = 1 AS is_total, count(*) AS events,
      CAST(sum(quantity) AS BIGINT) AS quantity, CAST(sum(CASE WHEN billable THEN quantity ELSE 0 END) AS BIGINT) AS billable_quantity
    FROM usage WHERE created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-20'
    GROUP BY GROUPING SETS ((tenant_id, consumer_id, operation, unit), ())""",
)
def usage_summary(spark, d):
    used = b.dedupe_usage(usage_log(Tables(spark, d)))
    since, until = F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz")
    return b.usage_summary(b.in_period(used, since, until))


# Plan history from orders: a customer's order dates start plans named by priority.
def _history(t: Tables) -> DataFrame:
    return t.orders.select(
        F.concat(F.lit("c"), "o_custkey").alias("tenant_id"), F.col("o_orderpriority").alias("catalog_id"), F.col("o_orderdate").alias("effective_from")
    )


HISTORY_SQL = """
    accepted AS (SELECT 'c' || o_custkey AS tenant_id, o_orderdate AS effective_from, min(o_orderpriority) AS catalog_id FROM orders GROUP BY ALL),
    plans AS (SELECT *, lead(effective_from) OVER (PARTITION BY tenant_id ORDER BY effective_from) AS effective_to FROM accepted)"""


def _assigned(t: Tables) -> DataFrame:
    return b.assign_plan(_history(t), F.date_trunc("year", "effective_from"))


def _day(column: str):
    return F.date_format(column, "yyyy-MM-dd").alias(column)


@query(
    "assign_plan",
    "L4",
    f"""WITH {HISTORY_SQL} SELECT tenant_id, catalog_id, strftime(effective_from, '%Y-%m-%d') AS effective_from,
      strftime(effective_to, '%Y-%m-%d') AS effective_to, CASE WHEN effective_to IS NULL THEN 'active' ELSE 'closed' END AS status FROM plans""",
)
def assign_plan(spark, d):
    return _assigned(Tables(spark, d)).select("tenant_id", "catalog_id", _day("effective_from"), _day("effective_to"), "status")


@query(
    "assignment_for_period",
    "L3",
    f"""WITH {HISTORY_SQL}, months AS (SELECT s, s + INTERVAL 1 MONTH AS e FROM (
      VALUES (TIMESTAMP '1997-01-01'), (TIMESTAMP '1998-03-01'), (TIMESTAMP '1999-06-01'), (TIMESTAMP '2000-11-01')) v(s)),
    periods AS (SELECT 'c' || c_custkey AS tenant_id, s, e FROM customer, months)
    SELECT tenant_id, strftime(s, '%Y-%m-%d') AS period_start, catalog_id, strftime(effective_from, '%Y-%m-%d') AS effective_from
    FROM periods JOIN plans USING (tenant_id) WHERE effective_from <= s AND (effective_to IS NULL OR effective_to >= e)
    QUALIFY row_number() OVER (PARTITION BY tenant_id, s ORDER BY plans.effective_from DESC) = 1""",
)
def assignment_for_period(spark, d):
    t = Tables(spark, d)
    starts = ["1997-01-01", "1998-03-01", "1999-06-01", "2000-11-01"]
    periods = t.customer.select(
        F.concat(F.lit("c"), "c_custkey").alias("tenant_id"),
        F.explode(F.array(*[F.lit(s).cast("timestamp_ntz") for s in starts])).alias("period_start"),
    ).withColumn("period_end", F.add_months("period_start", 1).cast("timestamp_ntz"))
    return b.assignment_for_period(_assigned(t), periods).select("tenant_id", _day("period_start"), "catalog_id", _day("effective_from"))


# Two catalogs; 'signup' has no rule in the second one.
RULES = [
    ("basic", "click", "call", 3, 100),
    ("basic", "view", "call", 1, 1000),
    ("basic", "purchase", "call", 25, 0),
    ("basic", "signup", "call", 10, 50),
    ("pro", "click", "call", 2, 500),
    ("pro", "view", "call", 1, 5000),
    ("pro", "purchase", "call", 20, 10),
]
CATALOGS = [("basic", 900), ("pro", 4900)]
RULES_SQL = "rules(catalog_id, operation, unit, unit_price_minor, included_quantity) AS (VALUES " + ", ".join(map(str, RULES)) + ")"
CATALOGS_SQL = "catalogs(catalog_id, base_fee_minor) AS (VALUES " + ", ".join(map(str, CATALOGS)) + ")"


def _rules(spark):
    return spark.createDataFrame(RULES, "catalog_id string, operation string, unit string, unit_price_minor long, included_quantity long")


def _catalogs(spark):
    return spark.createDataFrame(CATALOGS, "catalog_id string, base_fee_minor long")


def _periods(t: Tables) -> DataFrame:
    """Weekly billing periods per tenant over the days the log covers, with the tenant's catalog."""
    weeks = t.events.select(
        F.concat(F.lit("t"), F.col("user_id") % 7).alias("tenant_id"), F.date_trunc("week", "ts").cast("timestamp_ntz").alias("period_start")
    ).distinct()
    return weeks.select(
        "tenant_id",
        "period_start",
        (F.col("period_start") + F.make_dt_interval(days=F.lit(7))).alias("period_end"),
        F.when(F.col("tenant_id").isin("t0", "t3", "t5"), "pro").otherwise("basic").alias("catalog_id"),
    )


PERIODS_SQL = """
    periods AS (SELECT DISTINCT 't' || (user_id % 7) AS tenant_id, date_trunc('week', ts) AS period_start,
      CASE WHEN user_id % 7 IN (0, 3, 5) THEN 'pro' ELSE 'basic' END AS catalog_id FROM events),
    billed AS (SELECT tenant_id, date_trunc('week', created_at) AS period_start, operation, unit, CAST(sum(quantity) AS BIGINT) AS quantity
      FROM usage WHERE billable GROUP BY ALL),
    metered AS (SELECT b.*, catalog_id FROM billed b JOIN periods USING (tenant_id, period_start)),
    lines AS (SELECT m.*, least(quantity, included_quantity) AS included, greatest(0, quantity - included_quantity) AS chargeable,
        unit_price_minor, greatest(0, quantity - included_quantity) * unit_price_minor AS amount_minor
      FROM metered m JOIN rules USING (catalog_id, operation, unit)),
    unpriced AS (SELECT * FROM metered m WHERE quantity <> 0 AND NOT EXISTS (
      SELECT 1 FROM rules r WHERE r.catalog_id = m.catalog_id AND r.operation = m.operation AND r.unit = m.unit)),
    previews AS (
      SELECT p.tenant_id, p.period_start, p.catalog_id, c.base_fee_minor, coalesce(n, 0) AS lines,
        CAST(c.base_fee_minor + coalesce(s, 0) AS BIGINT) AS total_minor, coalesce(u, 0) AS unpriced, coalesce(u, 0) = 0 AS can_finalize
      FROM periods p JOIN catalogs c USING (catalog_id)
      LEFT JOIN (SELECT tenant_id, period_start, count(*) AS n, sum(amount_minor) AS s FROM lines GROUP BY ALL) l USING (tenant_id, period_start)
      LEFT JOIN (SELECT tenant_id, period_start, count(*) AS u FROM unpriced GROUP BY ALL) o USING (tenant_id, period_start))"""
BILL_SQL = f"WITH {USAGE_SQL}, {RULES_SQL}, {CATALOGS_SQL}, {PERIODS_SQL}"


def _bill(spark, d):
    t = Tables(spark, d)
    used = b.dedupe_usage(usage_log(t))
    periods = _periods(t)
    metered = b.billed_usage(used, periods).join(
        periods.select("tenant_id", "period_start", "catalog_id"), ["tenant_id", "period_start"]
    )
    rules = _rules(spark)
    lines, unpriced = b.rate_invoice_lines(metered, rules), b.unpriced_usage(metered, rules)
    return used, periods, lines, unpriced, b.invoice_totals(periods, lines, unpriced, _catalogs(spark))


@query(
    "rate_invoice_lines",
    "L5",
    f"""{BILL_SQL} SELECT tenant_id, strftime(period_start, '%Y-%m-%d') AS period_start, operation, quantity, included, chargeable,
      unit_price_minor, amount_minor FROM lines""",
)
def rate_invoice_lines(spark, d):
    lines = _bill(spark, d)[2]
    return lines.select(
        "tenant_id", _day("period_start"), "operation", "quantity", "included", "chargeable", "unit_price_minor", "amount_minor"
    )


@query(
    "unpriced_usage",
    "L6",
    f"{BILL_SQL} SELECT tenant_id, strftime(period_start, '%Y-%m-%d') AS period_start, operation, unit, quantity FROM unpriced",
)
def unpriced_usage(spark, d):
    return _bill(spark, d)[3].select("tenant_id", _day("period_start"), "operation", "unit", "quantity")


@query(
    "invoice_totals",
    "L7",
    f"""{BILL_SQL} SELECT tenant_id, strftime(period_start, '%Y-%m-%d') AS period_start, catalog_id, base_fee_minor, lines, total_minor,
      unpriced, can_finalize FROM previews""",
)
def invoice_totals(spark, d):
    return _bill(spark, d)[4].select(
        "tenant_id", _day("period_start"), "catalog_id", "base_fee_minor", "lines", "total_minor", "unpriced", "can_finalize"
    )


@query(
    "usage_snapshot_hash",
    "L8",
    f"""WITH {USAGE_SQL}, buckets AS (
      SELECT tenant_id, substr(usage_event_id, 1, 5) AS b, count(*) AS n, sha256(string_agg(usage_event_id || ':' || operation || ':' || unit || ':' || quantity,
        chr(10) ORDER BY usage_event_id)) AS h FROM usage WHERE billable GROUP BY ALL)
    SELECT tenant_id, CAST(sum(n) AS BIGINT) AS events, sha256(string_agg(h, chr(10) ORDER BY b)) AS usage_hash FROM buckets GROUP BY tenant_id""",
)
def usage_snapshot_hash(spark, d):
    return b.usage_snapshot_hash(b.dedupe_usage(usage_log(Tables(spark, d))), ["tenant_id"])


def _invoice_id(prefix: str):
    return F.concat(F.lit(prefix), "tenant_id", F.lit("-"), F.date_format("period_start", "yyyyMMdd")).alias("invoice_id")


def _invoices(spark, d):
    """Some periods of two tenants were already invoiced with an old total."""
    _, periods, lines, _, previews = _bill(spark, d)
    existing = periods.where("tenant_id IN ('t1', 't4')").select(
        _invoice_id("old-"), "tenant_id", "period_start", "period_end", F.lit(1).cast("long").alias("total_minor"), F.lit("paid").alias("status")
    )
    return lines, b.finalize_invoices(previews.withColumn("invoice_id", _invoice_id("new-")), existing)


INVOICES_SQL = """
    invoices AS (
      SELECT 'old-' || tenant_id || '-' || strftime(period_start, '%Y%m%d') AS invoice_id, tenant_id, period_start, CAST(1 AS BIGINT) AS total_minor,
        'paid' AS status FROM periods WHERE tenant_id IN ('t1', 't4')
      UNION ALL SELECT 'new-' || tenant_id || '-' || strftime(period_start, '%Y%m%d'), tenant_id, period_start, total_minor, 'finalized'
      FROM previews WHERE can_finalize AND tenant_id NOT IN ('t1', 't4'))"""


@query(
    "finalize_invoices",
    "L9",
    f"{BILL_SQL}, {INVOICES_SQL} SELECT invoice_id, strftime(period_start, '%Y-%m-%d') AS period_start, total_minor, status FROM invoices",
)
def finalize_invoices(spark, d):
    return _invoices(spark, d)[1].select("invoice_id", _day("period_start"), "total_minor", "status")


@query(
    "invoices_with_lines",
    "L10",
    f"""{BILL_SQL}, {INVOICES_SQL}, page AS (SELECT * FROM invoices WHERE status = 'finalized' ORDER BY period_start DESC, invoice_id DESC LIMIT 10)
    SELECT invoice_id, p.total_minor, string_agg(operation || '=' || l.quantity || '/' || amount_minor, ';' ORDER BY operation, unit) AS lines
    FROM page p JOIN lines l USING (tenant_id, period_start) GROUP BY ALL""",
)
def invoices_with_lines(spark, d):
    lines, invoices = _invoices(spark, d)
    keyed = lines.join(invoices.select("invoice_id", "tenant_id", "period_start"), ["tenant_id", "period_start"])
    nested = b.invoices_with_lines(invoices, keyed, 10, status="finalized")
    text = F.transform("lines", lambda x: F.concat(x["operation"], F.lit("="), x["quantity"], F.lit("/"), x["amount_minor"]))
    return nested.select("invoice_id", "total_minor", F.array_join(text, ";").alias("lines"))


@query(
    "price_rule_audit",
    "L11",
    """WITH r AS (SELECT p_brand AS catalog_id, p_partkey AS rule_no, CASE WHEN p_partkey % 17 = 0 THEN '' ELSE p_name END AS operation,
        CASE WHEN p_partkey % 19 = 0 THEN '' ELSE p_type END AS unit, CASE WHEN p_partkey % 23 = 0 THEN -1 ELSE 5 END AS price,
        CASE WHEN p_partkey % 29 = 0 THEN -1 ELSE 5 END AS inc FROM part),
    c AS (SELECT *, count(*) OVER (PARTITION BY catalog_id, operation, unit) AS n FROM r),
    f AS (SELECT catalog_id, operation, unit, rule_no, CASE WHEN operation = '' THEN 'blank_operation' WHEN unit = '' THEN 'blank_unit'
      WHEN price < 0 THEN 'negative_price' WHEN inc < 0 THEN 'negative_included' WHEN n > 1 THEN 'duplicate_meter' END AS code FROM c)
    SELECT * FROM f WHERE code IS NOT NULL""",
)
def price_rule_audit(spark, d):
    n = F.col("p_partkey")
    rules = Tables(spark, d).part.select(
        F.col("p_brand").alias("catalog_id"),
        n.alias("rule_no"),
        F.when(n % 17 == 0, " ").otherwise(F.col("p_name")).alias("operation"),
        F.when(n % 19 == 0, F.lit(None)).otherwise(F.concat(F.lit(" "), "p_type")).alias("unit"),
        F.when(n % 23 == 0, -1).otherwise(5).alias("unit_price_minor"),
        F.when(n % 29 == 0, -1).otherwise(5).alias("included_quantity"),
    )
    return b.price_rule_audit(rules)


@query(
    "catalogs_without_rules",
    "L11",
    """SELECT DISTINCT p_brand AS catalog_id, 'no_rules' AS code FROM part
    WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 49)""",
)
def catalogs_without_rules(spark, d):
    part = Tables(spark, d).part
    brands = part.select(F.col("p_brand").alias("catalog_id"))
    return b.catalogs_without_rules(brands.distinct(), part.where("p_size > 49").select(F.col("p_brand").alias("catalog_id")))


@query(
    "quota_violations",
    "L12",
    """WITH req AS (SELECT event_id AS request_id, 't' || (user_id % 7) AS tenant_id, user_id % 7 AS k, CAST(json_extract(props, '$.k') AS BIGINT) AS v FROM events),
    m AS (SELECT request_id, tenant_id, k, 'max_collections_per_search' AS measure, v % 10 AS actual, 5 AS allowed FROM req
      UNION ALL SELECT request_id, tenant_id, k, 'max_results_per_search', v, 60 + k FROM req
      UNION ALL SELECT request_id, tenant_id, k, 'max_rerank_candidates', v // 2, CASE WHEN k = 2 THEN NULL ELSE 40 END FROM req
      UNION ALL SELECT request_id, tenant_id, k, 'max_query_variants', v % 8, k FROM req)
    SELECT request_id, tenant_id, measure, actual, actual - allowed AS excess FROM m WHERE k <> 6 AND actual > allowed""",
)
def quota_violations(spark, d):
    t = Tables(spark, d)
    v = F.get_json_object("props", "$.k").cast("long")
    requests = t.events.select(
        F.col("event_id").alias("request_id"),
        F.concat(F.lit("t"), F.col("user_id") % 7).alias("tenant_id"),
        (v % 10).alias("max_collections_per_search"),
        v.alias("max_results_per_search"),
        F.floor(v / 2).alias("max_rerank_candidates"),
        (v % 8).alias("max_query_variants"),
    )
    k = F.col("user_id") % 7
    quotas = t.events.select("user_id").where(k != 6).select(
        F.concat(F.lit("t"), k).alias("tenant_id"),
        F.lit(5).alias("max_collections_per_search"),
        (k + 60).alias("max_results_per_search"),
        F.when(k != 2, F.lit(40)).alias("max_rerank_candidates"),
        k.alias("max_query_variants"),
    ).distinct()
    return b.quota_violations(requests, quotas).drop("allowed")
