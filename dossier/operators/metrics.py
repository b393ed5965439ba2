"""Retrieval, text-error, latency, faithfulness and integrity metrics."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from dossier.functions.text import collapse_space, computed_once, visible_chars
from dossier.operators.blocks import top_k
from dossier.operators.ordered import exact_percentiles


def mark_expected(hits: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Explicit judgments (case_id, result_id) as a ``relevant`` flag and expected counts."""
    wanted = expected.select("case_id", "result_id").distinct()
    flagged = hits.join(wanted.withColumn("relevant", F.lit(True)), ["case_id", "result_id"], "left").na.fill(
        False, ["relevant"]
    )
    return flagged, wanted.groupBy("case_id").agg(F.count("*").alias("expected"))


def case_metrics(hits: DataFrame, cases: DataFrame) -> DataFrame:
    """First rank, reciprocal rank, hits at 1/3/5 and recall at 5 per case.

    hits: case_id, result_id, rank, relevant; cases: case_id, expected (count).
    """
    found = F.min(F.when(F.col("relevant"), F.col("rank")))
    in_five = F.count_distinct(F.when(F.col("relevant") & (F.col("rank") <= 5), F.col("result_id")))
    per = hits.groupBy("case_id").agg(found.alias("first_rank"), in_five.alias("in_five"))
    rank = F.col("first_rank")
    hit = lambda n: F.coalesce(rank <= n, F.lit(False))
    return cases.join(per, "case_id", "left").select(
        "case_id",
        rank,
        F.coalesce(1.0 / rank, F.lit(0.0)).alias("reciprocal_rank"),
        hit(1).alias("top1"),
        hit(3).alias("hit_at_3"),
        hit(5).alias("hit_at_5"),
        (F.coalesce("in_five", F.lit(0)) / F.col("expected")).alias("recall_at_5"),
    )


def ndcg_at_k(relevance: DataFrame, returned: DataFrame, k: int = 5) -> DataFrame:
    """nDCG per case: relevance(case_id, result_id, gain), returned(case_id, result_id, rank)."""
    if k < 1:
        raise ValueError("k must be positive")
    firsts = returned.groupBy("case_id", "result_id").agg(F.min("rank").alias("rank"))
    top = top_k(firsts, "case_id", [F.col("rank")], k, "place").join(relevance, ["case_id", "result_id"])
    ideal = top_k(relevance, "case_id", [F.desc("gain")], k, "place")
    return ndcg_from_gains(top, ideal.groupBy("case_id").agg(F.sum(_gain("gain", "place")).alias("ideal")))


def _gain(gain: str, place: str) -> Column:
    return (F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.col(gain).cast("double"))) - 1) / F.log2(F.col(place) + 1)


def ndcg_from_gains(top: DataFrame, ideal: DataFrame) -> DataFrame:
    """nDCG from the gains of returned results (case_id, gain, place) and ideal sums (case_id, ideal)."""
    dcg = top.groupBy("case_id").agg(F.sum(_gain("gain", "place")).alias("dcg"))
    return ideal.join(dcg, "case_id", "left").select(
        "case_id",
        F.when(F.col("ideal") == 0, F.lit(0.0)).otherwise(F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).alias("ndcg"),
    )


def binary_ideal(expected: Column, k: int = 5) -> Column:
    """Ideal sum when ``expected`` results all have gain 1."""
    places = F.filter(F.sequence(F.lit(1), F.lit(k)), lambda i: i <= expected)
    return F.aggregate(places, F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))


def suite_summary(results: DataFrame, suite: str = "suite") -> DataFrame:
    """Means and latency percentiles per suite over case results with latency_ms and ndcg_at_5."""
    flag = lambda c: F.avg(F.col(c).cast("int"))
    means = results.groupBy(suite).agg(
        F.count("*").alias("cases"),
        flag("top1").alias("top1_accuracy"),
        F.avg("reciprocal_rank").alias("mrr"),
        flag("hit_at_3").alias("hit_rate_at_3"),
        flag("hit_at_5").alias("hit_rate_at_5"),
        F.avg("recall_at_5").alias("mean_recall_at_5"),
        F.avg("ndcg_at_5").alias("mean_ndcg_at_5"),
    )
    latency = exact_percentiles(results, [suite], "latency_ms", {"latency_p50_ms": 0.5, "latency_p95_ms": 0.95})
    return means.join(latency.drop("samples").withColumnRenamed("max", "latency_max_ms"), suite)


def set_precision_recall(expected: Column, actual: Column) -> tuple[Column, Column]:
    """Precision and recall of two id arrays as sets; two empty sets agree perfectly."""
    want, have = F.array_distinct(expected), F.array_distinct(actual)
    both = F.size(F.array_intersect(want, have))
    recall = F.when(F.size(want) == 0, F.when(F.size(have) == 0, 1.0).otherwise(0.0)).otherwise(both / F.size(want))
    precision = F.when(F.size(have) == 0, F.when(F.size(want) == 0, 1.0).otherwise(0.0)).otherwise(both / F.size(have))
    return precision, recall


def precision_recall_rows(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """The same over rows (case_id, result_id), for sets of any size."""
    want = expected.select("case_id", "result_id").distinct().withColumn("__want", F.lit(True))
    have = actual.select("case_id", "result_id").distinct().withColumn("__have", F.lit(True))
    per = (
        want.join(have, ["case_id", "result_id"], "full_outer")
        .groupBy("case_id")
        .agg(
            F.count("__want").alias("expected"),
            F.count("__have").alias("actual"),
            F.count_if(F.col("__want") & F.col("__have")).alias("both"),
        )
    )
    ratio = lambda side, other: F.when(
        F.col(side) == 0, F.when(F.col(other) == 0, 1.0).otherwise(0.0)
    ).otherwise(F.col("both") / F.col(side))
    return per.select(
        "case_id", ratio("actual", "expected").alias("precision"), ratio("expected", "actual").alias("recall")
    )


def character_error_rate(reference: Column, hypothesis: Column) -> Column:
    return F.when(
        F.char_length(reference) == 0, F.when(F.char_length(hypothesis) == 0, 0.0).otherwise(1.0)
    ).otherwise(F.levenshtein(reference, hypothesis) / F.char_length(reference))


def _edit_distance(left: np.ndarray, right: np.ndarray) -> int:
    """Row-wise dynamic programme; insertions close in one running minimum."""
    steps = np.arange(len(right) + 1)
    row = steps.copy()
    for number, item in enumerate(left, start=1):
        best = np.empty_like(row)
        best[0] = number
        best[1:] = np.minimum(row[:-1] + (right != item), row[1:] + 1)
        row = np.minimum.accumulate(best - steps) + steps
    return int(row[-1])


@computed_once
@F.pandas_udf(DoubleType())
def word_error_rate(references: pd.Series, hypotheses: pd.Series) -> pd.Series:
    """Edit distance over words, as a share of the reference's words."""

    def one(reference, hypothesis):
        want, have = reference.split(), hypothesis.split()
        if not want:
            return 1.0 if have else 0.0
        codes = {w: i for i, w in enumerate(dict.fromkeys(want + have))}
        ids = lambda ws: np.fromiter((codes[w] for w in ws), np.int64, len(ws))
        return _edit_distance(ids(want), ids(have)) / len(want)

    return pd.Series([one(r or "", h or "") for r, h in zip(references, hypotheses)], dtype="float64")


def stage_latency(samples: DataFrame) -> DataFrame:
    """Per stage: samples, median, p95 and maximum of ``latency_ms``; negatives are refused."""
    checked = samples.withColumn(
        "latency_ms",
        F.when(F.col("latency_ms") < 0, F.raise_error(F.lit("latency must be non-negative"))).otherwise(F.col("latency_ms")),
    )
    out = exact_percentiles(checked, ["stage"], "latency_ms", {"p50_ms": 0.5, "p95_ms": 0.95})
    return out.withColumnRenamed("max", "max_ms")


def _gains(base: DataFrame, other: DataFrame, suite: str) -> DataFrame:
    """Suites side by side with MRR, top-1 and recall gains and the p95 multiplier."""
    left = base.select(suite, *[F.col(c).alias(f"__{c}") for c in base.columns if c != suite])
    joined = other.join(left, suite)
    return joined.select(
        suite,
        (F.col("mrr") - F.col("__mrr")).alias("mrr_gain"),
        (F.col("top1_accuracy") - F.col("__top1_accuracy")).alias("top1_gain"),
        (F.col("mean_recall_at_5") - F.col("__mean_recall_at_5")).alias("recall_at_5_gain"),
        F.when(F.col("__latency_p95_ms") <= 0, F.lit(1.0))
        .otherwise(F.col("latency_p95_ms") / F.col("__latency_p95_ms"))
        .alias("p95_latency_multiplier"),
    )


def _rounded(df: DataFrame, suite: str, passed: Column) -> DataFrame:
    return df.select(
        suite,
        passed.alias("passed"),
        F.round("mrr_gain", 6).alias("mrr_gain"),
        F.round("top1_gain", 6).alias("top1_gain"),
        F.round("recall_at_5_gain", 6).alias("recall_at_5_gain"),
        F.round("p95_latency_multiplier", 4).alias("p95_latency_multiplier"),
    )


def rerank_gate(
    base: DataFrame, other: DataFrame, suite: str = "suite", min_mrr=0.01, min_top1=0.0, max_p95=3.0
) -> DataFrame:
    gains = _gains(base, other, suite)
    passed = (
        (F.col("mrr_gain") >= min_mrr) & (F.col("top1_gain") >= min_top1) & (F.col("p95_latency_multiplier") <= max_p95)
    )
    return _rounded(gains, suite, passed)


def expansion_gate(
    base: DataFrame, other: DataFrame, suite: str = "suite", min_mrr=0.01, min_recall=0.01, max_p95=2.0
) -> DataFrame:
    gains = _gains(base, other, suite)
    better = (F.col("mrr_gain") >= min_mrr) | (F.col("recall_at_5_gain") >= min_recall)
    passed = better & (F.col("top1_gain") >= 0) & (F.col("p95_latency_multiplier") <= max_p95)
    return _rounded(gains, suite, passed)


def _share(terms: Column, text: Column) -> Column:
    found = F.size(F.filter(terms, lambda t: F.contains(text, F.lower(t))))
    return F.when(F.size(terms) == 0, F.lit(1.0)).otherwise(found / F.size(terms))


def faithfulness(cases: DataFrame, required: DataFrame, claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per case: citation precision and recall, claim support, term recalls, abstention, pass.

    cases: case_id, answer, abstained, expected_abstained, max_claims, answer_terms,
    contradictions, contradiction_terms (arrays); required: case_id, req_no, terms,
    expected_ids; claims: case_id, claim_no, text, chunk_ids; evidence: case_id, chunk_id, text.
    The claims of one answer are a short list and travel as an array.
    """
    per_case = claims.groupBy("case_id").agg(
        F.sort_array(F.collect_list(F.struct("claim_no", F.lower("text").alias("text"), "chunk_ids"))).alias("claims")
    )
    matched = required.join(per_case, "case_id", "left").select(
        "case_id",
        "req_no",
        "terms",
        "expected_ids",
        F.get(
            F.filter(
                F.col("claims"), lambda c: F.forall(F.col("terms"), lambda t: F.contains(c["text"], F.lower(t)))
            ),
            F.lit(0),
        ).alias("match"),
    )
    cited = (
        matched.select("case_id", "req_no", F.posexplode("match.chunk_ids").alias("pos", "chunk_id"))
        .join(evidence, ["case_id", "chunk_id"])
        .groupBy("case_id", "req_no")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("parts"))
        .select("case_id", "req_no", F.lower(F.array_join(F.transform("parts", lambda p: p["text"]), " ")).alias("cited"))
    )
    checks = matched.join(cited, ["case_id", "req_no"], "left").select(
        "case_id",
        "expected_ids",
        F.col("match.chunk_ids").alias("actual_ids"),
        F.coalesce(
            F.forall("terms", lambda t: F.contains(F.coalesce(F.col("cited"), F.lit("")), F.lower(t)))
            & (F.size(F.array_except("expected_ids", "match.chunk_ids")) == 0),
            F.lit(False),
        ).alias("supported"),
    )
    rolled = checks.groupBy("case_id").agg(
        F.avg(F.col("supported").cast("int")).alias("claim_support_rate"),
        F.array_distinct(F.flatten(F.collect_list("expected_ids"))).alias("want"),
        F.array_distinct(F.flatten(F.collect_list("actual_ids"))).alias("have"),
    )
    precision, recall = set_precision_recall(F.col("want"), F.col("have"))
    full = cases.join(rolled, "case_id", "left").join(
        per_case.select("case_id", F.size("claims").alias("n_claims")), "case_id", "left"
    )
    none = F.col("want").isNull()
    limit_ok = F.col("max_claims").isNull() | (F.coalesce("n_claims", F.lit(0)) <= F.col("max_claims"))
    scored = full.select(
        "case_id",
        ((F.col("abstained") == F.col("expected_abstained")) & limit_ok).alias("abstention_correct"),
        F.when(none, F.lit(1.0)).otherwise(precision).alias("citation_precision"),
        F.when(none, F.lit(1.0)).otherwise(recall).alias("citation_recall"),
        F.coalesce("claim_support_rate", F.lit(1.0)).alias("claim_support_rate"),
        _share(F.col("answer_terms"), F.lower(F.coalesce("answer", F.lit("")))).alias("answer_term_recall"),
        _share(F.col("contradiction_terms"), F.lower(F.array_join("contradictions", " "))).alias("contradiction_recall"),
    )
    rates = ("citation_precision", "citation_recall", "claim_support_rate", "answer_term_recall", "contradiction_recall")
    passed = F.col("abstention_correct")
    for rate in rates:
        passed = passed & (F.col(rate) == 1.0)
    return scored.withColumn("passed", passed)


def structure_score(texts: DataFrame, rows: DataFrame, fields: DataFrame) -> DataFrame:
    """Share of expected table rows and label-value pairs found in a text.

    texts: artifact_id, text; rows: artifact_id, cells; fields: artifact_id, label, value.
    Expectations of one artifact are a short manifest and travel as arrays.
    """
    want_rows = rows.groupBy("artifact_id").agg(F.collect_list(F.transform("cells", collapse_space)).alias("rows"))
    want_fields = fields.groupBy("artifact_id").agg(
        F.collect_list(F.struct(collapse_space(F.col("label")).alias("label"), collapse_space(F.col("value")).alias("value"))).alias("fields")
    )
    tab_lines = F.transform(
        F.filter(F.split("text", "\\R"), lambda line: F.contains(line, F.lit("\t"))),
        lambda line: F.filter(F.transform(F.split(line, "\t"), collapse_space), lambda cell: cell != ""),
    )

    def holds(cells: Column, wanted: Column) -> Column:
        step = lambda at, cell: F.when(
            (at < F.size(wanted)) & F.contains(cell, F.get(wanted, at)), at + 1
        ).otherwise(at)
        return F.aggregate(cells, F.lit(0), step) == F.size(wanted)

    def follows(field: Column) -> Column:
        at = F.call_function("locate", field["label"], F.col("flat"))
        return (at > 0) & (F.call_function("locate", field["value"], F.col("flat"), at) > 0)

    joined = (
        texts.join(want_rows, "artifact_id", "left")
        .join(want_fields, "artifact_id", "left")
        .withColumn("lines", tab_lines)
        .withColumn("flat", collapse_space(F.col("text")))
    )
    none = lambda c: F.coalesce(F.size(c), F.lit(0))
    row_hits = F.size(F.filter("rows", lambda r: F.exists("lines", lambda line: holds(line, r))))
    field_hits = F.size(F.filter("fields", follows))
    counted = joined.select(
        "artifact_id",
        (F.when(F.col("rows").isNull(), 0).otherwise(row_hits) + F.when(F.col("fields").isNull(), 0).otherwise(field_hits)).alias("matched"),
        (F.when(F.col("rows").isNull(), 0).otherwise(none("rows")) + F.when(F.col("fields").isNull(), 0).otherwise(none("fields"))).alias("checks"),
    )
    return counted.withColumn(
        "structure_score", F.when(F.col("checks") > 0, F.col("matched") / F.col("checks"))
    )


def artifact_results(artifacts: DataFrame) -> DataFrame:
    """Pass flags per artifact: status, text length, required fragments, error and structure limits.

    artifacts: artifact_id, format, status, expected_status, text, min_text_chars,
    required_text (array), skipped, cer, wer, max_cer, max_wer, structure_score,
    min_structure_score, latency_ms.
    """
    flat = collapse_space(F.col("text"))
    passed = (
        (F.col("status") == F.col("expected_status"))
        & (F.char_length(F.trim("text")) >= F.col("min_text_chars"))
        & F.forall("required_text", lambda f: F.contains(flat, collapse_space(f)))
    )
    within = lambda value, limit: F.col(limit).isNull() | F.coalesce(F.col(value) <= F.col(limit), F.lit(False))
    structure = F.col("min_structure_score").isNull() | F.coalesce(
        F.col("structure_score") >= F.col("min_structure_score"), F.lit(False)
    )
    bench = passed & within("cer", "max_cer") & within("wer", "max_wer") & structure
    return artifacts.withColumn("passed", passed).withColumn("benchmark_passed", bench)


def corpus_summary(results: DataFrame, corpus: str = "corpus") -> DataFrame:
    """Success rates, mean errors and latency percentiles; skipped artifacts are left out."""
    ran = results.where(~F.col("skipped"))
    rate = lambda c: F.avg(F.col(c).cast("int"))
    sums = ran.groupBy(corpus).agg(
        F.count("*").alias("executed"),
        rate("passed").alias("ingestion_success_rate"),
        rate("benchmark_passed").alias("benchmark_success_rate"),
        F.avg("cer").alias("mean_cer"),
        F.avg("wer").alias("mean_wer"),
        F.avg("structure_score").alias("mean_structure_score"),
    )
    total = results.groupBy(corpus).agg(F.count("*").alias("total"), F.count_if("skipped").alias("skipped"))
    latency = exact_percentiles(ran, [corpus], "latency_ms", {"latency_p50_ms": 0.5, "latency_p95_ms": 0.95})
    joined = total.join(sums, corpus, "left").join(
        latency.drop("samples").withColumnRenamed("max", "latency_max_ms"), corpus, "left"
    )
    return joined.na.fill(0, ["executed"]).na.fill(
        0.0,
        ["ingestion_success_rate", "benchmark_success_rate", "latency_p50_ms", "latency_p95_ms", "latency_max_ms"],
    )


def success_by_format(results: DataFrame) -> DataFrame:
    return (
        results.where(~F.col("skipped"))
        .groupBy("format")
        .agg(F.count("*").alias("executed"), F.avg(F.col("passed").cast("int")).alias("success_rate"))
    )


def route_pages(pages: DataFrame, min_chars: int = 24, min_confidence: float = 90.0) -> DataFrame:
    """Escalation reason per OCR page: too little text first, then low confidence."""
    reason = F.when(visible_chars(F.col("text")) < min_chars, "ocr-low-text").when(
        F.col("confidence") < min_confidence, "ocr-low-confidence"
    )
    return pages.withColumn("reason", reason).withColumn("escalate", F.col("reason").isNotNull())


def routing_quality(pages: DataFrame, poor_cer: float = 0.25, poor_wer: float = 0.5) -> DataFrame:
    """Precision, recall and accuracy of ``escalate`` against poor pages (by CER or WER)."""
    poor = (F.col("cer") > poor_cer) | (F.col("wer") > poor_wer)
    counted = pages.agg(
        F.count("*").alias("pages"),
        F.count_if(poor).alias("poor"),
        F.count_if("escalate").alias("escalated"),
        F.count_if(poor & F.col("escalate")).alias("tp"),
        F.count_if(~poor & ~F.col("escalate")).alias("tn"),
    )
    ratio = lambda a, b: F.when(F.col(b) == 0, F.lit(1.0)).otherwise(F.col(a) / F.col(b))
    return counted.select(
        "pages",
        "poor",
        "escalated",
        ratio("tp", "escalated").alias("precision"),
        ratio("tp", "poor").alias("recall"),
        ((F.col("tp") + F.col("tn")) / F.col("pages")).alias("accuracy"),
    )


def sync_efficiency(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Per scenario: changed, indexed and unnecessary work of a refresh.

    expected: scenario_id, resource_id, changed; actual: scenario_id, resource_id, outcome,
    indexed.
    """
    want = expected.select("scenario_id", "resource_id", F.col("changed").alias("should_change"))
    joined = want.join(actual, ["scenario_id", "resource_id"], "full_outer")
    should = F.coalesce("should_change", F.lit(False))
    indexed = F.coalesce("indexed", F.lit(False))
    changed = F.coalesce(F.col("outcome") == "changed", F.lit(False))
    per = joined.groupBy("scenario_id").agg(
        F.count("*").alias("total"),
        F.count_if(changed).alias("changed"),
        F.count_if(should).alias("expected_changed"),
        F.count_if(indexed).alias("indexed"),
        F.count_if(indexed & ~should).alias("unnecessary"),
        F.count_if(should & ~indexed).alias("missed"),
        F.count_if(F.coalesce(F.col("outcome") == "unchanged", F.lit(False))).alias("unchanged"),
    )
    passed = (
        (F.col("changed") == F.col("expected_changed"))
        & (F.col("unnecessary") == 0)
        & (F.col("missed") == 0)
        & (F.col("unchanged") == F.col("total") - F.col("expected_changed"))
    )
    return per.select(
        "*",
        (F.col("indexed") / F.col("total")).alias("reprocess_rate"),
        F.when(F.col("changed") == 0, F.when(F.col("indexed") == 0, 0.0).otherwise(float("inf")))
        .otherwise(F.col("indexed") / F.col("changed"))
        .alias("amplification"),
        passed.alias("passed"),
    )


def hit_invariants(hits: DataFrame, scope: DataFrame, decisions: DataFrame, conflicts: DataFrame, stale: DataFrame) -> DataFrame:
    """Violations of the search guarantees, one row per check; all counts should be 0.

    hits: query_id, collection_id, canonical_uri; scope: query_id, collection_id (allowed);
    decisions: own_tenant, policy_tenant, decision; conflicts: query_id, canonical_uri that
    must both be returned; stale: resource_id, hash_before, hash_after, in_index.
    """
    one = lambda df, name: df.agg(F.lit(name).alias("check"), F.count("*").alias("violations"))
    outside = hits.join(scope, ["query_id", "collection_id"], "left_anti")
    crossed = decisions.where(
        (F.col("decision") == "allowed")
        & (F.col("policy_tenant") != "")
        & (F.coalesce("own_tenant", F.lit("")) != F.col("policy_tenant"))
    )
    doubled = (
        hits.where(F.col("canonical_uri") != "")
        .groupBy("query_id", "canonical_uri")
        .agg(F.min("collection_id").alias("a"), F.max("collection_id").alias("b"))
        .where("a <> b")
    )
    missing = conflicts.join(hits.select("query_id", "canonical_uri"), ["query_id", "canonical_uri"], "left_anti")
    lost = stale.where(~F.col("in_index") | (F.col("hash_before") != F.col("hash_after")))
    return (
        one(outside, "collection_isolation")
        .unionByName(one(crossed, "tenant_isolation"))
        .unionByName(one(doubled, "one_winner_per_uri"))
        .unionByName(one(missing, "conflicting_sources_kept"))
        .unionByName(one(lost, "stale_evidence_kept"))
    )


# p95 latency targets in milliseconds per operation.
SLO_P95_MS = {
    "process": 10_000,
    "ingest": 10_000,
    "search": 1_500,
    "answer": 20_000,
    "research": 120_000,
    "discover": 5_000,
    "extract": 10_000,
    "reindex": 120_000,
}
SLO_ERROR_RATE = 0.01
SLO_MIN_SAMPLES = 20


def slo_status(ops: DataFrame, targets: Mapping[str, int] = SLO_P95_MS) -> DataFrame:
    """Per operation: p95 (rounded half to even), error rate and status against the target.

    ops: operation, latency_ms, failed.
    """
    p95 = exact_percentiles(
        ops.withColumn("latency_ms", F.col("latency_ms").cast("long")), ["operation"], "latency_ms", {"p95": 0.95}
    )
    counts = ops.groupBy("operation").agg(F.count("*").alias("requests"), F.count_if("failed").alias("errors"))
    target = F.create_map(*[F.lit(x) for pair in targets.items() for x in pair])
    joined = counts.join(p95, "operation", "left").withColumn("target_ms", target[F.col("operation")])
    p95_ms = F.bround(F.coalesce("p95", F.lit(0.0)), 0).cast("long")
    rate = F.when(F.col("requests") > 0, F.col("errors") / F.col("requests")).otherwise(0.0)
    good = (p95_ms <= F.col("target_ms")) & (rate <= SLO_ERROR_RATE)
    return joined.select(
        "operation",
        "requests",
        "errors",
        F.coalesce("samples", F.lit(0)).alias("samples"),
        p95_ms.alias("p95_ms"),
        rate.alias("error_rate"),
        F.when(F.coalesce("samples", F.lit(0)) < SLO_MIN_SAMPLES, "insufficient-data")
        .when(good, "green")
        .otherwise("red")
        .alias("status"),
    )


def overall_status(status: DataFrame) -> DataFrame:
    return status.agg(
        F.when(F.count_if(F.col("status") == "red") > 0, "red")
        .when(F.count_if(F.col("status") == "green") > 0, "green")
        .otherwise("insufficient-data")
        .alias("overall")
    )
