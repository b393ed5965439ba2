"""Evaluation and quality queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.operators import evidence as ev
from dossier.operators import fusion as fu
from dossier.operators import graph as g
from dossier.operators import metrics as m
from dossier.operators import page_text
from dossier.operators.blocks import spread
from dossier.operators.neighbours import knn_join
from dossier.plans import sqltext as q
from dossier.plans.graph import STAR_SQL, star_relations
from dossier.plans.ingest import OCR_WORDS_SQL, _ocr_words
from dossier.plans.registry import Tables, query
from dossier.plans.search import HITS_SQL, _hits
from dossier.plans.vectors import _self_queries, _self_vectors
from dossier.session import cut_lineage


def _label_hits(t: Tables, k: int = 10):
    """kNN hits of every vector, written since suites read them more than once; relevant when the labels agree."""
    labels = t.embeddings.select(F.col("vec_id"), "label")
    return cut_lineage(
        knn_join(_self_queries(t), _self_vectors(t), k)
        .join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("want")), "query_id")
        .join(labels.select(F.col("vec_id").alias("chunk_id"), "label"), "chunk_id")
        .select(
            F.col("query_id").alias("case_id"),
            F.col("chunk_id").alias("result_id"),
            "rank",
            (F.col("label") == F.col("want")).alias("relevant"),
            "want",
        )
    )


def _label_cases(t: Tables):
    sizes = t.embeddings.groupBy("label").agg(F.count("*").alias("expected"))
    return t.embeddings.select(F.col("vec_id").alias("case_id"), "label").join(sizes, "label")


def _suite(t: Tables, hits, slow: int):
    """Case results of one run as a suite per label, with a latency made from the case id."""
    cases = _label_cases(t)
    per = m.case_metrics(hits, cases)
    ideal = cases.select("case_id", m.binary_ideal(F.col("expected")).alias("ideal"))
    gains = hits.where("rank <= 5").select("case_id", F.col("relevant").cast("double").alias("gain"), F.col("rank").alias("place"))
    ndcg = m.ndcg_from_gains(gains, ideal).withColumnRenamed("ndcg", "ndcg_at_5")
    latency = ((F.col("case_id") * 37) % 211 * slow).cast("double")
    full = per.join(ndcg, "case_id").join(cases.select("case_id", "label"), "case_id")
    return full.withColumn("latency_ms", latency).withColumn("suite", F.concat(F.lit("label-"), "label"))


def _reordered(hits):
    """Second run: the same hits sorted by id inside each case."""
    return fu.top_k(hits.drop("rank"), "case_id", [F.desc("result_id")], 10)


LABEL_SQL = """
    pairs AS (
      SELECT a.vec_id AS case_id, b.vec_id AS result_id, a.label AS want, a.label = b.label AS relevant,
        round(list_cosine_similarity(CAST(b.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])), 12) AS s
      FROM embeddings a, embeddings b),
    base_hits AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY s DESC, result_id) AS rank FROM pairs QUALIFY rank <= 10),
    other_hits AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY case_id ORDER BY result_id DESC) AS rank FROM base_hits),
    sizes AS (SELECT label, count(*) AS expected FROM embeddings GROUP BY label)"""


def cases_sql(name: str, hits: str, slow: int) -> str:
    return f"""
    {name}_per AS (
      SELECT h.case_id, want, min(rank) FILTER (relevant) AS first_rank,
        count(DISTINCT result_id) FILTER (relevant AND rank <= 5) / any_value(expected) AS recall_at_5,
        coalesce(sum(1 / log2(rank + 1)) FILTER (relevant AND rank <= 5), 0) /
          list_sum([CASE WHEN i <= any_value(expected) THEN 1 / log2(i + 1) ELSE 0 END FOR i IN [1, 2, 3, 4, 5]]) AS ndcg
      FROM {hits} h JOIN sizes ON label = want GROUP BY h.case_id, want),
    {name} AS (
      SELECT 'label-' || want AS suite, count(*) AS cases, avg(CAST(coalesce(first_rank = 1, false) AS INT)) AS top1_accuracy,
        avg(coalesce(1 / first_rank, 0)) AS mrr, avg(CAST(coalesce(first_rank <= 3, false) AS INT)) AS hit_rate_at_3,
        avg(CAST(coalesce(first_rank <= 5, false) AS INT)) AS hit_rate_at_5, avg(recall_at_5) AS mean_recall_at_5,
        avg(ndcg) AS mean_ndcg_at_5, quantile_cont(CAST(case_id * 37 % 211 * {slow} AS DOUBLE), 0.5) AS latency_p50_ms,
        quantile_cont(CAST(case_id * 37 % 211 * {slow} AS DOUBLE), 0.95) AS latency_p95_ms,
        max(CAST(case_id * 37 % 211 * {slow} AS DOUBLE)) AS latency_max_ms
      FROM {name}_per GROUP BY want)"""


@query(
    "case_metrics",
    "F1",
    f"""WITH {LABEL_SQL}, {cases_sql("base", "base_hits", 1)}
    SELECT case_id, first_rank, round(coalesce(1 / first_rank, 0), 6) AS reciprocal_rank, coalesce(first_rank = 1, false) AS top1,
      coalesce(first_rank <= 3, false) AS hit_at_3, coalesce(first_rank <= 5, false) AS hit_at_5,
      round(recall_at_5, 6) AS recall_at_5 FROM base_per""",
)
def case_metrics(spark, d):
    t = Tables(spark, d)
    per = m.case_metrics(_label_hits(t), _label_cases(t))
    return per.select(
        "case_id",
        F.col("first_rank").cast("long"),
        F.round("reciprocal_rank", 6).alias("reciprocal_rank"),
        "top1",
        "hit_at_3",
        "hit_at_5",
        F.round("recall_at_5", 6).alias("recall_at_5"),
    )


SUITE_COLUMNS = (
    "top1_accuracy", "mrr", "hit_rate_at_3", "hit_rate_at_5", "mean_recall_at_5", "mean_ndcg_at_5",
    "latency_p50_ms", "latency_p95_ms", "latency_max_ms",
)


@query(
    "suite_summary",
    "F2",
    f"""WITH {LABEL_SQL}, {cases_sql("base", "base_hits", 1)}
    SELECT suite, cases, {", ".join(f"round({c}, 6) AS {c}" for c in SUITE_COLUMNS)} FROM base""",
)
def suite_summary(spark, d):
    t = Tables(spark, d)
    out = m.suite_summary(_suite(t, _label_hits(t), 1))
    return out.select("suite", "cases", *[F.round(c, 6).alias(c) for c in SUITE_COLUMNS])


@query(
    "ndcg_at_k",
    "F3",
    """WITH rel AS (SELECT source AS case_id, doc_id AS result_id, CAST(doc_id % 4 AS DOUBLE) - 1 AS gain FROM documents),
    ret AS (SELECT source AS case_id, doc_id AS result_id,
        row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place FROM documents QUALIFY place <= 5),
    dcg AS (SELECT case_id, sum((pow(2, greatest(0, gain)) - 1) / log2(place + 1)) AS dcg FROM ret JOIN rel USING (case_id, result_id) GROUP BY 1),
    ideal AS (SELECT case_id, sum((pow(2, greatest(0, gain)) - 1) / log2(p + 1)) AS ideal FROM (
      SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY gain DESC) AS p FROM rel QUALIFY p <= 5) GROUP BY 1)
    SELECT case_id, round(CASE WHEN ideal = 0 THEN 0 ELSE dcg / ideal END, 6) AS ndcg FROM ideal JOIN dcg USING (case_id)""",
)
def ndcg_at_k(spark, d):
    docs = Tables(spark, d).documents
    relevance = docs.select(
        F.col("source").alias("case_id"), F.col("doc_id").alias("result_id"), ((F.col("doc_id") % 4) - 1).cast("double").alias("gain")
    )
    ranked = fu.top_k(docs, "source", [F.desc("n_chars"), F.col("doc_id")], 20).select(
        F.col("source").alias("case_id"), F.col("doc_id").alias("result_id"), "rank"
    )
    repeated = ranked.unionByName(ranked.withColumn("rank", F.col("rank") + 20))
    return m.ndcg_at_k(relevance, repeated, 5).select("case_id", F.round("ndcg", 6).alias("ndcg"))


@query(
    "set_precision_recall",
    "F4",
    """WITH j AS (SELECT source AS case_id, coalesce(quality = 1, false) AS want, coalesce(toxic = 0, false) AS have
      FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE quality = 1 OR toxic = 0),
    c AS (SELECT case_id, count_if(want) AS e, count_if(have) AS a, count_if(want AND have) AS b FROM j GROUP BY 1)
    SELECT case_id, round(CASE WHEN a = 0 THEN CASE WHEN e = 0 THEN 1 ELSE 0 END ELSE b / a END, 6) AS precision,
      round(CASE WHEN e = 0 THEN CASE WHEN a = 0 THEN 1 ELSE 0 END ELSE b / e END, 6) AS recall FROM c""",
)
def set_precision_recall(spark, d):
    t = Tables(spark, d)
    rows = t.labels.join(t.documents.select("doc_id", F.col("source").alias("case_id")), "doc_id").withColumnRenamed("doc_id", "result_id")
    out = m.precision_recall_rows(rows.where("quality = 1"), rows.where("toxic = 0"))
    return out.select("case_id", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def _turn_pairs(t: Tables):
    """Each turn as reference, the next turn of the conversation as hypothesis."""
    turns = spread(t.conversations, "conv_id")
    nxt = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hypothesis"))
    return turns.select("conv_id", "turn", F.col("text").alias("reference")).join(nxt, ["conv_id", "turn"])


# DuckDB's levenshtein counts bytes: give every accented letter of the table its own control byte.
_ACCENTS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
_BYTES = " || ".join(f"chr({i + 1 if i < 8 else i + 6})" for i in range(len(_ACCENTS)))


@query(
    "character_error_rate",
    "F5",
    f"""WITH t AS (SELECT conv_id, turn, length(text) AS n, hex(text) AS raw, text FROM conversations)
    SELECT a.conv_id, a.turn, CASE WHEN a.n = 0 THEN CASE WHEN b.n = 0 THEN 0 ELSE 1 END ELSE
      round(levenshtein(translate(a.text, '{_ACCENTS}', {_BYTES}), translate(b.text, '{_ACCENTS}', {_BYTES})) / a.n, 6) END AS cer
    FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""",
)
def character_error_rate(spark, d):
    cer = m.character_error_rate(F.col("reference"), F.col("hypothesis"))
    return _turn_pairs(Tables(spark, d)).select("conv_id", "turn", F.round(cer, 6).alias("cer"))


@query(
    "word_error_rate",
    "F6",
    r"""WITH RECURSIVE t AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM conversations),
    p AS (SELECT a.conv_id, a.turn, a.w AS ref, b.w AS hyp FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
    steps AS (
      SELECT conv_id, turn, ref, hyp, CAST(0 AS BIGINT) AS i, range(0, len(hyp) + 1) AS row FROM p
      UNION ALL
      SELECT conv_id, turn, ref, hyp, i + 1, list_transform(least_so_far, lambda x, k: list_min(least_so_far[1:k]) + k)
      FROM (
        SELECT conv_id, turn, ref, hyp, i, list_transform(
            list_concat([row[1] + 1], list_transform(range(1, len(hyp) + 1),
              lambda j: least(row[j] + CAST(hyp[j] <> ref[i + 1] AS BIGINT), row[j + 1] + 1))),
            lambda x, k: x - k) AS least_so_far
        FROM steps WHERE i < len(ref)))
    SELECT conv_id, turn, CASE WHEN len(ref) > 0 THEN round(row[len(hyp) + 1] / len(ref), 6) WHEN len(hyp) > 0 THEN 1 ELSE 0 END AS wer
    FROM steps WHERE i = len(ref)""",
)
def word_error_rate(spark, d):
    pairs = _turn_pairs(Tables(spark, d))
    return pairs.select("conv_id", "turn", F.round(m.word_error_rate("reference", "hypothesis"), 6).alias("wer"))


@query(
    "stage_latency",
    "F7",
    """SELECT event_type AS stage, count(*) AS samples, round(quantile_cont(value, 0.5), 6) AS p50_ms,
      round(quantile_cont(value, 0.95), 6) AS p95_ms, max(value) AS max_ms FROM events GROUP BY 1""",
)
def stage_latency(spark, d):
    samples = Tables(spark, d).events.select(F.col("event_type").alias("stage"), F.col("value").alias("latency_ms"))
    return m.stage_latency(samples).select(
        "stage", "samples", F.round("p50_ms", 6).alias("p50_ms"), F.round("p95_ms", 6).alias("p95_ms"), "max_ms"
    )


def gate_sql(passed: str) -> str:
    return f"""WITH {LABEL_SQL}, {cases_sql("base", "base_hits", 1)}, {cases_sql("cand", "other_hits", 2)},
    gains AS (SELECT c.suite, c.mrr - b.mrr AS mrr_gain, c.top1_accuracy - b.top1_accuracy AS top1_gain,
      c.mean_recall_at_5 - b.mean_recall_at_5 AS recall_at_5_gain,
      CASE WHEN b.latency_p95_ms <= 0 THEN 1 ELSE c.latency_p95_ms / b.latency_p95_ms END AS mult
      FROM base b JOIN cand c USING (suite))
    SELECT suite, {passed} AS passed, round(mrr_gain, 6) + 0.0 AS mrr_gain, round(top1_gain, 6) + 0.0 AS top1_gain,
      round(recall_at_5_gain, 6) + 0.0 AS recall_at_5_gain, round(mult, 4) AS p95_latency_multiplier FROM gains"""


def _gate(spark, d, gate):
    t = Tables(spark, d)
    hits = _label_hits(t)
    out = gate(m.suite_summary(_suite(t, hits, 1)), m.suite_summary(_suite(t, _reordered(hits), 2)))
    return out.select(
        "suite", "passed", *[(F.col(c) + 0.0).alias(c) for c in ("mrr_gain", "top1_gain", "recall_at_5_gain")], "p95_latency_multiplier"
    )


@query("rerank_gate", "F8", gate_sql("mrr_gain >= 0.01 AND top1_gain >= 0 AND mult <= 3"))
def rerank_gate(spark, d):
    return _gate(spark, d, m.rerank_gate)


@query("expansion_gate", "F8", gate_sql("(mrr_gain >= 0.01 OR recall_at_5_gain >= 0.01) AND top1_gain >= 0 AND mult <= 2"))
def expansion_gate(spark, d):
    return _gate(spark, d, m.expansion_gate)


# One case per conversation: assistant turns are claims citing themselves and the turn
# before; required claims are the first two words of each assistant turn.
@query(
    "faithfulness",
    "F9",
    f"""WITH turns AS (SELECT conv_id, turn, role, text, string_split({q.norm("text")}, ' ') AS w FROM conversations),
    claims AS (SELECT conv_id, turn, lower(CASE WHEN conv_id % 4 = 0 THEN substr(text, 1, 12) ELSE text END) AS text,
        CASE WHEN conv_id % 5 = 0 THEN [turn - 1] ELSE [turn, turn - 1] END AS ids FROM turns WHERE role = 'assistant'),
    required AS (SELECT conv_id, turn, [lower(w[1]), lower(coalesce(w[3], ''))] AS terms FROM turns WHERE role = 'assistant'),
    matched AS (
      SELECT r.conv_id, r.turn, r.terms, c.turn AS claim, c.ids FROM required r LEFT JOIN claims c
        ON c.conv_id = r.conv_id AND contains(c.text, r.terms[1]) AND contains(c.text, r.terms[2])
      QUALIFY row_number() OVER (PARTITION BY r.conv_id, r.turn ORDER BY c.turn) = 1),
    cited AS (SELECT m.conv_id, m.turn, string_agg(lower(t.text), ' ' ORDER BY list_position(m.ids, t.turn)) AS cited FROM matched m
      JOIN turns t ON t.conv_id = m.conv_id AND list_contains(m.ids, t.turn) GROUP BY ALL),
    checks AS (SELECT m.*, coalesce(contains(coalesce(cited, ''), terms[1]) AND contains(coalesce(cited, ''), terms[2])
        AND list_contains(ids, m.turn), false) AS supported FROM matched m LEFT JOIN cited USING (conv_id, turn)),
    rolled AS (SELECT conv_id, avg(CAST(supported AS INT)) AS support, list_distinct(list(turn)) AS want,
        list_distinct(coalesce(flatten(list(ids) FILTER (ids IS NOT NULL)), [])) AS have FROM checks GROUP BY conv_id),
    cases AS (SELECT DISTINCT conv_id FROM conversations),
    scored AS (
      SELECT c.conv_id AS case_id, c.conv_id % 7 <> 0 AS abstention_correct,
        CASE WHEN want IS NULL THEN 1 WHEN len(have) = 0 THEN 0 ELSE len(list_intersect(want, have)) / len(have) END AS citation_precision,
        CASE WHEN want IS NULL THEN 1 ELSE len(list_intersect(want, have)) / len(want) END AS citation_recall,
        coalesce(support, 1) AS claim_support_rate,
        CASE WHEN c.conv_id % 3 = 0 THEN 0.5 ELSE 1 END AS answer_term_recall,
        CASE WHEN c.conv_id % 6 = 1 THEN 0 ELSE 1 END AS contradiction_recall
      FROM cases c LEFT JOIN rolled r ON r.conv_id = c.conv_id)
    SELECT case_id, abstention_correct, round(citation_precision, 6) AS citation_precision, round(citation_recall, 6) AS citation_recall,
      round(claim_support_rate, 6) AS claim_support_rate, CAST(answer_term_recall AS DOUBLE) AS answer_term_recall,
      CAST(contradiction_recall AS DOUBLE) AS contradiction_recall,
      abstention_correct AND citation_precision = 1 AND citation_recall = 1 AND claim_support_rate = 1
        AND answer_term_recall = 1 AND contradiction_recall = 1 AS passed FROM scored""",
)
def faithfulness(spark, d):
    turns = Tables(spark, d).conversations
    n = F.col("conv_id")
    said = turns.where("role = 'assistant'")
    words = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    claims = said.select(
        n.alias("case_id"),
        F.col("turn").alias("claim_no"),
        F.when(n % 4 == 0, F.substring("text", 1, 12)).otherwise(F.col("text")).alias("text"),
        F.when(n % 5 == 0, F.array(F.col("turn") - 1)).otherwise(F.array(F.col("turn"), F.col("turn") - 1)).alias("chunk_ids"),
    )
    required = said.select(
        n.alias("case_id"),
        F.col("turn").alias("req_no"),
        F.array(F.get(words, F.lit(0)), F.coalesce(F.get(words, F.lit(2)), F.lit(""))).alias("terms"),
        F.array("turn").alias("expected_ids"),
    )
    cases = turns.select(n.alias("case_id")).distinct().select(
        "case_id",
        F.lit("The answer").alias("answer"),
        (F.col("case_id") % 7 == 0).alias("abstained"),
        F.lit(False).alias("expected_abstained"),
        F.lit(None).cast("int").alias("max_claims"),
        F.when(F.col("case_id") % 3 == 0, F.array(F.lit("ANSWER"), F.lit("zzz"))).otherwise(F.array(F.lit("answer"))).alias("answer_terms"),
        F.array(F.lit("dates differ")).alias("contradictions"),
        F.when(F.col("case_id") % 6 == 1, F.array(F.lit("zzz"))).otherwise(F.array(F.lit("Dates"))).alias("contradiction_terms"),
    )
    evidence = turns.select(n.alias("case_id"), F.col("turn").alias("chunk_id"), "text")
    out = m.faithfulness(cases, required, claims, evidence)
    rates = ("citation_precision", "citation_recall", "claim_support_rate", "answer_term_recall", "contradiction_recall")
    return out.select("case_id", "abstention_correct", *[F.round(c, 6).alias(c) for c in rates], "passed")


@query(
    "structure_score",
    "F10",
    """WITH n AS (SELECT l_orderkey AS k, count(*) AS lines FROM lineitem GROUP BY 1)
    SELECT 'o' || k AS artifact_id, CAST(lines + 1 AS INT) AS matched,
      CAST(lines + 2 + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS INT) AS checks,
      round((lines + 1) / (lines + 2 + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END), 6) AS structure_score FROM n""",
)
def structure_score(spark, d):
    items = Tables(spark, d).lineitem
    artifact = F.concat(F.lit("o"), F.col("l_orderkey")).alias("artifact_id")
    line = F.concat_ws("\t", F.concat(F.lit("part "), "l_partkey"), F.concat(F.lit("qty  "), "l_quantity"), F.concat(F.lit("price "), "l_extendedprice"))
    texts = items.groupBy(artifact).agg(
        F.concat(F.lit("Order "), F.first("l_orderkey"), F.lit("\nlines\n"), F.array_join(F.collect_list(line), "\n")).alias("text")
    )
    present = items.select(artifact, F.array(F.concat(F.lit("part "), "l_partkey"), F.concat(F.lit("price "), "l_extendedprice")).alias("cells"))
    absent = items.where("l_orderkey % 3 = 0").select(artifact).distinct().withColumn("cells", F.array(F.lit("price"), F.lit("part")))
    keys = items.select(artifact, "l_orderkey").distinct()
    fields = keys.select("artifact_id", F.lit("Order").alias("label"), F.col("l_orderkey").cast("string").alias("value")).unionByName(
        keys.select("artifact_id", F.lit("lines").alias("label"), F.lit("Order").alias("value"))
    )
    out = m.structure_score(texts, present.unionByName(absent), fields)
    return out.select("artifact_id", "matched", "checks", F.round("structure_score", 6).alias("structure_score"))


def _artifacts(t: Tables):
    n = F.col("doc_id")
    none = F.lit(None).cast("double")
    return t.texts.select(
        F.col("source").alias("corpus"),
        F.col("lang").alias("format"),
        n.alias("artifact_id"),
        F.when(F.trim("text") == "", "empty").otherwise("extracted").alias("status"),
        F.lit("extracted").alias("expected_status"),
        "text",
        F.lit(200).alias("min_text_chars"),
        F.array(F.concat(F.substring("lang", 1, 1), F.lit(" "))).alias("required_text"),
        (n % 10 == 0).alias("skipped"),
        F.when(n % 2 == 0, (n % 100) / 100).alias("cer"),
        F.when(n % 2 == 0, (n % 70) / 70).alias("wer"),
        F.lit(0.9).alias("max_cer"),
        none.alias("max_wer"),
        ((n % 8) / 8).alias("structure_score"),
        F.when(n % 3 == 0, F.lit(0.5)).alias("min_structure_score"),
        F.col("n_chars").cast("double").alias("latency_ms"),
    )


ARTIFACTS_SQL = f"""
    artifacts AS (
      SELECT source AS corpus, lang AS format, doc_id AS n, n_chars, doc_id % 10 = 0 AS skipped,
        trim(text) <> '' AND length(trim(text)) >= 200 AND contains({q.norm("text")}, substr(lang, 1, 1)) AS passed FROM documents),
    results AS (SELECT *, passed AND n % 2 = 0 AND n % 100 <= 90 AND (n % 3 <> 0 OR n % 8 >= 4) AS bench FROM artifacts)"""


@query(
    "corpus_summary",
    "F11",
    f"""WITH {ARTIFACTS_SQL} SELECT corpus, count(*) AS total, count_if(skipped) AS skipped, count_if(NOT skipped) AS executed,
      coalesce(round(avg(CAST(passed AS INT)) FILTER (NOT skipped), 6), 0) AS ingestion_success_rate,
      coalesce(round(avg(CAST(bench AS INT)) FILTER (NOT skipped), 6), 0) AS benchmark_success_rate,
      round(avg((n % 100) / 100) FILTER (NOT skipped AND n % 2 = 0), 6) AS mean_cer,
      round(avg((n % 70) / 70) FILTER (NOT skipped AND n % 2 = 0), 6) AS mean_wer,
      round(avg((n % 8) / 8) FILTER (NOT skipped), 6) AS mean_structure_score,
      coalesce(round(quantile_cont(CAST(n_chars AS DOUBLE), 0.5) FILTER (NOT skipped), 6), 0) AS latency_p50_ms,
      coalesce(round(quantile_cont(CAST(n_chars AS DOUBLE), 0.95) FILTER (NOT skipped), 6), 0) AS latency_p95_ms,
      coalesce(max(CAST(n_chars AS DOUBLE)) FILTER (NOT skipped), 0) AS latency_max_ms FROM results GROUP BY corpus""",
)
def corpus_summary(spark, d):
    out = m.corpus_summary(m.artifact_results(_artifacts(Tables(spark, d))))
    rounded = (
        "ingestion_success_rate", "benchmark_success_rate", "mean_cer", "mean_wer", "mean_structure_score",
        "latency_p50_ms", "latency_p95_ms",
    )
    return out.select("corpus", "total", "skipped", "executed", *[F.round(c, 6).alias(c) for c in rounded], "latency_max_ms")


@query(
    "success_by_format",
    "F11",
    f"""WITH {ARTIFACTS_SQL} SELECT format, count(*) AS executed, round(avg(CAST(passed AS INT)), 6) AS success_rate
    FROM results WHERE NOT skipped GROUP BY format""",
)
def success_by_format(spark, d):
    out = m.success_by_format(m.artifact_results(_artifacts(Tables(spark, d))))
    return out.select("format", "executed", F.round("success_rate", 6).alias("success_rate"))


def _routed(t: Tables):
    pages = page_text.ocr_page_rollup(_ocr_words(t))
    n = F.col("doc_id") + F.col("page")
    return m.route_pages(pages).withColumn("cer", (n * 13 % 50) / 100).withColumn("wer", (n * 29 % 100) / 100)


ROUTED_SQL = f"""{OCR_WORDS_SQL},
    routed AS (SELECT *, CASE WHEN {q.visible("text")} < 24 THEN 'ocr-low-text' WHEN confidence < 90 THEN 'ocr-low-confidence' END AS reason,
      (doc_id + page) * 13 % 50 > 25 OR (doc_id + page) * 29 % 100 > 50 AS poor FROM rolled)"""


@query(
    "route_pages",
    "F12",
    f"WITH {ROUTED_SQL} SELECT coalesce(reason, 'keep') AS reason, count(*) AS pages FROM routed GROUP BY ALL",
)
def route_pages(spark, d):
    return _routed(Tables(spark, d)).groupBy(F.coalesce("reason", F.lit("keep")).alias("reason")).agg(F.count("*").alias("pages"))


@query(
    "routing_quality",
    "F12",
    f"""WITH {ROUTED_SQL} SELECT count(*) AS pages, count_if(poor) AS poor, count_if(reason IS NOT NULL) AS escalated,
      round(count_if(poor AND reason IS NOT NULL) / count_if(reason IS NOT NULL), 6) AS precision,
      round(count_if(poor AND reason IS NOT NULL) / count_if(poor), 6) AS recall,
      round((count_if(poor AND reason IS NOT NULL) + count_if(NOT poor AND reason IS NULL)) / count(*), 6) AS accuracy FROM routed""",
)
def routing_quality(spark, d):
    out = m.routing_quality(_routed(Tables(spark, d)))
    return out.select("pages", "poor", "escalated", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "accuracy")])


# One scenario per customer: from its region to the customer in two steps.
@query(
    "multi_hop_eval",
    "F13",
    f"""WITH RECURSIVE {STAR_SQL}, reach AS (
      SELECT 'r' || r_regionkey AS start_id, 'r' || r_regionkey AS node, 0 AS depth FROM region
      UNION SELECT start_id, other, depth + 1 FROM reach JOIN ends USING (node) WHERE depth < 2),
    first AS (SELECT start_id, node, min(depth) AS depth FROM reach GROUP BY ALL),
    found AS (SELECT f.start_id, s, t, any_value(relation_type) AS relation_type, any_value(created) AS created, min(f.depth) + 1 AS depth
      FROM first f JOIN star ON node = s OR node = t WHERE f.depth < 2 GROUP BY f.start_id, s, t),
    evidence AS (SELECT start_id, count_if(created % 2 = 0) AS edges, count(DISTINCT relation_type) AS types FROM found
      WHERE relation_type IN ('in_region', 'located_in') GROUP BY 1),
    scen AS (SELECT 'c' || c_custkey AS scenario_id, 'r' || (c_custkey % 5) AS start_id, 'c' || c_custkey AS target,
      CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 2 END AS want, n_regionkey = c_custkey % 5 AS near, c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey)
    SELECT scenario_id, CASE WHEN near THEN 2 END AS target_depth, near AND want = 2 AS target_reached,
      coalesce(types, 0) = 2 AS required_relations_found, CAST(coalesce(edges, 0) AS BIGINT) AS evidence_edges,
      coalesce(edges, 0) >= 2 AS provenance_complete, near AND want = 2 AND coalesce(types, 0) = 2 AND coalesce(edges, 0) >= 2 AS passed
    FROM scen LEFT JOIN evidence USING (start_id)""",
)
def multi_hop_eval(spark, d):
    t = Tables(spark, d)
    starts = t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("start_id"))
    walked = g.k_hop(starts, star_relations(t), 2).withColumn("evidence", F.col("created") % 2 == 0)
    n = F.col("c_custkey")
    scenarios = t.customer.select(
        F.concat(F.lit("c"), n).alias("scenario_id"),
        F.concat(F.lit("r"), n % 5).alias("start_id"),
        F.concat(F.lit("c"), n).alias("target_id"),
        F.lit(2).alias("max_depth"),
        F.when(n % 7 == 0, 1).otherwise(2).alias("expected_depth"),
        F.array(F.lit("in_region"), F.lit("located_in")).alias("required_types"),
        F.lit(2).alias("expected_evidence"),
    )
    return g.multi_hop_eval(scenarios, walked)


@query(
    "sync_efficiency",
    "F14",
    """WITH j AS (SELECT lang AS scenario_id, doc_id % 7 = 0 AS should, doc_id % 7 = 0 OR (lang = 'fr' AND doc_id % 50 = 1) AS done,
        lang <> 'es' OR doc_id % 7 <> 0 AS seen FROM documents),
    p AS (SELECT scenario_id, count(*) AS total, count_if(done AND seen) AS changed, count_if(should) AS expected_changed,
      count_if(done AND seen) AS indexed, count_if(done AND seen AND NOT should) AS unnecessary, count_if(should AND NOT (done AND seen)) AS missed,
      count_if(NOT done AND seen) AS unchanged FROM j GROUP BY 1)
    SELECT *, round(indexed / total, 6) AS reprocess_rate, round(CASE WHEN changed = 0 THEN 0 ELSE indexed / changed END, 6) AS amplification,
      changed = expected_changed AND unnecessary = 0 AND missed = 0 AND unchanged = total - expected_changed AS passed FROM p""",
)
def sync_efficiency(spark, d):
    docs = Tables(spark, d).documents
    n = F.col("doc_id")
    expected = docs.select(F.col("lang").alias("scenario_id"), n.alias("resource_id"), (n % 7 == 0).alias("changed"))
    done = (n % 7 == 0) | ((F.col("lang") == "fr") & (n % 50 == 1))
    actual = docs.where((F.col("lang") != "es") | (n % 7 != 0)).select(
        F.col("lang").alias("scenario_id"), n.alias("resource_id"), F.when(done, "changed").otherwise("unchanged").alias("outcome"), done.alias("indexed")
    )
    out = m.sync_efficiency(expected, actual)
    return out.withColumn("reprocess_rate", F.round("reprocess_rate", 6)).withColumn("amplification", F.round("amplification", 6))


@query(
    "search_invariants",
    "F15",
    f"""WITH {HITS_SQL}, f AS (SELECT *, first_value(collection_id) OVER (PARTITION BY query_id, uri ORDER BY rank) AS winner FROM hits),
    kept AS (SELECT * FROM f WHERE uri = '' OR winner = collection_id)
    SELECT 'collection_isolation' AS check, count_if(collection_id NOT IN ('c0', 'c1', 'c2')) AS violations FROM kept
    UNION ALL SELECT 'tenant_isolation', 0
    UNION ALL SELECT 'one_winner_per_uri', (SELECT count(*) FROM (SELECT query_id, uri FROM kept WHERE uri <> '' GROUP BY ALL
      HAVING count(DISTINCT collection_id) > 1))
    UNION ALL SELECT 'conflicting_sources_kept', 0
    UNION ALL SELECT 'stale_evidence_kept', 0""",
)
def search_invariants(spark, d):
    t = Tables(spark, d)
    hits = _hits(t)
    kept = fu.federated_dedupe(hits, 300)
    scope = t.documents.select(F.col("lang").alias("query_id"), F.concat(F.lit("c"), F.col("doc_id") % 3).alias("collection_id")).distinct()
    tenant = F.concat(F.lit("n"), "s_nationkey")
    keys = t.supplier.select(
        F.concat(F.lit("s"), "s_suppkey").alias("consumer_id"), tenant.alias("tenant_id"), F.lit("active").alias("status"), F.lit(None).cast("int").alias("expires_at")
    )
    policies = t.part.select(
        F.col("p_partkey").alias("collection_id"), F.concat(F.lit("n"), F.col("p_size") % 25).alias("tenant_id"), F.array().cast("array<string>").alias("allowed_consumers")
    )
    requests = t.lineitem.select(F.concat(F.lit("s"), "l_suppkey").alias("consumer_id"), F.col("l_partkey").alias("collection_id")).distinct()
    decided = (
        ev.authorize(requests, policies, keys, F.lit(0))
        .join(policies.select("collection_id", F.col("tenant_id").alias("policy_tenant")), "collection_id")
        .join(keys.select("consumer_id", F.col("tenant_id").alias("own_tenant")), "consumer_id")
    )
    conflicts = hits.where("canonical_uri <> ''").select("query_id", "canonical_uri").distinct()
    stale = t.documents.select(
        F.col("doc_id").alias("resource_id"), F.sha2("text", 256).alias("hash_before"), F.sha2("text", 256).alias("hash_after"), F.lit(True).alias("in_index")
    )
    return m.hit_invariants(kept, scope, decided, conflicts, stale)


OPERATIONS = {"click": "search", "view": "process", "purchase": "ingest", "error": "answer", "signup": "extract"}


def _operations(t: Tables):
    names = F.create_map(*[F.lit(x) for pair in OPERATIONS.items() for x in pair])
    return t.events.select(
        names[F.col("event_type")].alias("operation"),
        (F.col("value") * 30).cast("long").alias("latency_ms"),
        (F.get_json_object("props", "$.k").cast("int") % 97 == 0).alias("failed"),
        "event_id",
        "ts",
    )


SLO_SQL = """
    ops AS (SELECT CASE event_type WHEN 'click' THEN 'search' WHEN 'view' THEN 'process' WHEN 'purchase' THEN 'ingest'
        WHEN 'error' THEN 'answer' ELSE 'extract' END AS operation, CAST(trunc(value * 30) AS BIGINT) AS ms,
      CAST(json_extract(props, '$.k') AS INT) % 97 = 0 AS failed FROM events),
    per AS (SELECT operation, count(*) AS requests, count_if(failed) AS errors, count(*) AS samples,
      CAST(round_even(quantile_cont(CAST(ms AS DOUBLE), 0.95), 0) AS BIGINT) AS p95_ms, count_if(failed) / count(*) AS rate FROM ops GROUP BY 1),
    slo AS (SELECT *, CASE WHEN samples < 20 THEN 'insufficient-data' WHEN rate <= 0.01 AND p95_ms <=
      CASE operation WHEN 'search' THEN 1500 WHEN 'answer' THEN 20000 ELSE 10000 END THEN 'green' ELSE 'red' END AS status FROM per)"""


@query(
    "slo_status",
    "F16",
    f"WITH {SLO_SQL} SELECT operation, requests, errors, samples, p95_ms, round(rate, 6) AS error_rate, status FROM slo",
)
def slo_status(spark, d):
    return m.slo_status(_operations(Tables(spark, d))).withColumn("error_rate", F.round("error_rate", 6))


@query(
    "overall_status",
    "F16",
    f"""WITH {SLO_SQL} SELECT CASE WHEN count_if(status = 'red') > 0 THEN 'red' WHEN count_if(status = 'green') > 0 THEN 'green'
      ELSE 'insufficient-data' END AS overall FROM slo""",
)
def overall_status(spark, d):
    return m.overall_status(m.slo_status(_operations(Tables(spark, d))))
