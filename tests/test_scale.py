"""Operators that take another path for large or skewed input give the same answer on it."""

import re

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from dossier.operators import blocks, billing, digests, lexical, neighbours, ordered, page_text, vectors, word_index


def test_with_next_on_one_hot_key(spark):
    df = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
        (F.hash("id") % 100_000).alias("t"),
        "id",
    )
    plain = df.withColumn("n", F.lead("id").over(Window.partitionBy("k").orderBy("t", "id")))
    mine = ordered.with_next(df, ["k"], ["t", "id"], F.floor(F.col("t") / 5000), ["id"], "nx").select("k", "t", "id", F.col("nx.id").alias("n"))
    assert plain.exceptAll(mine).count() == 0 and mine.count() == 20_000


def test_exact_percentiles_beyond_the_bracket_limit(spark):
    rng = np.random.default_rng(3)
    data = {
        "wide": rng.normal(0, 100, 60_000),
        "tied": np.repeat([1.0, 2.0, 2.0, 3.0], 10_000),
        "few": np.array([5.0, 1.0, 4.0]),
        "one": np.array([7.0]),
    }
    df = spark.createDataFrame([(g, float(v)) for g, vs in data.items() for v in vs], "g string, v double")
    wanted = {"a": 0.0, "b": 0.3, "c": 0.5, "d": 0.95, "e": 1.0}
    for r in ordered.exact_percentiles(df, ["g"], "v", wanted).collect():
        assert r.samples == len(data[r.g]) and r["max"] == data[r.g].max()
        for name, quantile in wanted.items():
            assert abs(r[name] - np.quantile(data[r.g], quantile)) < 1e-9, (r.g, name)
    total = ordered.exact_percentiles(df, [], "v", {"m": 0.5}).first()
    assert abs(total.m - np.quantile(np.concatenate(list(data.values())), 0.5)) < 1e-9


def test_two_level_digest_changes_with_any_row(spark):
    df = spark.range(500).select(F.lit("g").alias("g"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    digest = lambda d: digests.sorted_digest(d, ["g"], "h", F.col("h")).first()
    import hashlib
    from itertools import groupby

    ids, sha = sorted(r.h for r in df.collect()), lambda x: hashlib.sha256("\n".join(x).encode()).hexdigest()
    whole = digest(df)
    assert (whole.lines, whole.digest) == (500, sha([sha(rows) for _, rows in groupby(ids, lambda h: h[:5])]))
    assert digest(df.where("h <> '" + ids[7] + "'")).digest != whole.digest
    assert digest(df.repartition(7)).digest == whole.digest


def _vectors(spark, n, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    block = rng.normal(size=(n, dim)).round(1)
    block[3] = 0
    block[10:20] = block[9]  # equal vectors: ids decide
    return block, spark.createDataFrame([(i, block[i].tolist()) for i in range(n)], "chunk_id long, vector array<double>")


def brute_knn(queries, block, k):
    sizes = np.linalg.norm(block, axis=1)
    out = set()
    for q, row in enumerate(queries):
        if not row.any():
            continue
        score = np.where(sizes > 0, block @ row / np.where(sizes > 0, sizes, 1) / np.linalg.norm(row), 0).round(12)
        for rank, i in enumerate(np.lexsort((np.arange(len(block)), -score))[:k], start=1):
            out.add((q, int(i), rank))
    return out


@pytest.mark.parametrize("cell_rows, pivots, group", [(2048, 512, 4096), (20, 512, 16), (5, 7, 3)])
def test_knn_over_cells_and_groups(spark, monkeypatch, cell_rows, pivots, group):
    block, vs = _vectors(spark, 300)
    queries, qs = _vectors(spark, 60, seed=2)
    qs = qs.withColumnRenamed("chunk_id", "query_id")
    monkeypatch.setattr(neighbours, "GROUP_VECTORS", group)
    monkeypatch.setattr(neighbours, "GROUP_QUERIES", group)
    for k in (4, 40):
        found = neighbours.knn_join(qs, vs.repartition(5), k, cell_rows, pivots).select("query_id", "chunk_id", "rank")
        assert {tuple(r) for r in found.collect()} == brute_knn(queries, block, k)


def test_knn_of_nothing(spark):
    _, vs = _vectors(spark, 30)
    qs = vs.withColumnRenamed("chunk_id", "query_id")
    assert neighbours.knn_join(qs.limit(0), vs, 3).count() == 0
    assert neighbours.knn_join(qs, vs.limit(0), 3).count() == 0
    zeros = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0])], "chunk_id long, vector array<double>")
    one = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    assert [tuple(r) for r in neighbours.knn_join(one, zeros, 3).orderBy("rank").collect()] == [(1, 1, 0.0, 1), (1, 2, 0.0, 2)]


def test_far_cells_are_ruled_out(spark):
    """Bounds hold for every vector of a cell, and most cells of clustered vectors are never met."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    block = centres[rng.integers(0, 40, 2000)] + 0.05 * rng.normal(size=(2000, 16))
    vs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(block)], "chunk_id long, vector array<double>")
    cells = neighbours.pick_pivots(vs, 25, 512)
    members = neighbours.in_cells(vs, cells)
    cells.measure(members.groupBy("cell").agg(F.count("*").alias("rows"), F.min("angle").alias("least"), F.max("angle").alias("most")).collect())
    cell = {r["chunk_id"]: r["cell"] for r in members.collect()}
    units = block / np.linalg.norm(block, axis=1, keepdims=True)
    cosines, bound = units[:50] @ units.T, cells.bounds(16, units[:50])[1]
    assert all(bound[q, cell[i]] >= cosines[q, i] for q in range(50) for i in range(2000))
    shared = spark.sparkContext.broadcast(cells)
    qs = vs.limit(50).select(F.col("chunk_id").alias("query_id"), "vector", F.lit(0.95).alias("floor"))
    later = neighbours.asking(qs, shared, 5, later=True).count()
    assert later < 0.25 * 50 * cells.total


def test_a_query_is_sent_once_to_a_block_of_cells(spark):
    _, vs = _vectors(spark, 300)
    cells = neighbours.pick_pivots(vs, 20, 512)
    members = neighbours.in_cells(vs, cells)
    cells.measure(members.groupBy("cell").agg(F.count("*").alias("rows"), F.min("angle").alias("least"), F.max("angle").alias("most")).collect())
    assert cells.blocks == 1 < (cells.rows > 0).sum()
    qs = vs.withColumnRenamed("chunk_id", "query_id").where("query_id <> 3")
    sent = neighbours.asking(qs, spark.sparkContext.broadcast(cells), 200, later=False).collect()
    assert len(sent) == len({r.query_id for r in sent}) == 299 and all(len(r.cells) > 1 for r in sent)


def test_label_hits_are_searched_once(spark):
    from dossier.plans import evaluation
    from dossier.plans.registry import Tables

    hits = evaluation._label_hits(Tables(spark, "/root/testdata/sf0.001"))
    assert "FlatMapCoGroups" not in hits._jdf.queryExecution().executedPlan().toString()


def test_knn_plan_has_no_broadcast_of_queries(spark):
    _, vs = _vectors(spark, 300)
    plan = neighbours.knn_join(vs.withColumnRenamed("chunk_id", "query_id"), vs, 3, 20)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    # One union: the first round, which is written, and the second.
    assert plan.count("Union") == 1


def test_probing_every_list_is_exact_even_when_lists_are_split(spark):
    block, vs = _vectors(spark, 200)
    queries, qs = _vectors(spark, 40, seed=4)
    qs = qs.where("query_id <> 3" if "query_id" in qs.columns else "chunk_id <> 3").withColumnRenamed("chunk_id", "query_id")
    centroids = [c for c in vectors.pick_centroids(vs.where("chunk_id <> 3"), 5)]
    found = vectors.probed_topk(qs, vs, 4, centroids, probes=5, rows=11).select("query_id", "chunk_id", "rank").collect()
    queries[3] = 0
    assert {tuple(r) for r in found} == brute_knn(queries, block, 4)


def test_scores_of_a_list_are_made_in_stretches(monkeypatch):
    import pyarrow as pa

    block = np.random.default_rng(6).normal(size=(70, 8))
    ids, rows = pa.array(range(70), pa.int64()), pa.array(block.tolist(), pa.list_(pa.float64()))
    made = []
    scores_of = vectors.scores_of
    monkeypatch.setattr(vectors, "CELLS", 500)
    monkeypatch.setattr(vectors, "scores_of", lambda m, u: made.append(len(m) * len(u)) or scores_of(m, u))
    stored, asked = pa.table({"chunk_id": ids, "vector": rows}), pa.table({"query_id": ids, "vector": rows})
    found = vectors.best_of_group(stored, asked, 4, "bigint", "bigint").to_pylist()
    assert {(r["query_id"], r["chunk_id"], n % 4 + 1) for n, r in enumerate(found)} == brute_knn(block, block, 4)
    assert max(made) <= 500


def test_cosine_topk_edges(spark):
    _, vs = _vectors(spark, 30)
    stored = vs.withColumn("collection_id", F.lit("c")).withColumn("provider", F.lit("p")).withColumn("model", F.lit("m"))
    assert vectors.cosine_topk(stored, [0.0] * 8, 3).count() == 0
    assert vectors.cosine_topk(stored, [1.0] * 8, 3, collections=[]).count() == 0
    assert vectors.cosine_topk(stored, [1.0] * 9, 3).count() == 0
    zero = [r for r in vectors.cosine_topk(stored, [1.0] * 8, 30).collect() if r.chunk_id == 3]
    assert zero[0].score == 0.0


def brute_count(queries, docs, k):
    import re

    out = set()
    for qid, query in queries:
        tokens = [w.casefold() for w in re.findall(r"[\w\-]+", query)]
        scored = []
        for did, title, text in docs:
            hay = f"{title} {text}".casefold()
            score = 5.0 if tokens and query.casefold() in hay else 0.0
            for token in tokens:
                n = hay.count(token)
                score += 1 + min(n, 8) * 0.25 if n else 0
            if score > 0:
                scored.append((-score, did))
        for rank, (score, did) in enumerate(sorted(scored)[:k], start=1):
            out.add((qid, did, -score, rank))
    return out


def test_word_counter_without_the_matcher(monkeypatch):
    words = {"ab", "aba", "b-a", "x", "a_b", "i̇x"}
    texts = ["ababa ab-aba a_bab", "", "xx i̇x i̇xab", "b-ab-a, b-a"]
    with_matcher = word_index.WordCounter(words)
    monkeypatch.setattr(word_index, "ahocorasick", None)
    plain = word_index.WordCounter(words)
    for text in texts:
        expected = {i: 1 + 0.25 * min(text.count(w), 8) for i, w in enumerate(plain.words) if w in text}
        for counter in (plain, with_matcher):
            places, gains = counter.hits(text)
            assert dict(zip(places.tolist(), gains.tolist())) == expected


def test_frequent_words_are_not_looked_up(spark, monkeypatch):
    """Texts that hold only words every text holds are ruled out by the floor, and the result stays exact."""
    rng = np.random.default_rng(9)
    rare = [f"zq{chr(97 + i)}xw" for i in range(12)]
    docs = [(i, "", " ".join(["the and der und"] + [str(w) for w in rng.choice(rare, 8 if i < 30 else 0)])) for i in range(400)]
    queries = [(i, " ".join(["the", "and", *map(str, rng.choice(rare, 6, replace=False))])) for i in range(10)]
    looked: list[int] = []
    plain = word_index.texts_with_words
    monkeypatch.setattr(word_index, "texts_with_words", lambda *a: (found := plain(*a), looked.append(found.count()))[0])
    qs = spark.createDataFrame(queries, "query_id long, query string")
    ds = spark.createDataFrame(docs, "chunk_id long, title string, text string")
    hits = word_index.count_search_indexed(qs, word_index.build_word_index(ds), 3)
    assert {tuple(r) for r in hits.select("query_id", "chunk_id", "score", "rank").collect()} == brute_count(queries, docs, 3)
    assert sum(looked) <= 2 * 30 * len(queries)


def test_batch_search_of_nothing(spark):
    qs = spark.createDataFrame([(1, "a b"), (2, None), (3, " !? ")], "query_id long, query string")
    ds = spark.createDataFrame([(1, None, None), (2, "", "c d")], "chunk_id long, title string, text string")
    for docs in (ds, ds.limit(0)):
        assert word_index.count_search_batch(qs, docs, 3).count() == 0
        assert word_index.count_search_indexed(qs, word_index.build_word_index(docs), 3).count() == 0
    assert word_index.count_search_batch(qs.limit(0), ds, 3).count() == 0


def test_batch_counting_search_against_the_rule(spark, monkeypatch):
    rng = np.random.default_rng(8)
    words = ["ab", "aba", "b-a", "Straße", "ß", "aa", "x", "ÉTÉ", "i̇x", "a_b"]
    docs = [(i, rng.choice(words), " ".join(rng.choice(words, rng.integers(0, 30)))) for i in range(80)]
    docs = [(i, str(a), str(b)) for i, a, b in docs]
    queries = [(i, " ".join(map(str, rng.choice(words, rng.integers(1, 4))))) for i in range(30)] + [(99, " !? ")]
    for name, value in {"ASKED": 9, "CELLS": 50, "REMEMBERED": 5, "BLOCK_BYTES": 100, "FEW_ROWS": 10}.items():
        monkeypatch.setattr(word_index, name, value)
    qs = spark.createDataFrame(queries, "query_id long, query string")
    ds = spark.createDataFrame(docs, "chunk_id long, title string, text string")
    index = word_index.build_word_index(ds)
    for k in (2, 6):
        for hits in (word_index.count_search_batch(qs, ds, k), word_index.count_search_indexed(qs, index, k)):
            found = hits.select("query_id", "chunk_id", "score", "rank").collect()
            assert {tuple(r) for r in found} == brute_count(queries, docs, k)
    for qid, query in queries[:5]:
        single = lexical.count_search(ds, query, 6).collect()
        assert {(r.chunk_id, r.score) for r in single} == {(d, s) for q, d, s, _ in brute_count(queries, docs, 6) if q == qid}


def test_as_of_assignment_equals_range_join(spark, rows):
    history = spark.createDataFrame(
        [("t", f"p{i}", f"2024-{1 + i % 12:02d}-{1 + (i * 7) % 27:02d} 00:00:00") for i in range(40)], "tenant_id string, catalog_id string, s string"
    ).select("tenant_id", "catalog_id", F.col("s").cast("timestamp_ntz").alias("effective_from"))
    plans = billing.assign_plan(history, F.date_trunc("month", "effective_from"))
    periods = spark.createDataFrame([("t", f"2024-{m:02d}-{d:02d}") for m in range(1, 13) for d in (2, 15, 28)], "tenant_id string, s string").select(
        "tenant_id", F.col("s").cast("timestamp_ntz").alias("period_start"), (F.col("s").cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")).alias("period_end")
    )
    mine = billing.assignment_for_period(plans, periods).select("period_start", "catalog_id")
    slow = periods.join(plans, "tenant_id").where(
        "effective_from <= period_start AND (effective_to IS NULL OR effective_to >= period_end)"
    ).groupBy("period_start").agg(F.max_by("catalog_id", "effective_from").alias("catalog_id"))
    assert rows(mine) == rows(slow) and mine.count() > 5


def test_billed_usage_with_cut_days(spark, rows):
    rng = np.random.default_rng(5)
    events = spark.createDataFrame(
        [("t", "op", "u", int(rng.integers(0, 9)), bool(rng.random() < 0.8), float(s)) for s in rng.integers(0, 20 * 86_400, 3_000)],
        "tenant_id string, operation string, unit string, quantity long, billable boolean, s double",
    ).withColumn("created_at", F.timestamp_seconds(F.col("s") + 1_704_067_200).cast("timestamp_ntz"))
    spans = [("2024-01-02 00:00", "2024-01-05 00:00"), ("2024-01-03 07:30", "2024-01-09 22:15"), ("2024-01-04 01:00", "2024-01-04 02:00"), ("2024-01-06 12:00", "2024-01-07 12:00")]
    periods = spark.createDataFrame([("t", a, b) for a, b in spans], "tenant_id string, a string, b string").select(
        "tenant_id", F.col("a").cast("timestamp_ntz").alias("period_start"), F.col("b").cast("timestamp_ntz").alias("period_end")
    )
    slow = events.where("billable").join(periods, "tenant_id").where("created_at >= period_start AND created_at < period_end")
    slow = slow.groupBy("tenant_id", "period_start", "period_end", "operation", "unit").agg(F.sum("quantity").alias("quantity"))
    assert rows(billing.billed_usage(events, periods)) == rows(slow) and slow.count() == 4


def test_as_of_carries_over_empty_buckets(spark, rows):
    known = spark.createDataFrame([("a", 1, "x"), ("a", 500, "y"), ("b", 7, "z")], "k string, t int, v string")
    asked = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("a", 499, 3), ("a", 900, 4), ("b", 8, 5), ("c", 9, 6)], "k string, at int, n int")
    out = ordered.as_of(asked, known, ["k"], "at", "t", lambda t: F.floor(t / 100), ["v"], "w")
    assert rows(out.select("n", "w.v")) == [(1, None), (2, "x"), (3, "x"), (4, "y"), (5, "z"), (6, None)]


def test_no_limit_unless_asked(spark):
    """Results beyond the limits that single requests used to have."""
    from dossier.operators import evidence, fusion, graph, memory, sync, web

    assert fusion.candidate_limit(500) == 1500 and fusion.overfetch(500, 1, True) == 2000
    n = 600
    rel = spark.range(n).select(
        F.col("id").alias("relation_id"), F.lit("hub").alias("source_id"), F.col("id").cast("string").alias("target_id"),
        F.lit("r").alias("relation_type"), F.lit("canonical").alias("status"), F.col("id").alias("created"),
    )
    assert graph.neighbors(rel, "hub").count() == n and graph.neighbors(rel, "hub", k=550).count() == 550
    starts = spark.createDataFrame([("hub",)], "start_id string")
    assert graph.k_hop(starts, rel, 6).count() == n and graph.k_hop(starts, rel, 1, limit=550).count() == 550
    due = spark.range(n).select(F.col("id").alias("resource_id"), F.lit(1).alias("next_refresh_at"))
    assert sync.due_resources(due, F.lit(2)).count() == n and sync.due_resources(due, F.lit(2), 300).count() == 300
    runs = spark.range(n).select(F.lit(1).alias("resource_id"), F.col("id").alias("run_id"), F.col("id").alias("at"))
    assert sync.refresh_history(runs, 1).count() == n
    told = spark.range(1200).select(F.lit("c").alias("collection_id"), F.col("id").alias("feedback_id"), F.col("id").alias("created_at"))
    assert evidence.feedback_latest(told, "c").count() == 1200
    log = spark.createDataFrame([(1, "x" * 5000)], "event_id int, message string")
    assert len(web.crawl_failures(log).first().message) == 5000 and len(web.crawl_failures(log, 1000).first().message) == 1000
    chunks = spark.createDataFrame([(1, "y" * 5000)], "chunk_id int, text string")
    kept = memory.memory_provenance(spark.createDataFrame([(7,)], "write_id int"), spark.createDataFrame([(7, 1)], "write_id int, chunk_id int"), chunks)
    assert len(kept.first().excerpt) == 5000
    native = spark.createDataFrame([(1, p, "") for p in range(14)], "doc_id int, page int, text string")
    ocr = spark.createDataFrame([(1, p, "z" * 60, 99.0) for p in range(14)], "doc_id int, page int, text string, confidence double")
    vision = spark.createDataFrame([], "doc_id int, page int, text string")
    assert page_text.page_cascade(native, ocr, vision).first().skipped_pages == []
    assert page_text.page_cascade(native, ocr, vision, budget=10).first().skipped_pages == [10, 11, 12, 13]


def test_order_keys_of_large_numbers(spark):
    from dossier.operators import web

    pages = spark.createDataFrame([("a",), ("b",)], "source string")
    links = spark.createDataFrame([("a", 0, "x", "from a"), ("b", 0, "x", "from b")], "source string, pos int, url string, text string")
    seeds = spark.createDataFrame([("a", 99_999_999), ("b", 99_999_998)], "url string, seed_no int")
    found, _ = web.crawl_frontier(pages, links, seeds, 1)
    assert found.first().parent_url == "b"


def test_upsert_refuses_and_append_chooses(spark):
    import pytest

    from dossier.operators import stores

    schema = "chunk_id int, provider string, model string, vector array<double>"
    target = spark.createDataFrame([(1, "p", "m", [1.0])], schema)
    good = spark.createDataFrame([(1, "p", "m", [2.0]), (2, "p", "m", [3.0])], schema)
    assert {(r.chunk_id, r.vector[0]) for r in stores.upsert_embeddings(target, good).collect()} == {(1, 2.0), (2, 3.0)}
    for bad in ([(2, "p", "m", [3.0])] * 2, [(3, "p", "m", [])], [(None, "p", "m", [1.0])]):
        with pytest.raises(Exception, match="upsert refused"):
            stores.upsert_embeddings(target, spark.createDataFrame(bad, schema)).collect()
    rows = spark.createDataFrame([(1, "c"), (1, "a"), (2, "b"), (1, "b")], "k int, v string")
    for parts in (1, 4):
        got = stores.append_new(rows.limit(0), rows.repartition(parts), "k")
        assert {(r.k, r.v) for r in got.collect()} == {(1, "a"), (2, "b")}


def test_knn_skips_null_and_other_dimensions(spark):
    schema = "chunk_id long, vector array<double>"
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0, 0.0, 0.0]), (4, [1.0]), (5, [0.0, 1.0])], schema)
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, None)], "query_id long, vector array<double>")
    got = {(r.query_id, r.chunk_id) for r in neighbours.knn_join(queries, corpus, 5).collect()}
    assert got == {(1, 1), (1, 5), (2, 3)}


def test_audit_reports_orphan_chunks(spark):
    from dossier.operators import audits

    docs = spark.createDataFrame([("g", "r", "d1", "some text")], "source string, resource_id string, document_id string, text string")
    chunks = docs.select("document_id", F.lit("c1").alias("chunk_id"), F.col("text").alias("chunk_text"), F.sha2("text", 256).alias("content_hash"),
                         F.lit(0).alias("char_start"), F.char_length("text").alias("char_end"))
    orphan = chunks.withColumns({"document_id": F.lit("gone"), "chunk_id": F.lit("c2")})
    got = {r.source: r for r in audits.audit_chunk_export(docs, chunks.unionByName(orphan), "source").collect()}
    assert got["g"].verified and got["g"].chunks == 1
    assert (got[None].chunks, got[None].verified) == (1, False) and "ORPHAN_CHUNK" in got[None].error_codes


def test_a_batch_is_read_in_parts():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(10))], names=["n"])
    parts = list(blocks.in_parts([batch, batch.slice(0, 0), batch.slice(0, 3)], 4))
    assert [p.column(0).to_pylist() for p in parts] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9], [0, 1, 2]]


def test_pages_and_documents_are_read_in_parts(spark, monkeypatch):
    """The readers hand on what a part gives before they read the next one."""
    import pyarrow as pa

    from dossier.operators import chunking, markup

    taken = {}
    monkeypatch.setattr(blocks, "spread", lambda df, key: df)
    frame = type(spark.range(1))
    monkeypatch.setattr(frame, "mapInArrow", lambda df, run, schema: taken.update(run=run) or df)
    pages = spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string")
    n = 2 * blocks.PART + 1
    ids = pa.array(range(n), pa.int64())
    markup.extract_anchors(pages)
    batch = pa.RecordBatch.from_arrays([ids, pa.array(['<a href="/x">x</a>'] * n)], names=["page_id", "html"])
    assert [b.num_rows for b in taken["run"]([batch])] == [blocks.PART, blocks.PART, 1]
    with pytest.raises(Exception):
        chunking.chunk_documents(pages, ["page_id"], "html")  # its columns are not there, its reader is
    batch = pa.RecordBatch.from_arrays([ids, pa.array(["a short text"] * n)], names=["page_id", "__text"])
    assert [b.num_rows for b in taken["run"]([batch])] == [blocks.PART, blocks.PART, 1]


def test_edges_without_an_id_are_not_one_key(spark):
    from dossier.operators import graph

    edges = spark.range(64).select(F.concat(F.lit("o"), "id").alias("source_id"), *[F.lit(None).cast("string").alias(c) for c in ("chunk_id", "document_id", "resource_id")])
    keyed = graph.provenance_key(edges)
    assert keyed.where("__level IS NULL").select("__id").distinct().count() == 64


def test_a_shared_passage_shares_a_print():
    from dossier.functions.fingerprints import LEVELS, fingerprints, level_of

    rng = np.random.default_rng(11)
    for alphabet in ("ab", "abcdefghij é😀"):
        text = "".join(rng.choice(list(alphabet), 600))
        for _ in range(200):
            n = int(rng.integers(1, 200))
            at = int(rng.integers(0, len(text) - n))
            level = level_of(n)
            prints, places = fingerprints(text[at : at + n], level)
            whole = set(zip(*(x.tolist() for x in fingerprints(text, level))))
            # Every print of the passage is a print of the text, at the same place.
            assert len(prints) and {(p, at + x) for p, x in zip(prints.tolist(), places.tolist())} <= whole
    assert len(fingerprints("a" * 5000, 63)[0]) <= 5000 and all(sum(v) - 1 == k for k, v in LEVELS.items())


def test_passages_against_the_rule(spark):
    from dossier.operators.passages import passage_matches

    rng = np.random.default_rng(12)
    common = "this line stands in most of the texts of this corpus, word for word, and says nothing at all. "
    texts = [(i, (common if i % 3 else "") + "".join(rng.choice(list("abc "), rng.integers(0, 300)))) for i in range(60)]
    texts += [(60, None), (61, ""), (62, "ab" * 200), (63, "ñandú 😀 überall " * 9)]
    passages = [(0, common), (1, ""), (2, None), (3, "ab" * 40), (4, "b"), (5, "ab" * 10), (6, "😀 über"), (7, "nowhere to be found")]
    for n in (3, 14, 15, 16, 62, 63, 90):
        for _ in range(4):
            i = int(rng.integers(0, 60))
            text = texts[i][1]
            at = int(rng.integers(0, max(1, len(text) - n)))
            passages.append((len(passages), text[at : at + n]))
    passages.append((len(passages), common + texts[1][1][len(common) : len(common) + 30]))
    qs = spark.createDataFrame(passages, "query_id long, query string")
    ds = spark.createDataFrame(texts, "chunk_id long, text string")
    got = {tuple(r) for r in passage_matches(qs, ds).collect()}
    assert got == {(q, c) for q, p in passages for c, t in texts if p and p in (t or "")}
    assert passage_matches(qs.limit(0), ds).count() == 0 and passage_matches(qs, ds.limit(0)).count() == 0


def test_catalogs_meet_each_brand_once(spark, rows, tmp_path):
    from dossier.plans import load_all

    parts = [(i, "n", ["a", "b", "c", None][i % 4], "t", 50 if i % 4 == 0 else 1, 1.0) for i in range(400)]
    schema = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    spark.createDataFrame(parts, schema).write.parquet(f"{tmp_path}/part.parquet")
    out = load_all()["catalogs_without_rules"].run(spark, str(tmp_path))
    assert rows(out) == [("b", "no_rules"), ("c", "no_rules"), (None, "no_rules")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == plan.count("Join LeftAnti") == 1


def test_a_small_file_is_dealt_over_the_cores(spark):
    asked = spark.conf.get("dossier.spread.partitions")
    spark.conf.unset("dossier.spread.partitions")
    try:
        dealt = blocks.leveled(spark.range(0, 1000, 1, 1), "id")
        assert dealt.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism and dealt.distinct().count() == 1000
    finally:
        spark.conf.set("dossier.spread.partitions", asked)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_gather_terms_before_the_shuffle_and_merge_repeated_rows(spark):
    texts = [
        ("a", 1, "the Cat the dog"),
        ("a", 1, "the -- end the"),
        ("b", 1, "the"),
        ("a", None, "x x"),
        ("a", None, "y x"),
        (None, 2, "é É z_1"),
        ("a", 3, None),
        ("a", 4, ""),
        ("a", 5, " ".join(f"w{i % 700}" for i in range(5000))),
    ]
    chunks = spark.createDataFrame(texts, "k string, chunk_id long, text string")
    wanted = {}
    for k, chunk, text in texts:
        for pos, term in enumerate(re.findall(r"[\w-]+", (text or "").lower()), start=1):
            wanted.setdefault((k, term, chunk), []).append(pos)
    found = lexical.build_postings(chunks, ["k"])
    assert found.columns == ["k", "term", "chunk_id", "positions"]
    got = found.collect()
    assert len(got) == len(wanted) and all(sorted(wanted[r.k, r.term, r.chunk_id]) == r.positions for r in got)
    # A row per word never reaches an exchange or an aggregation.
    assert "Generate" not in _plan(lexical.build_postings(chunks))


def test_ocr_words_are_dealt_before_they_are_gathered(spark):
    words = [(1, 1, n, f" w{n}\u00a0", n % 100) for n in (3, 1, 2)] + [(1, 2, 1, "\t", 50), (1, 2, 2, "low", -1), (None, 1, 1, "x", 7)]
    words += [(1, 1, 4, "in\u2003side\n", 9), (2, 1, 1, None, 5), (2, 1, 2, "kept", None), (2, None, 2, "b", 1), (2, None, 1, "a", 2)]
    out = page_text.ocr_page_rollup(spark.createDataFrame(words, "doc_id long, page int, word_no int, word string, conf int"))
    plan = _plan(out)
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan[plan.index("Exchange") :]
    got = {(r.doc_id, r.page): (r.text, r.confidence, r.words) for r in out.collect()}
    assert got == {(1, 1): ("w1 w2 w3 in\u2003side", 3.75, 4), (None, 1): ("x", 7.0, 1), (2, None): ("a b", 1.5, 2)}


def test_long_messages_of_one_file_are_dealt(spark, tmp_path):
    from dossier.plans import web

    events = [(1, 4, "error"), (2, 6, "error"), (2, 6, "error"), (3, 1, "view"), (4, None, "error"), (None, 0, "error")]
    columns = "event_id, cast(null as timestamp_ntz) ts, user_id, event_type, 0d value, '' props"
    rows = spark.createDataFrame(events, "event_id long, user_id long, event_type string")
    rows.selectExpr(*columns.split(", ")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    out = web.crawl_failures(spark, str(tmp_path))
    assert out.rdd.getNumPartitions() == 4
    told = lambda u: "cannot read <url> after " + str(u) + " and again" * u
    wanted = [(1, "OSError", told(4)), (2, "TimeoutError", told(6)), (2, "TimeoutError", told(6)), (4, "OSError", None), (None, "TimeoutError", told(0))]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(wanted, key=repr)
