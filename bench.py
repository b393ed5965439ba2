"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [--all] [name ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from dossier.plans import load_all  # noqa: E402
from dossier.session import local_session  # noqa: E402

HEADLINE = [
    "ingest_chunks",
    "chunk_documents",
    "html_to_text",
    "hashing_embed",
    "cosine_topk",
    "knn_join",
    "lexical_count_search",
    "lexical_count_batch",
    "build_postings",
    "lexical_rank_search",
    "hybrid_search",
    "suite_summary",
    "stage_latency",
    "build_relations",
    "k_hop",
    "page_links",
    "link_relevance",
    "resolve_fields",
    "learn_profiles",
    "decay_profiles",
    "refresh_state",
    "collection_stats",
    "memory_conflicts",
    "dedupe_usage",
    "usage_summary",
    "invoice_totals",
    "usage_snapshot_hash",
    "stream_usage_windows",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    entries = load_all()
    args = sys.argv[1:]
    names = list(entries) if "--all" in args else [a for a in args if not a.startswith("-")] or HEADLINE
    spark = local_session(cpus, "dossier-bench")
    # Start the JVM paths and the Python workers before the clock runs.
    entries["normalize_text"].run(spark, folder).write.format("noop").mode("overwrite").save()
    entries["chunk_pages_small_windows"].run(spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        entries[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        if "--all" in args:
            print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
