"""Time the headline queries and print one JSON line.

Reads ``BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``) and ``BENCH_CPUS`` (default 8). Each
query runs twice over its whole tables; the better time counts, so that JVM start-up and code
generation are left out. With query names as arguments, only those are run.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "structured_filter",
    "interactive_refilter",
    "group_count",
    "amount_stats",
    "count_with_examples",
    "listing_page",
    "top_by_amount",
    "top_per_group",
    "keep_first",
    "load_metrics",
    "display_cut",
    "clean_doc_text",
    "embedding_text_structured",
    "postings",
    "display_text",
    "repair_description",
    "normalize_records",
    "with_embeddings",
    "coverage",
    "embed_texts",
    "embedding_backfill",
    "upsert",
    "stored_merge",
    "whole_load",
    "lexical_search_one",
    "lexical_search",
    "fulltext_search",
    "fuzzy_search_one",
    "fuzzy_search",
    "vector_search_one",
    "vector_search",
    "vector_neighbours",
    "approx_search",
    "rank_fusion",
    "hybrid_search",
    "hybrid_search_reranked",
    "route_questions",
    "question_plans",
    "answers",
    "answer_texts",
    "stage_events",
]


def main() -> None:
    from sheaf.session import local_session
    from workload import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        best = None
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
        print(f"{name} {best:.2f}s", file=sys.stderr, flush=True)
    sf = Path(sf_dir).name.removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
            }
        )
    )


if __name__ == "__main__":
    main()
