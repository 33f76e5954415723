"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 2,
the fastest run counts).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "profile_lineitem",
    "profile_part",
    "profile_sample_values",
    "row_index_by_key",
    "fact_extreme_rows",
    "fact_emission",
    "question_attribute",
    "question_filtered_find",
    "question_comparison",
    "question_reply_extraction",
    "ground_facts",
    "ground_items",
    "dedup_exact",
    "dedup_near_pairs",
    "dedup_resolution",
    "validate_coverage",
    "diagnose_summary",
    "eval_sidecar_attach",
    "eval_overlap_scores",
    "eval_batch_answers",
    "assert_row_results",
    "assert_whole_word",
    "score_summary",
    "score_histogram",
    "score_category_rollup",
    "chunk_words",
    "chunk_sections",
    "source_page_content",
    "source_payload_records",
    "stream_scores",
    "workflow_category_report",
]


def main() -> None:
    from evalspark.plans import load_queries
    from evalspark.session import build_session

    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    memory = os.environ.get("BENCH_MEMORY", "12g")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": memory, "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load_queries()
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in names:
        best = None
        for _ in range(runs):
            spark.catalog.clearCache()
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - start
            best = spent if best is None else min(best, spent)
        seconds[name] = round(best, 3)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
                "cpus": int(cpus),
                "driver_memory": memory,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
