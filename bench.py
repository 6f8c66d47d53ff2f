"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores.  Every query runs whole, its
rows go to Spark's no-op sink, and the median of three warm runs is reported.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINE = (
    "template_alpaca", "template_chat", "nested_path", "profile_orders", "profile_records", "profile_top_values",
    "profile_top_texts", "histogram", "unique_counts", "correlation", "dedup_exact", "field_drift", "validate_records",
    "validation_report", "rule_value", "repair_template", "repair_chat", "augment_shuffle", "augment_synonym",
    "augment_synonym_table", "anonymize_detected", "anonymize_types", "split_exact", "generate_qa", "kw_scan",
    "forbidden_scan", "hygiene", "wellformed_json", "search_filter", "patch_cells", "io_jsonl", "io_csv",
)


def main() -> None:
    from millrace.plans.queries import QUERIES
    from millrace.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "millrace-bench")
    spark.sparkContext.setLogLevel("FATAL")
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        runs = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "total median query time", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
