"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [key ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

from auditlake.plans import load_queries
from auditlake.session import local_session

HEADLINE = (
    "a44_rule_hits c6_rule_scan_code a17_dedup_merge a19_vote_merge a18_vote_majority w2_best_vote "
    "a2_vote_metrics a7_verifier_breakdown a12_scan_report a16_leaderboard j20_scan_overlap a23_log_stats "
    "a28_tuning_sets a29_confusion a35_sensitive j1_range_chunk j2_chain j11_category w3_balanced "
    "w11_streak o3_remediation_order t1_draft_extraction t5_vote_extraction c1_line_chunks c8_calls "
    "c14_call_graph f16_malicious x3_recent_activity"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=max(int(cpus), 1) if cpus.isdigit() else 8)
    # The test tables are single files with one row group: the scan of a costly table is spread here.
    spark.conf.set("auditlake.scan.partitions", str(spark.sparkContext.defaultParallelism))
    queries = load_queries()
    # Start the JVM's code paths once, so that the first query does not pay for them.
    queries["a1_draft_metrics"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for key in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        queries[key].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[key] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("/", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
