"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) set data and cores.
Each query (but those in ONCE) runs once to warm up and once timed, into a sink that consumes every row and column.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from auditloom.plans import registry  # noqa: E402
from auditloom.session import build_session  # noqa: E402

HEADLINE = [
    "completions_view", "sast_scan", "smell_scan", "split_lines", "rule_scan_join", "findings_rollup",
    "mask_pii", "mask_pii_scope", "quarantine_status", "tool_call_decisions", "trace_retention", "retained_spans",
    "all_findings", "repo_import_edges", "cross_repo_call_edges", "nearest_centroid", "kmeans_update",
    "text_char_embedding", "best_patch", "audit_metrics", "eval_case_scores", "transition_conformance",
    "gate_report", "cluster_report", "remediate", "callgraph_reach", "kmeans_fit", "unmask_pii_scope", "blocked_commands",
    "audit_report", "stream_quarantine", "stream_completions_dedup",
]
# Timed in their first run: a second one would cost more than it shows.
ONCE = {"unmask_pii_scope", "remediate", "callgraph_reach", "kmeans_fit", "stream_quarantine", "stream_completions_dedup"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(2 * int(cpus)),
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
            # each driver table is one small file with one row group, so one split
            "spark.auditloom.inputPartitions": cpus,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.all_queries()
    seconds: dict[str, float] = {}
    for name in names:
        for _ in range(1 if name in ONCE else 2):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}s", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
