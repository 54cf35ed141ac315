"""Timed headline queries. Prints one JSON line; every query is materialised in full without a collect."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "scan_projects", "project_gate", "rule_table_without_row_security", "admitted_files", "severity_counts",
    "baseline_latest", "baseline_history", "findings_new", "persisted_posture_totals", "area_posture",
    "report_bodies", "annotations", "request_texts", "cache_lookup", "merged_responses", "scan_requests",
    "superseded_jobs", "job_state", "rate_limit", "subscription_state", "submitted_findings", "authenticated_calls",
    "stream_rate_limit",
]


def main() -> None:
    from plumbline import plans
    from plumbline.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    plans.load_all()
    chosen = sys.argv[1:] or HEADLINE
    seconds: dict[str, float] = {}
    for name in chosen:
        best = None
        # One warm-up run, then the measured ones.
        for n in range(runs + 1):
            start = time.perf_counter()
            plans.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            if n:
                best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    line = {
        "metric": "headline queries, total seconds after one warm-up", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
