"""Benchmark the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS
(default 8), BENCH_RUNS (default 3), BENCH_QUERIES (comma list, optional).
Each query runs once to warm up, then BENCH_RUNS times; the median is
reported. Results are written to Spark's ``noop`` sink, so the whole plan
executes and nothing is collected to the driver.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "customer_profile",
    "record_profiles",
    "dedup_events",
    "event_counts",
    "latest_attributes",
    "attribute_changes",
    "attribute_changes_event_time",
    "reconcile_observed",
    "merged_attributes",
    "ndjson_records",
    "stream_event_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE

    from eventfold.plans.queries import QUERIES
    from eventfold.session import get_spark

    spark = get_spark(f"local[{cpus}]", app="eventfold-bench", shuffle_partitions=cpus * 2,
                      extra={"spark.driver.memory": "16g"})

    def once(name: str) -> float:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    per_query = {}
    for name in names:
        once(name)
        per_query[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "sum of median warm query time",
        "value": round(sum(per_query.values()), 3),
        "unit": "sec",
        "queries": per_query,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "shuffle_partitions": cpus * 2,
        "runs": runs,
    }))


if __name__ == "__main__":
    main()
