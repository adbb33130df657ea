"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print ONE JSON line with per-query seconds.

Each query is forced with the ``noop`` sink (full computation, nothing
runs once on the smallest tables (JIT and whole-stage codegen warm-up), then
each is timed at the target scale; with $BENCH_REPEATS > 1 the median is
reported.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tsfold.plans.catalog import queries  # noqa: E402
from tsfold.session import local_session  # noqa: E402

HEADLINE = [
    "merge_concat", "statements", "imports", "exports", "resolve_imports", "export_conflicts",
    "ref_edges", "merge_full", "has_cycle", "topo_order", "closure", "preorder",
    "normalize_events", "scan_throttle", "active_paths", "event_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = local_session(cpus, shuffle_partitions=max(8, 2 * int(cpus)))
    repeats = max(1, int(os.environ.get("BENCH_REPEATS", "1")))
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    qs = queries()
    names = only or HEADLINE
    if os.path.isdir(warm_dir):
        for name in names:
            qs[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        runs = []
        for _ in range(repeats):
            t0 = time.time()
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - t0)
        times[name] = round(statistics.median(runs), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
