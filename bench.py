"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "dedupe_first_scanned", "dedupe_newest", "dedupe_oldest", "dedupe_shortest_path", "dedupe_largest",
    "breakdown", "folder_rollup", "match_folders_nested", "detect_projects_outermost", "project_groups",
    "build_plan_mirrored_first_scanned", "flat_names",
]


def main() -> None:
    from registered import QUERIES
    from stowage.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, "bench")

    def once(name: str) -> float:
        start = time.perf_counter()
        # The noop sink computes every row and column and keeps none.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    # The first query pays for starting the JVM's code; run it once unmeasured.
    once(names[0])
    times = {name: round(statistics.median(once(name) for _ in range(runs)), 3) for name in names}
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cores": cores, "runs": runs,
    }))


if __name__ == "__main__":
    main()
