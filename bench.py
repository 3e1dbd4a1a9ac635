"""Time headline queries: one JSON line on stdout.

``BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``) names the tables and ``BENCH_CPUS`` the cores. Each query
runs once to warm up, then ``BENCH_RUNS`` times into the ``noop`` sink; its median counts. Time includes
building and planning the query and any table it writes for itself.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from catalog.queries import REGISTRY
from thermogrid.session import local_session, release

HEADLINES = (
    "hourly_mean", "hourly_grid", "interpolate_limited", "source_clean", "combined_dataset", "rolling_features",
    "feature_matrix", "sliding_windows", "column_stats", "split_statistics", "histogram", "hist2d_cells",
    "hist2d_cumulative", "climatology", "evaluate_models", "ridge", "restartable_fit", "policy_replay",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    seconds = {}
    for name in HEADLINES:
        taken = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(taken[1:]), 3)
    release(spark)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
