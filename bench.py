"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Each query
runs once to warm up and BENCH_RUNS (default 3) times for the median.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "f4_service_identity", "f6_station_lag", "f6_station_lag_volume", "f7_train_lag", "f9_neighbour_signal",
    "f10_fault_context", "f11_inflight", "f11_inflight_volume", "b6_it_adjacency", "j1_stop_grain", "p15_explode_stops",
    "i2_monthly_median", "t4_standard_scaler", "e1_pr_auc", "e6_full_metrics", "a3_describe", "a6_delay_by_supplier_volume",
    "a25_keywords", "g5_bridge", "g2_betweenness", "x3_importance_by_group", "f12_feature_assembly",
]


def main() -> None:
    from stopflow.plans.registry import queries
    from stopflow.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "stopflow-bench")
    plans = queries()
    wanted = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for name in wanted:
        taken = []
        for i in range(runs + 1):
            started = time.perf_counter()
            plans[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                taken.append(time.perf_counter() - started)
        times[name] = round(statistics.median(taken), 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
