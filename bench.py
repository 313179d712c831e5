"""Benchmark: headline queries on $BENCH_SF_DIR (default sf0.1) with
local[$BENCH_CPUS].  Each query is run once to warm up, then timed three
times (full evaluation through the no-op sink); the median is reported.
Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from meterwise.plans.catalog import QUERIES  # noqa: E402
from meterwise.plans.extra import ROWS_ONLY  # noqa: E402
from meterwise.session import build_session  # noqa: E402

HEADLINE = [
    "interpolate_linear",      # W4 + chunked ordering
    "features_wide",           # P2: one positional pass over position blocks
    "scaler_apply",            # P3
    "statistical_detect",      # D1 on 1,500 per-user series (sf0.1)
    "seasonal_detect",         # D5
    "ensemble_two_detectors",  # E1
    "email_outbox",            # A3 + A9 text rendering
    "iforest_detect",          # D3 on the raw per-type series
    "detect_alerts",           # A4 flagship: all three detectors + attribution
    "windowed_stats",          # X5
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    reps = int(os.environ.get("BENCH_REPS", "3"))
    spark = build_session(f"local[{cpus}]", max(cpus, 2))
    qs = {**QUERIES, **ROWS_ONLY}
    times = {}
    for name in HEADLINE:
        run = lambda: qs[name](spark, sf).write.format("noop").mode("overwrite").save()
        run()  # warm-up
        samples = []
        for _ in range(reps):
            t0 = time.perf_counter()
            run()
            samples.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(samples), 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": total, "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/")).replace("sf", ""),
                      "cpus": cpus, "reps": reps}))


if __name__ == "__main__":
    main()
