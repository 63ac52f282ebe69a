"""Time headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8).
"""

from __future__ import annotations

import json
import os
import time

from quotegrid.operators import sampling as sm
from quotegrid.plans import QUERIES
from quotegrid.session import local_session
from quotegrid.sources.bindings import messages

HEADLINE = ["flagship_daily_spread", "g03_grid_snapshots", "g05_sampling_stats", "c03_session_assignment", "c14_asof_forward", "f08_library_valid",
            "l01_labels", "l06_training_samples", "m02_gram", "m08_predict_library", "k08_day_summary", "r01_fill_markout", "r10_period_feedback",
            "p03_pooled_expectation", "v11_dataset_diff"]


def fine_grid(spark, sf_dir):
    """Sampling at a five-second interval, whose output grows with the data."""
    return sm.grid_snapshots(messages(spark, sf_dir), 5_000_000_000, 20_000_000_000)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    timings = {}
    for name, run in {**{n: QUERIES[n] for n in HEADLINE}, "g03_grid_5s": fine_grid}.items():
        start = time.perf_counter()
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    total = round(sum(timings.values()), 3)
    print(json.dumps({"metric": "headline_query_seconds", "value": total, "unit": "sec", "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
