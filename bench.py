"""Time the headline queries; prints one JSON line.

Every query is written to the no-op sink after one warm-up run, so the whole
result is computed and nothing is collected.  The value is the sum of the
medians.  BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS set folder, cores and runs.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from tidemark.plans.catalog import QUERIES
from tidemark.session import build_session

HEADLINE = (
    "features_v1",
    "features_v2",
    "features_v3",
    "features_v4",
    "features_v5_stay",
    "features_v6_nostay",
    "splits_v1_v4",
    "splits_v5_v6",
    "labs_ext_24h",
    "first_min_max_summary",
    "chronic_groups",
    "med_group_flags",
    "proc_group_flags",
    "null_rates",
    "vital_coverage",
    "risk_rank",
    "scenario_table",
    "generic_report",
    "metrics_by_period",
    "numeric_summary_by_group",
    "binary_rates_by_group",
    "impute_median",
    "preprocess_linear",
    "score",
    "model_comparison",
    "error_report",
    "attributions",
    "checked_write",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session("bench", cores, shuffle_partitions=cores)
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    timings = {}
    for name in HEADLINE:
        run(name)
        timings[name] = round(statistics.median(run(name) for _ in range(runs)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline query time",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
