"""Time the headline queries on the driver tables and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from shiftlab_checks.queries import QUERIES  # noqa: E402
from shiftlab.operators.scale import staging  # noqa: E402
from shiftlab.session import configure  # noqa: E402

HEADLINES = (
    "status_rates",
    "status_rates_by_packing_day",
    "status_rates_by_delivery_time",
    "order_rates",
    "shift_impact_table",
    "control_report",
    "control_report_of_order_rates",
    "first_snapshot",
    "applied_overrides",
    "status_cohorts",
    "daily_cohort_counts",
    "delivery_outcomes",
    "latest_customers",
)
RUNS = 2


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("shiftlab-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
    )
    spark = configure(builder, shuffle_partitions=cpus).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINES:
        runs = []
        for _ in range(RUNS):
            started = time.perf_counter()
            with staging(spark):
                QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
                runs.append(time.perf_counter() - started)
        seconds[name] = round(min(runs), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": f"total seconds over {len(seconds)} queries, best of {RUNS} runs each",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
