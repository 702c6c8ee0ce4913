"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from probegrid.plans.catalog import all_queries
from probegrid.session import build_session

HEADLINE = [
    "cleaning_log_point", "clean_point", "duplicate_log", "daily_availability", "cleaning_log_segment",
    "segment_block_time", "block_30min", "match_block_time", "benchmark_summary", "sensitivity_threshold",
    "sensitivity_lag", "sensitivity_daily", "intraday_profile", "moving_average", "ingest_point_json",
    "ingest_segment_shape", "flow_to_point", "points_in_bbox", "run_completeness", "heartbeat_outages",
]


def run(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    times = {}
    for name in names:
        run(queries[name], spark, sf_dir)
        times[name] = round(statistics.median(run(queries[name], spark, sf_dir) for _ in range(repeats)), 3)
    print(json.dumps({
        "metric": "headline_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
        "repeats": repeats,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
