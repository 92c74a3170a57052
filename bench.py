"""Times headline queries: one warm-up, then the median of up to three runs each.

Reads ``BENCH_SF_DIR`` and ``BENCH_CPUS`` and prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from workload.registry import QUERIES  # noqa: E402

HEADLINE = (
    "scan_counts sast_code ai_code_code secrets_code prose_findings entropy_code scan_high"
    " manifest_dispatch affected_dependencies affected_salted sca_findings dependency_coverage"
    " upsert title_enrichment title_search scan_summary findings_by_file diagnostics dashboard"
    " history newest_scans explain_questions throttle throttle_one_client debounce throttle_stream"
).split()

BUDGET_SECONDS = 12.0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    times: dict[str, float] = {}
    for name in names:
        run(name)
        runs: list[float] = []
        while len(runs) < 3 and (not runs or sum(runs) < BUDGET_SECONDS):
            runs.append(run(name))
        times[name] = round(statistics.median(runs), 3)
        print(f"{name:28} {times[name]:8.3f}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_wall_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0),
            }
        )
    )


if __name__ == "__main__":
    main()
