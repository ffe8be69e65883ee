"""Benchmark: landing the canonical tables, then the headline queries on them.

Prints one JSON line. ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from mergelens.plans import star
from mergelens.plans.queries import QUERIES, dump_tables
from mergelens.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINE = (
    "pr_throughput",
    "cycle_time",
    "pr_merge_effectiveness",
    "review_iterations",
    "review_leverage",
    "time_to_first_review",
    "slow_review_response",
    "metric_results",
    "percentile_hours",
    "pr_interactions",
    "next_author_commit",
    "acted_prs",
)


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def main() -> None:
    spark = local_session(CPUS, int(CPUS) if CPUS.isdigit() else 8, "mergelens-bench")

    def query(name: str) -> None:
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()

    times = {"land_canonical": timed(lambda: star.canonical_tables(spark, SF_DIR))}
    for name in HEADLINE:
        query(name)  # warm up: code generation and file caches
        times[name] = statistics.median(timed(lambda: query(name)) for _ in range(RUNS))
    times = {name: round(seconds, 3) for name, seconds in times.items()}
    load = timed(lambda: dump_tables(spark, SF_DIR))  # writes a dump of JSON lines and loads it
    print(
        json.dumps(
            {
                "metric": "total of landing and headline queries, warm median",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "json_dump_written_and_loaded": round(load, 3),
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": CPUS,
                "runs": RUNS,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
