"""Benchmark: the reference's workflow on Spark.

Headline ``value`` = ``fact_build`` + all 27 reports as ``python -m revlens
report all`` runs them (shared grains, 4 reports side by side).  Per-report
times (each report alone) are in ``queries``; their sum is
``single_reports_sum_sec``.

1. ``fact_build``: driver tables -> sales fact (star joins, features) ->
   typed Parquet table partitioned by order year (the clean/export/load step).
2. Every report (B1-B18) and derived table (D1-D7) on the stored fact:
   median wall time of 3 runs, result collected to the driver.
3. ``suite_all_reports_sec``: the same 27 reports through ``plans.suite``
   (each grain aggregated once), median of 3 runs — reported separately;
   ``suite_all_reports_parallel_sec``: the same with 4 reports run side by
   side (concurrent Spark jobs from driver threads).

An untimed warm-up runs the same steps on sf0.001 first, so the numbers are
steady-state (not JVM start-up).

Prints one JSON line.  Env: BENCH_SF_DIR (default /root/testdata/sf0.1),
BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from revlens.plans.registry import DERIVED, REPORTS  # noqa: E402
from revlens.plans.suite import execute_reports, run_reports  # noqa: E402
from revlens.session import ensure_checkpoint_dir, local_session  # noqa: E402
from revlens.sources.sinks import read_sales_table, write_sales_table  # noqa: E402
from revlens.sources.tables import sales_fact  # noqa: E402

RUNS = 3
SUITE_THREADS = 4
WARMUP_DIR = "/root/testdata/sf0.001"


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, shuffle_partitions=cpus, app="revlens-bench")
    shared = ensure_checkpoint_dir(spark)
    fact_path = f"{shared.rstrip('/')}/bench-fact-{uuid.uuid4().hex}"

    reports = {**{k: v.__wrapped__ for k, v in REPORTS.items()},
               **{k: v.__wrapped__ for k, v in DERIVED.items()}}
    # untimed warm-up on the smallest data set (JIT, class loading, file listing)
    warm = f"{fact_path}-warmup"
    write_sales_table(sales_fact(spark, WARMUP_DIR), warm)
    for report in reports.values():
        report(read_sales_table(spark, warm)).collect()

    times: dict[str, float] = {}
    t0 = time.perf_counter()
    write_sales_table(sales_fact(spark, sf_dir), fact_path)
    times["fact_build"] = time.perf_counter() - t0

    sales = read_sales_table(spark, fact_path)
    for name, report in reports.items():
        runs = []
        for _ in range(RUNS):
            t = time.perf_counter()
            report(sales).collect()
            runs.append(time.perf_counter() - t)
        times[name] = statistics.median(runs)

    # the whole catalogue through the shared-grain suite (reported apart from
    # the per-report total above, not added to it)
    suite_runs, parallel_runs = [], []
    for _ in range(RUNS):
        t = time.perf_counter()
        for df in run_reports(sales).values():
            df.collect()
        suite_runs.append(time.perf_counter() - t)
        t = time.perf_counter()
        execute_reports(sales, lambda name, df: df.collect(), parallel=SUITE_THREADS)
        parallel_runs.append(time.perf_counter() - t)
    suite_all = statistics.median(suite_runs)
    suite_parallel = statistics.median(parallel_runs)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    single_sum = sum(v for k, v in times.items() if k != "fact_build")
    print(json.dumps({
        "metric": "fact_build_plus_all_reports_wall_time",
        "value": round(times["fact_build"] + suite_parallel, 3),
        "unit": "sec",
        "queries": {k: round(v, 3) for k, v in times.items()},
        "sf": float(m.group(1)) if m else None,
        "cpus": cpus,
        "runs_per_report": RUNS,
        "suite_all_reports_sec": round(suite_all, 3),
        "suite_all_reports_parallel_sec": round(suite_parallel, 3),
        "suite_threads": SUITE_THREADS,
        "single_reports_sum_sec": round(single_sum, 3),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
