"""Benchmark: every registered query, plus the whole report suite from one cube.

Runs on ``local[$BENCH_CPUS]`` over ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) and prints
one JSON line. Each query is executed to completion with the ``noop`` sink (no driver-side
collection), after one warm-up pass; the time is the best of ``$BENCH_REPEAT`` runs, each
started with an empty cache. ``report_suite_all`` is every report of both profiles in one go,
sharing one stored cube per profile (the intended way to produce the reports).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wagelens import Inputs, ReportSuite, STAR_V2020, STAR_V2022  # noqa: E402
from wagelens.plans import catalog  # noqa: E402
from wagelens.plans.reports import run_reports  # noqa: E402
from wagelens.session import local_session  # noqa: E402
from wagelens.sources import star  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(spark, fn, repeat: int) -> float:
    best = float("inf")
    for _ in range(repeat):
        # Cold for the data: nothing cached by an earlier query or run is reused.
        spark.catalog.clearCache()
        t = time.perf_counter()
        fn()
        best = min(best, time.perf_counter() - t)
    return best


def suite_all(spark, sf_dir: str) -> None:
    """All reports of both profiles; the cube of each profile is built once and reused."""
    for profile in (STAR_V2020, STAR_V2022):
        inputs = Inputs(
            star.payroll(spark, sf_dir, profile.years),
            star.names(spark, sf_dir),
            star.cpi(spark, sf_dir),
        )
        suite = ReportSuite(inputs, profile, keep_cube=True).prepare()
        run_reports(suite.report_builders(), lambda _, df: run(df))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="wagelens-bench")

    # Warm-up: JIT and file-system caches.
    run(catalog.q_gender_gap_agency(spark, sf_dir))

    times: dict[str, float] = {}
    for name, q in catalog.QUERIES.items():
        times[name] = round(timed(spark, lambda q=q: run(q(spark, sf_dir)), repeat), 3)
    times["report_suite_all"] = round(timed(spark, lambda: suite_all(spark, sf_dir), repeat), 3)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(m.group(1)) if m else sf_dir,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
