"""Time every catalogue query; print one JSON line.

Each query is run to completion through the ``noop`` sink (every row is
produced, nothing is collected to the driver).  The value per query is the
median of ``BENCH_REPEAT`` runs after one warm-up run of the whole set.

    BENCH_SF_DIR   default /root/testdata/sf0.1
    BENCH_CPUS     default 8
    BENCH_REPEAT   default 3
    BENCH_ONLY     optional comma-separated query names
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from runledger.plans import catalog  # noqa: E402
from runledger.session import local_session  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    only = [q for q in os.environ.get("BENCH_ONLY", "").split(",") if q]
    spark = local_session(cpus, "runledger-bench")

    names = [n for n in catalog.Q if not only or n in only]
    errors = {}
    for n in names:  # warm-up: JVM, code generation, file listing caches
        try:
            run(catalog.Q[n](spark, sf_dir))
        except Exception as e:  # noqa: BLE001 - report, keep timing the rest
            errors[n] = f"{type(e).__name__}: {str(e)[:200]}"

    times = {}
    for n in names:
        if n in errors:
            continue
        samples = []
        for _ in range(repeat):
            t0 = time.perf_counter()
            run(catalog.Q[n](spark, sf_dir))
            samples.append(time.perf_counter() - t0)
        times[n] = round(statistics.median(samples), 4)

    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({
        "metric": "sum_of_median_query_seconds",
        "value": round(sum(times.values()), 4),
        "unit": "sec",
        "queries": times,
        "sf": sf,
        "cpus": cpus,
        "repeat": repeat,
        **({"errors": errors} if errors else {}),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
