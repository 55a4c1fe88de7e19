"""Benchmark the headline queries.

Runs every headline query of the registry over ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) on ``local[$BENCH_CPUS]`` and prints one JSON line:
{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}

Each query is fully executed (written to the ``noop`` sink, so every row and
column is produced) once to warm up the JVM, then timed twice; the faster
run is reported (plan construction included in each timing).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from threatsift.plans import catalog  # noqa: E402
from threatsift.session import get_spark  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [k for k in os.environ.get("BENCH_QUERIES", "").split(",") if k]
    spark = get_spark(f"local[{cpus}]", app_name="threatsift-bench", shuffle_partitions=int(cpus) * 2,
                      extra={"spark.driver.memory": "16g", "threatsift.scan.minPartitions": cpus})
    catalog.load_all()
    keys = only or list(catalog.HEADLINE)
    timings: dict[str, float] = {}
    rows: dict[str, int] = {}
    for k in keys:
        fn = catalog.QUERIES[k]
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
        best = None
        for _ in range(2):
            t0 = time.perf_counter()
            df = fn(spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        timings[k] = round(best, 3)
        if k == "triage_messages":
            rows[k] = df.count()
    total = round(sum(timings.values()), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "headline_queries_total_sec",
        "value": total,
        "unit": "sec",
        "queries": timings,
        "sf": float(m.group(1)) if m else sf_dir,
    }
    if "triage_messages" in timings and timings["triage_messages"] > 0:
        out["triage_messages_per_sec"] = round(rows["triage_messages"] / timings["triage_messages"], 1)
    print(json.dumps(out))


if __name__ == "__main__":
    main()
