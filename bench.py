"""Benchmark: every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line. ``setup`` is the one-time landing of the raw and clean
layers plus the cached order/item models (shared by all reports, SURVEY X3);
each query is then timed to full execution through the ``noop`` sink, so
nothing is collected to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from marketlens.plans.catalog import marketplace  # noqa: E402
from marketlens.plans.registry import ALL_QUERIES  # noqa: E402
from marketlens.session import local_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores=cpus, shuffle_partitions=max(8, cpus * 2))
    names = sys.argv[1:] or list(ALL_QUERIES)

    t0 = time.time()
    m = marketplace(spark, sf_dir)
    m.order_summary.count()
    m.order_item_detail.count()
    setup = time.time() - t0

    times = {}
    for name in names:
        t = time.time()
        ALL_QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    total = round(setup + sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": total,
                "unit": "sec",
                "setup_sec": round(setup, 3),
                "queries": times,
                "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
