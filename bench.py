"""Benchmark the headline queries.

Runs each query of ``HEADLINE`` on the tables in ``$BENCH_SF_DIR``
(default /root/testdata/sf0.1) with ``local[$BENCH_CPUS]`` and prints ONE
JSON line: {"metric", "value" (sum of per-query seconds), "unit", "queries",
"consolidation_sec" (the store's one-time build, not in the sum), "sf"}.  A query is executed in full through the ``noop`` sink (no collect);
its time is the median of ``$BENCH_REPS`` runs (default 3) after one
warm-up run.  ``$BENCH_EVENT_LOG`` (a folder) turns on Spark's event log
for reading stage and task times afterwards.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "sales_unified", "customers", "products", "sales_enriched",
    "regional_sales", "rep_performance", "product_performance", "top_customers",
    "customer_orders", "latest_orders_per_customer",
    "daily_sales", "sales_trends", "customer_analysis", "segment_analysis",
    "product_summary", "region_summary", "rep_summary",
    "docs_all", "doc_facets", "upsert_customers", "replace_window_sales",
    "rows_by_region", "insight_rows", "failure_alerts_15m", "hourly_events",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    only = [a for a in sys.argv[1:]]
    from tidewater.session import get_session
    from tidewater.plans.catalog import QUERIES
    extra = {}
    if os.environ.get("BENCH_EVENT_LOG"):       # stage/task times for offline reading
        extra = {"spark.eventLog.enabled": "true", "spark.eventLog.dir": os.environ["BENCH_EVENT_LOG"]}
    extra["spark.driver.memory"] = os.environ.get("SPARK_DRIVER_MEMORY", "16g")
    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2, extra=extra)
    from tidewater.plans import store
    from tidewater.plans.catalog import AS_OF
    t0 = time.perf_counter()
    store.materialize(spark, sf_dir, AS_OF)       # the one-time consolidation that the store queries read
    build = round(time.perf_counter() - t0, 3)
    print(f"# consolidation: {build}s", file=sys.stderr, flush=True)
    names = only or HEADLINE
    times = {}
    for name in names:
        fn = QUERIES[name]
        runs = []
        for i in range(reps + 1):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            if i > 0:
                runs.append(dt)
        times[name] = round(statistics.median(runs), 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "consolidation_sec": build,
        "sf": float(m.group(1)) if m else sf_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
