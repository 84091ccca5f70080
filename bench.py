"""Benchmark: the full dashboard (16 reports + derived tables) over both derived facts.

For each relation -- the order/line-item star schema and the JSON-payload
``events`` fact -- the normalised base is built and written once to the
checkpoint folder, then every report and derived table is executed.  Prints one
JSON line: ``value`` is the total wall time in seconds, ``queries`` the time of
each step.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS``
(default 8), ``BENCH_PARALLEL`` (concurrent report jobs per page, default 8).  The two
pages run side by side.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from routeboard.plans.catalog import EVENT_RANGE, PAGE  # noqa: E402
from routeboard.plans.dashboard import Dashboard  # noqa: E402
from routeboard.plans.session import local_session  # noqa: E402
from routeboard.sources.envelope import events_fact  # noqa: E402
from routeboard.sources.order_lines import order_lines_base  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    parallel = int(os.environ.get("BENCH_PARALLEL", "8"))
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")

    # warm the JVM (class loading, codegen caches) on a trivial scan
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()

    queries: dict[str, float] = {}
    t_all = time.perf_counter()

    def orders_page() -> dict[str, float]:
        t0 = time.perf_counter()
        dash = Dashboard.from_base(order_lines_base(spark, sf_dir), PAGE)
        out = {"base_orders": time.perf_counter() - t0}
        out.update(dash.run(parallel=parallel)[1])
        return out

    def events_page() -> dict[str, float]:
        t0 = time.perf_counter()
        dash = Dashboard.from_fact(events_fact(spark, sf_dir), EVENT_RANGE)
        out = {"base_events": time.perf_counter() - t0}
        out.update({f"ev_{k}": v for k, v in dash.run(parallel=parallel)[1].items()})
        return out

    # the two pages are independent Spark pipelines: serve them side by side
    with ThreadPoolExecutor(max_workers=2) as pool:
        for part in [f.result() for f in [pool.submit(orders_page), pool.submit(events_page)]]:
            queries.update(part)

    total = time.perf_counter() - t_all
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "dashboard_total_seconds",
        "value": round(total, 3),
        "unit": "sec",
        "queries": {k: round(v, 3) for k, v in queries.items()},
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "parallel": parallel,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
