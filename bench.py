"""Benchmark: the headline report queries on $BENCH_SF_DIR; prints one JSON line.

As in production, the report inputs are materialized once as date-partitioned
parquet (timed as ``prepare_inputs``: the fixture views over the whole driver
tables), and every report then reads those stored tables with partition
pruning. Each report is fully executed into Spark's no-op sink (no driver
collect). A warm-up report runs first so JVM start and first code generation are
not charged to a query. The total includes ``prepare_inputs``.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shoplens import queries as Q  # noqa: E402
from shoplens.session import build_session  # noqa: E402
from shoplens.sources.tables import ReportTables, write_tables  # noqa: E402

HEADLINE = ["weekly_wide", "weekly_rows8", "monthly_rows8", "period_detail31", "custom_overlap",
            "weekly_by_account", "daily_summary", "daily_detail", "daily_checks", "daily_range",
            "shop_dim", "region_dim"]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", app="shoplens-bench")
    fns = Q.table_queries()
    root = tempfile.mkdtemp(prefix="shoplens-bench-", dir=os.environ.get("SHOPLENS_BENCH_DIR"))
    times = {}
    spark.range(1000).selectExpr("sum(id)").collect()   # JVM warm-up
    t0 = time.time()
    write_tables(Q.tables(spark, sf_dir), root)
    times["prepare_inputs"] = round(time.time() - t0, 3)
    stored = ReportTables.from_parquet(spark, root)
    run(fns["weekly_wide"](stored))                 # warm-up
    sc = spark.sparkContext
    tracker = sc.statusTracker()
    jobs, rows = {}, {}
    for name in names:
        sc.setJobGroup(f"bench-{name}", name)
        t0 = time.time()
        df = fns[name](stored)
        run(df)
        times[name] = round(time.time() - t0, 3)
        jobs[name] = len(tracker.getJobIdsForGroup(f"bench-{name}"))
        sc.setJobGroup("bench-count", "count")
        rows[name] = df.count()                       # not timed
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    # 3 + 2n for n shops, period 3): Spark jobs per report here, independent of n.
    print(json.dumps({"metric": "report_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "spark_jobs": jobs, "rows": rows}))


if __name__ == "__main__":
    main()
