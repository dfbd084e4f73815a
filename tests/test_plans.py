"""Plan shape: date predicates reach the scans, one scan of the facts for both
periods, no Python UDF, no cartesian product."""

import pytest

from shoplens.plans.daily import daily_report
from shoplens.plans.params import Period
from shoplens.plans.period import period_report
from shoplens.sources.tables import ReportTables, write_tables

P1 = Period.of("2024-01-01", "2024-01-07")
P2 = Period.of("2024-01-08", "2024-01-14")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _formatted(df):
    """The formatted plan without its subquery section."""
    import contextlib
    import io

    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue().split("===== Subqueries =====")[0]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The fixture views written as date-partitioned tables (the production layout)."""
    root = str(tmp_path_factory.mktemp("stored"))
    write_tables(ReportTables.from_driver_tables(spark, "/root/testdata/sf0.01"), root)
    return ReportTables.from_parquet(spark, root)


def test_period_prunes_partitions_and_scans_facts_once(spark, stored):
    from shoplens.operators.facts import joined_facts, period_rollup

    roll = period_rollup(joined_facts(stored, [P1, P2]), P1, P2)
    text = _formatted(roll)
    nodes = text.split("\n(")
    for name in ("store_daily", "promotion_daily", "store_stats"):
        scans = [n for n in nodes if n.split("\n")[0].endswith("Scan parquet ") and f"/{name}]" in n]
        assert len(scans) == 1, name                     # one scan per table for both periods
        part = next(x for x in scans[0].splitlines() if x.startswith("PartitionFilters"))
        assert "2024-01-01" in part and "2024-01-14" in part, part
    # the wide aggregate over the facts is a hash aggregate, not a sort-based one
    assert "HashAggregate" in text
    plan = _plan(roll)
    assert "PythonUDF" not in plan and "Cartesian" not in plan and "BatchEvalPython" not in plan


def test_reports_have_no_python_or_cartesian(spark, stored):
    rep = period_report(stored, P1, P2)
    daily = daily_report(stored, "2024-01-10")
    for df in (rep.wide, rep.rows8, rep.detail31, daily.summary, daily.detail):
        plan = _plan(df)
        assert "PythonUDF" not in plan and "Cartesian" not in plan and "BatchEvalPython" not in plan
        assert "ArrowEvalPython" not in plan


def test_daily_reads_one_date_plus_lookback(spark, stored):
    daily = daily_report(stored, "2024-01-10")
    plan = _plan(daily.base)
    assert "PythonUDF" not in plan
    # the same results from stored tables and from the views
    views = daily_report(ReportTables.from_driver_tables(spark, "/root/testdata/sf0.01"), "2024-01-10")
    a, b = daily.summary, views.summary
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_one_shop_filter_is_pushed_to_every_fact_scan(spark, stored):
    from shoplens.operators.dims import shop_filter
    from shoplens.operators.facts import joined_facts

    j = joined_facts(stored, [P1, P2], shops=shop_filter(stored, shop_id="17"))
    text = _formatted(j)
    for name in ("store_daily", "promotion_daily", "store_stats"):
        node = next(n for n in text.split("\n(") if n.split("\n")[0].endswith("Scan parquet ") and f"/{name}]" in n)
        pushed = next(x for x in node.splitlines() if x.startswith("PushedFilters"))
        assert "EqualTo" in pushed and "17" in pushed, (name, pushed)


def test_colocated_facts_join_and_roll_up_without_shuffle(spark, tmp_path_factory):
    from shoplens.operators.facts import joined_facts, period_rollup
    from shoplens.sources.tables import colocated_plans, save_colocated

    root = str(tmp_path_factory.mktemp("colocated"))
    save_colocated(ReportTables.from_driver_tables(spark, "/root/testdata/sf0.01"), "shoplens_test_db", root, 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")        # force sort-merge joins
    with pytest.raises(ValueError):
        ReportTables.from_catalog(spark, "shoplens_test_db", colocated=True)
    try:
      with colocated_plans(spark):
          t = ReportTables.from_catalog(spark, "shoplens_test_db", colocated=True)
          roll = period_rollup(joined_facts(t, [P1, P2]), P1, P2)
          text = _formatted(roll)
          assert "SortMergeJoin" in text and "Exchange" not in text, text.split("\n\n")[0]
          views = period_rollup(joined_facts(ReportTables.from_driver_tables(spark, "/root/testdata/sf0.01"),
                                             [P1, P2]), P1, P2)
          assert roll.exceptAll(views).count() == 0 and views.exceptAll(roll).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition", "true") == "true"


def test_account_filter_reaches_every_fact_input(spark, stored):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        from shoplens.operators.dims import shop_filter
        from shoplens.operators.facts import joined_facts

        j = joined_facts(stored, [P1, P2], shops=shop_filter(stored, accounts=["acct_1"]))
        assert _formatted(j).count("LeftSemi") >= 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_building_reports_runs_no_job(spark, stored):
    sc = spark.sparkContext
    sc.setJobGroup("build-only", "build-only")
    daily, period = daily_report(stored, "2024-01-10", accounts=["acct_1"]), period_report(stored, P1, P2)
    for df in (daily.rows, daily.checks, daily.ranks, period.rows, period.shop_count):
        df.schema
    assert len(sc.statusTracker().getJobIdsForGroup("build-only")) == 0
    sc.setJobGroup("tests", "tests")


_READS = """
import sys
from shoplens.session import build_session
from shoplens.sources.tables import ReportTables
from shoplens.plans.daily import daily_report
from shoplens.plans.params import Period
from shoplens.plans.period import period_report
root = sys.argv[1]
spark = build_session("local[2]", shuffle_partitions=2)
t = ReportTables.from_parquet(spark, root)
weekly = period_report(t, Period.of("2024-01-01", "2024-01-07"), Period.of("2024-01-08", "2024-01-14"))
for df in (weekly.wide, weekly.detail31, weekly.rows8):
    df.write.format("noop").mode("overwrite").save()
daily = daily_report(t, "2024-01-10")
for df in (daily.summary, daily.detail):
    df.write.format("noop").mode("overwrite").save()
spark.stop()
"""


def _scan_rows(log_dir):
    """Rows that the scans of each stored table put out, over a whole application, from its event log."""
    import glob
    import json
    from collections import defaultdict

    accumulators, values = {}, defaultdict(int)

    def walk(node):
        if node["nodeName"].startswith("Scan parquet"):
            place = node.get("metadata", {}).get("Location", "")
            name = next((t for t in ("store_daily", "promotion_daily", "store_stats") if f"/{t}]" in place), None)
            for m in node["metrics"]:
                if name and m["name"] == "number of output rows":
                    accumulators[m["accumulatorId"]] = name
        for child in node["children"]:
            walk(child)

    for path in glob.glob(f"{log_dir}/**/*", recursive=True):
        try:
            lines = open(path).read().splitlines()
        except (IsADirectoryError, UnicodeDecodeError):
            continue
        for line in lines:
            e = json.loads(line) if line.startswith("{") else {}
            if "sparkPlanInfo" in e:
                walk(e["sparkPlanInfo"])
            for a in e.get("Task Info", {}).get("Accumulables", []) if e.get("Event") == "SparkListenerTaskEnd" else []:
                if str(a.get("Update", "")).lstrip("-").isdigit():
                    values[a["ID"]] += int(a["Update"])
    out = defaultdict(int)
    for i, name in accumulators.items():
        out[name] += values[i]
    return dict(out)


def test_numbered_outputs_read_each_fact_row_once(spark, stored, tmp_path):
    import os
    import subprocess
    import sys

    log = tmp_path / "events"
    log.mkdir()
    root = os.path.dirname(stored.store_daily.inputFiles()[0].split("/store_daily/")[0].removeprefix("file://") + "/x")
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    conf = f"--conf spark.eventLog.enabled=true --conf spark.eventLog.dir=file://{log} --conf spark.eventLog.compress=false pyspark-shell"
    subprocess.run([sys.executable, "-c", _READS, root], check=True, cwd=repo, timeout=300, env=os.environ | {"PYTHONPATH": repo, "PYSPARK_SUBMIT_ARGS": conf}, capture_output=True)
    got = _scan_rows(str(log))
    rows = lambda df, c, a, b: df.where(f"{c} between '{a}' and '{b}'").count()
    # The weekly report: 14 days once. The daily report: its day once, and the days of the 7-day total.
    want = {"store_daily": rows(stored.store_daily, "report_date", "2024-01-01", "2024-01-14") + rows(stored.store_daily, "report_date", "2024-01-10", "2024-01-10")
            + rows(stored.store_daily, "report_date", "2024-01-04", "2024-01-10"),
            "promotion_daily": rows(stored.promotion_daily, "report_date", "2024-01-01", "2024-01-14") + rows(stored.promotion_daily, "report_date", "2024-01-10", "2024-01-10"),
            "store_stats": rows(stored.store_stats, "date", "2024-01-01", "2024-01-14") + rows(stored.store_stats, "date", "2024-01-10", "2024-01-10")}
    assert got == want


def test_trailing_sums_over_a_range_do_not_multiply_rows(spark, stored):
    from shoplens.operators.facts import trailing_sum

    text = _plan(trailing_sum(stored.store_daily, "coupon_pay_order_count", P2))
    assert "Generate" not in text and "Window" in text
