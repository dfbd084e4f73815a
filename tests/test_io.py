"""K1-K3 sinks, S6 options, the streaming feed, and the driver entry points."""

import datetime as dt
import os
import re

import pytest

from shoplens.plans.daily import daily_report
from shoplens.plans.runner import run_daily
from shoplens.sources.jdbc import jdbc_options
from shoplens.sources.sinks import run_name
from tests.micro import make_tables, store_row


def test_run_name_format():
    name = run_name("日报_20240110", now=dt.datetime(2024, 1, 10, 8, 9, 10), token="abcdef01")
    assert name == "日报_20240110_20240110080910_abcdef01"
    assert re.fullmatch(r"x_\d{14}_[0-9a-f]{8}", run_name("x"))


def test_run_daily_round_trip(spark, scratch):
    t = make_tables(spark, store=[store_row("1", "2024-01-10", "A"), store_row("2", "2024-01-10", "B")])
    folder = run_daily(t, "2024-01-10", scratch)
    assert os.path.basename(folder).startswith("日报_20240110_")
    summary = spark.read.parquet(f"{folder}/summary")
    detail = spark.read.parquet(f"{folder}/detail")
    assert summary.count() == 2 and detail.count() == 78
    with pytest.raises(ValueError):
        run_daily(t, "2024-01-11", scratch)


def test_jdbc_options():
    o = jdbc_options("jdbc:mysql://db/x", "t", "u", "p", "report_date", "2024-01-01", "2024-01-31", 8)
    assert o["partitionColumn"] == "report_date" and o["numPartitions"] == "8" and o["user"] == "u"
    with pytest.raises(ValueError):
        jdbc_options("jdbc:mysql://db/x", "t", partition_column="report_date")


def test_daily_feed_stream(spark, scratch):
    from shoplens.streaming.daily_feed import daily_feed

    base = make_tables(spark, store=[store_row("1", "2024-01-09", "A", coupon_pay_order_count=3),
                                     store_row("1", "2024-01-12", "A", coupon_pay_order_count=1)])
    incoming = os.path.join(scratch, "incoming")
    new = make_tables(spark, store=[store_row("1", "2024-01-10", "A", coupon_pay_order_count=8),
                                    store_row("2", "2024-01-10", "B")])
    new.store_daily.write.parquet(incoming)
    current = base.replace(store_daily=base.store_daily.unionByName(spark.read.parquet(incoming)))
    q = daily_feed(spark, incoming, lambda: current, os.path.join(scratch, "out"), os.path.join(scratch, "ckpt"))
    q.awaitTermination(120)
    out = spark.read.parquet(os.path.join(scratch, "out", "summary"))
    # the loaded day, and a later day whose 7-day total includes it
    assert sorted((r.shop_id, str(r.report_date)) for r in out.collect()) == [
        ("1", "2024-01-10"), ("1", "2024-01-12"), ("2", "2024-01-10")]
    detail = spark.read.parquet(os.path.join(scratch, "out", "detail"))
    coupons = {str(r.report_date): r.col_b for r in detail.where("shop_id = '1' AND row_no = 27").collect()}
    assert coupons == {"2024-01-10": "11", "2024-01-12": "12"}      # 3+8 and 3+8+1 over 7 days


def test_entry_and_registry(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0 and "shop_id" in df.columns
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 20


def test_write_report_partitioned_by_sheet(spark, scratch):
    from shoplens.sources.sinks import write_report

    t = make_tables(spark, store=[store_row("1", "2024-01-10", "A/x"), store_row("2", "2024-01-10", "A/x")])
    r = daily_report(t, "2024-01-10")
    folder = write_report({"detail": r.detail}, scratch, "run1", partition_by_sheet=True)
    parts = sorted(p for p in os.listdir(f"{folder}/detail") if p.startswith("sheet_name="))
    assert parts == ["sheet_name=Ax", "sheet_name=Ax_2"]
    back = spark.read.parquet(f"{folder}/detail")
    assert back.count() == 78 and back.where("sheet_name = 'Ax_2'").count() == 39


def test_run_all_continues_after_an_empty_report(spark, scratch):
    from shoplens.plans.params import Period
    from shoplens.plans.runner import run_all

    t = make_tables(spark, store=[store_row("1", "2024-01-03", "A"), store_row("1", "2024-01-10", "A")])
    wk = (Period.of("2024-01-01", "2024-01-07"), Period.of("2024-01-08", "2024-01-14"))
    empty = (Period.of("2023-01-01", "2023-01-07"), Period.of("2023-01-08", "2023-01-14"))
    out = run_all(t, scratch, daily_date="2024-01-10", weekly=wk, monthly=empty, custom=wk)
    assert os.path.isdir(out["daily"]) and os.path.isdir(out["weekly"]) and os.path.isdir(out["custom"])
    assert isinstance(out["monthly"], ValueError)
    assert spark.read.parquet(f"{out['weekly']}/summary").count() == 8


def test_command_line(spark, scratch, capsys):
    from shoplens.__main__ import main
    from shoplens.sources.tables import write_tables

    d = dt.date(2024, 1, 10)
    t = make_tables(spark, store=[store_row("1", "2024-01-03", "A"), store_row("1", "2024-01-10", "A")],
                    promo=[("1", d, 1, 1, None, 1, 1)], stats=[("1", d, 5, 5, 1, None, 1, 0)],
                    accounts=[("a1", '[{"shop_id":1}]', None, "s", "c", None)], users=[(1, "Op")])
    inputs = os.path.join(scratch, "in")
    write_tables(t, inputs)
    out = os.path.join(scratch, "out")
    assert main(["daily", "--input", inputs, "--out", out, "--date", "2024-01-10"], spark=spark) == 0
    folder = capsys.readouterr().out.strip()
    assert spark.read.parquet(f"{folder}/detail").count() == 39
    assert main(["custom", "--input", inputs, "--out", out, "--p1", "2024-01-01:2024-01-07",
                 "--p2", "2024-01-08:2024-01-14", "--shop-id", "1"], spark=spark) == 0
    folder = capsys.readouterr().out.strip()
    assert spark.read.parquet(f"{folder}/summary").count() == 8
    assert main(["daily", "--input", inputs, "--out", out, "--date", "2023-01-01"], spark=spark) == 1


def test_empty_stored_tables_read_as_empty(spark, scratch):
    from shoplens.sources.tables import ReportTables, write_tables

    t = make_tables(spark, store=[store_row("1", "2024-01-10", "A")])       # no promotions, stats, accounts
    write_tables(t, os.path.join(scratch, "in"))
    back = ReportTables.from_parquet(spark, os.path.join(scratch, "in"))
    assert back.promotion_daily.count() == 0 and back.store_stats.count() == 0
    assert daily_report(back, "2024-01-10").summary.count() == 1


def test_missing_stored_table_is_an_error(spark, scratch):
    from pyspark.errors import AnalysisException

    from shoplens.sources.tables import ReportTables

    with pytest.raises(AnalysisException):
        ReportTables.from_parquet(spark, os.path.join(scratch, "misspelt"))


def test_written_tables_are_in_report_order(spark, scratch):
    from shoplens.sources.sinks import write_report

    t = make_tables(spark, store=[store_row(str(i), "2024-01-10", f"S{i}") for i in range(60)])
    folder = write_report({"detail": daily_report(t, "2024-01-10").detail}, scratch, "run1", fmt="csv")
    rows = []
    for f in sorted(x for x in os.listdir(f"{folder}/detail") if x.endswith(".csv")):
        rows += [(int(r.seq), int(r.row_no)) for r in spark.read.option("header", True).csv(f"{folder}/detail/{f}").collect()]
    assert rows == sorted(rows) and len(rows) == 60 * 39


def test_run_period_writes_the_rejected_store_days(spark, scratch):
    from shoplens.plans.params import Period
    from shoplens.plans.runner import run_period

    t = make_tables(spark, store=[store_row("1", "2024-01-03", "A"), store_row("2", "2024-01-03", "B", exposure_users=-1), store_row("2", None, "B")])
    folder = run_period(t, Period.of("2024-01-01", "2024-01-07"), Period.of("2024-01-08", "2024-01-14"), scratch, quarantine=True)
    assert [r.shop_id for r in spark.read.parquet(f"{folder}/wide").collect()] == ["1"]
    bad = spark.read.parquet(f"{folder}/rejected").collect()
    assert sorted(r.errors for r in bad) == ["missing report_date", "negative exposure_users"]
    assert {"trend", "defaults", "summary", "detail", "failed"} <= set(os.listdir(folder))


def test_command_line_options(spark, scratch, capsys):
    from shoplens.__main__ import main
    from shoplens.sources.tables import write_tables

    t = make_tables(spark, store=[store_row(s, f"2024-01-{d:02d}", f"N{s}") for s in ("1", "2") for d in (3, 10)],
                    accounts=[("a1", '[{"shop_id":1}]', None, "s", "c", None)], users=[(1, "Op")])
    inputs, out = os.path.join(scratch, "in"), os.path.join(scratch, "out")
    write_tables(t, inputs)
    spans = ["--p1", "2024-01-01:2024-01-07", "--p2", "2024-01-08:2024-01-14"]

    def run(*args):
        code = main([args[0], "--input", inputs, "--out", out, *args[1:]], spark=spark)
        return code, capsys.readouterr().out.strip()

    code, folder = run("weekly", *spans, "--shop-id", "2")
    assert code == 0 and [r.shop_id for r in spark.read.parquet(f"{folder}/wide").collect()] == ["2"]
    assert run("custom", *spans, "--shop-ids", ",")[0] == 1                        # names no shop
    code, folder = run("custom", *spans, "--shop-ids", ",", "--unresolved", "all", "--legacy-names", "--legacy")
    assert code == 0 and "2家门店" in folder and spark.read.parquet(f"{folder}/summary_legacy").count() == 16
    code, folder = run("monthly", *spans, "--per-sheet")
    assert sorted(x for x in os.listdir(f"{folder}/detail") if "=" in x) == ["sheet_name=N1", "sheet_name=N2"]
    code, text = run("all", "--date", "2024-01-10", "--weekly", "2024-01-01:2024-01-07,2024-01-08:2024-01-14")
    assert code == 0 and [x.split("\t")[0] for x in text.splitlines()] == ["daily", "weekly"]
    with pytest.raises(SystemExit):
        run("daily", "--date", "2024-01-10", "--shop-id", "1")


def test_feed_rebuilds_touched_dates_only():
    from shoplens.streaming.daily_feed import rebuild_periods

    d = dt.date
    got = rebuild_periods([d(2024, 1, 1), d(2024, 1, 3), d(2024, 3, 1)])
    assert [(p.start, p.end) for p in got] == [(d(2024, 1, 1), d(2024, 1, 9)), (d(2024, 3, 1), d(2024, 3, 7))]
