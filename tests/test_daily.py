"""Daily report (R1, R5) on micro fixtures and the driver tables."""

from pyspark.sql import functions as F

from shoplens.operators.facts import trailing_sum, trailing_sum_window
from shoplens.plans.daily import daily_report
from shoplens.plans.params import Period
from shoplens.sources.tables import ReportTables
from tests.micro import day, make_tables, store_row

ACC = ('[{"shop_id":1},{"shop_id":2},{"shop_id":3}]',
       '{"1":{"regions":{"city":{"regionName":"Bj"},"district":{"regionName":"Cy"},'
       '"business":{"regionName":"Sl"}}},"2":{"regions":{"city":{"regionName":"Sh"}}}}')


def _tables(spark):
    store = [
        store_row("1", "2024-01-10", "Shop/A*", verify_person_count=400, new_review_count=49, order_users=16,
                  new_collect_users=7, coupon_pay_order_count=4, promotion_cost=0, order_sale_amount=12.3,
                  intent_rate=""),
        store_row("1", "2024-01-04", "Shop/A*", coupon_pay_order_count=5),     # 6 days back: counts
        store_row("1", "2024-01-03", "Shop/A*", coupon_pay_order_count=100),   # 7 days back: does not
        store_row("2", "2024-01-10", "ShopA", verify_person_count=80, new_review_count=24, order_users=0),
        store_row("3", "2024-01-10", None),
        store_row("4", "2024-01-10", "ShopA"),
    ]
    stats = [("1", day("2024-01-10"), 0, 150, 2, None, 1, 2), ("2", day("2024-01-10"), 99, None, 0, None, 0, 0)]
    accounts = [("a1", ACC[0], ACC[1], "sal", "Town", 1)]
    return make_tables(spark, store=store, stats=stats, accounts=accounts, users=[(1, "Op")])


def test_daily_summary_checks_and_labels(spark):
    r = daily_report(_tables(spark), "2024-01-10")
    s = {x.shop_id: x for x in r.summary.collect()}
    assert [s[k].seq for k in ("1", "2", "3", "4")] == [1, 2, 3, 4]
    assert s["1"].weekday == "周三" and s["1"].date_label == "01月10日"
    assert s["1"].operator == "Op" and s["1"].city == "Town" and s["4"].operator == ""
    assert s["3"].shop_name == "门店3" and s["1"].intent_rate == "0%"
    assert (s["1"].order_rank_label, s["1"].verify_rank_label) == ("--", "大于100名")
    assert s["2"].order_rank_label == "第99名" and s["2"].verify_rank_label == "--"
    c = {x.shop_id: x for x in r.checks.collect()}
    assert c["1"].review_rate == f"{49 / 400 * 100:.1f}%" and not c["1"].review_pass
    assert c["1"].collect_rate == f"{7 / 16 * 100:.1f}%" and c["1"].collect_pass
    assert c["2"].review_rate == "30.0%" and c["2"].review_pass and c["2"].collect_rate == "0.0%"
    assert c["1"].coupon_orders_7d == 9 and not c["1"].coupon_pass
    assert (c["1"].ad_today, c["1"].ad_text, c["1"].ad_pass) == (1, "当天1单", True)
    k = {x.shop_id: x for x in r.ranks.collect()}
    assert k["1"].region_path == "Bj | Cy | Sl" and k["1"].order_rank_detail == "Bj | Cy | Sl：大于100名"
    assert k["2"].region_path == "Town" and k["2"].order_rank_detail == "Town：第99名"


def test_sheet_names_and_detail(spark):
    r = daily_report(_tables(spark), "2024-01-10")
    names = {x.shop_id: x.sheet_name for x in r.sections.collect()}
    assert names == {"1": "ShopA", "2": "ShopA_2", "3": "门店3", "4": "ShopA_3"}
    d = r.detail.where("shop_id = '1'").orderBy("row_no").collect()
    assert len(d) == 39
    assert d[0].col_b == "警告：有2个团单被强制下线！" and d[0].alert
    assert d[1].col_b == "日期(01/10)" and d[2].is_section
    assert (d[19].col_a, d[19].col_b) == ("推广通消耗：", "0")        # zero money prints 0
    assert d[29].col_b == "12.30"
    assert [x.passed for x in d[24:28]] == [False, True, False, True]
    assert d[26].col_b == "9" and d[27].col_b == "当天1单"


def test_legacy_status_and_accounts(spark):
    t = _tables(spark)
    r = daily_report(t, "2024-01-10", legacy=True)
    first = r.detail.where("shop_id = '1' AND row_no = 1").first()
    assert first.col_b.startswith("⚠️ 警告")
    only = daily_report(t, "2024-01-10", accounts=["a1"]).summary
    assert sorted(x.shop_id for x in only.collect()) == ["1", "2", "3"]


def test_trailing_sum_matches_window_and_range_report(spark):
    t = ReportTables.from_driver_tables(spark, "/root/testdata/sf0.01")
    days = Period.of("2024-01-05", "2024-01-20")
    src = t.store_daily.select("shop_id", "report_date", "coupon_pay_order_count")
    a = trailing_sum(src, "coupon_pay_order_count", days)
    b = trailing_sum_window(src, "coupon_pay_order_count", days)
    a = a.join(src.select("shop_id", "report_date"), ["shop_id", "report_date"], "left_semi")
    assert a.exceptAll(b.select(*a.columns)).count() == 0 and b.select(*a.columns).exceptAll(a).count() == 0
    rng = daily_report(t, ("2024-01-08", "2024-01-14")).summary
    per_day = rng.groupBy("report_date").agg(F.max("seq").alias("m"), F.count(F.lit(1)).alias("n")).collect()
    assert len(per_day) == 7 and all(r.m == r.n for r in per_day)


def test_duplicate_stats_rows_fan_out_and_keep_numbering(spark):
    stats = [("1", day("2024-01-10"), 5, 5, 1, None, 1, 0), ("1", day("2024-01-10"), 7, 7, 1, None, 0, 0)]
    t = make_tables(spark, store=[store_row("1", "2024-01-10", "A"), store_row("2", "2024-01-10", "B")],
                    stats=stats)
    r = daily_report(t, "2024-01-10")
    rows = sorted((x.shop_id, x.seq, x.sheet_name) for x in r.sections.collect())
    assert [x[0] for x in rows] == ["1", "1", "2"] and sorted(x[1] for x in rows) == [1, 2, 3]
    assert sorted(x[2] for x in rows if x[0] == "1") == ["A", "A_2"]
    assert daily_report(t, "2024-01-10", dedupe_right=True).summary.count() == 2
