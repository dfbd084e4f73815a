"""Period reports (R2-R4) on micro fixtures and the driver tables."""

import pytest
from pyspark.sql import functions as F

from shoplens.operators.facts import PERIOD_SUMS, joined_facts
from shoplens.plans.params import Period
from shoplens.plans.period import period_report
from shoplens.plans.runner import run_period
from shoplens.sources.tables import ReportTables
from tests.micro import make_tables, store_row

P1 = Period.of("2024-01-01", "2024-01-07")
P2 = Period.of("2024-01-08", "2024-01-14")


def _wide(t, p1=P1, p2=P2, **kw):
    return {r.shop_id: r for r in period_report(t, p1, p2, **kw).wide.collect()}


def test_fanout_doubles_sums_unless_deduped(spark):
    store = [store_row("1", "2024-01-02", exposure_users=10, visit_users=4)]
    promo = [("1", store_row("1", "2024-01-02")[1], 3, 1, None, 1, 0),
             ("1", store_row("1", "2024-01-02")[1], 5, 1, None, 1, 0)]
    t = make_tables(spark, store=store, promo=promo)
    plain = _wide(t)["1"]
    assert plain.exposure_users_p1 == 20 and plain.phone_clicks_p1 == 8      # J9: left join multiplies
    dedup = _wide(t, dedupe_right=True)["1"]
    assert dedup.exposure_users_p1 == 10 and dedup.phone_clicks_p1 == 8


def test_overlap_counts_a_day_in_both_periods(spark):
    store = [store_row("1", "2024-01-06", exposure_users=7)]
    t = make_tables(spark, store=store)
    r = _wide(t, Period.of("2024-01-01", "2024-01-10"), Period.of("2024-01-05", "2024-01-14"))["1"]
    assert r.exposure_users_p1 == 7 and r.exposure_users_p2 == 7 and r.exposure_users_delta == 0


def test_one_sided_and_name_fallback(spark):
    store = [store_row("1", "2024-01-10", "Old", exposure_users=5, visit_users=2),
             store_row("2", "2024-01-11", "", exposure_users=3),
             store_row("3", "2024-01-10", "N3", exposure_users=1),
             store_row("3", "2024-01-11", None, exposure_users=1)]
    t = make_tables(spark, store=store)
    w = _wide(t, Period.of("2024-01-10", "2024-01-10"), Period.of("2024-01-11", "2024-01-11"))
    assert w["1"].shop_name == "Old" and w["1"].exposure_users_p2 == 0 and w["1"].exposure_users_delta == -5
    assert w["2"].shop_name == "未知门店"            # only in period 2, with an empty name
    assert w["3"].shop_name == "N3"                  # period-2 name empty -> period-1 name
    assert [w[k].seq for k in ("1", "2", "3")] == [1, 2, 3]
    assert w["1"].exposure_rate_p2_text == "0%" and w["1"].exposure_rate_delta_text == "-40.0%"
    assert w["1"].operator == "--" and w["1"].city == "--"


def test_rename_modes(spark):
    store = [store_row("1", "2024-01-02", "A", exposure_users=1),
             store_row("1", "2024-01-03", "B", exposure_users=2)]
    t = make_tables(spark, store=store)
    latest = _wide(t)["1"]
    assert latest.exposure_users_p1 == 3 and latest.shop_name == "B"
    last = _wide(t, rename="last_group")["1"]          # one name group survives, the other's rows are lost
    assert last.exposure_users_p1 == 2 and last.shop_name == "B"


def test_reversed_period_is_empty(spark, scratch):
    t = make_tables(spark, store=[store_row("1", "2024-01-02")])
    with pytest.raises(ValueError):
        run_period(t, Period.of("2024-01-07", "2024-01-01"), Period.of("2024-01-14", "2024-01-08"), scratch)
    with pytest.warns(UserWarning):
        out = run_period(t, Period.of("2024-01-07", "2024-01-01"), Period.of("2024-01-14", "2024-01-08"),
                         scratch, on_empty="warn")
    assert out is None


@pytest.fixture(scope="module")
def driver_tables(spark):
    return ReportTables.from_driver_tables(spark, "/root/testdata/sf0.01")


def test_one_pass_rollup_equals_two_rollups(spark, driver_tables):
    """A2 (conditional aggregate) == J6 (two rollups, full outer join on shop)."""
    rep = period_report(driver_tables, P1, P2)
    base = rep.base.select("shop_id", *[f"{m}_p1" for m, *_ in PERIOD_SUMS], *[f"{m}_p2" for m, *_ in PERIOD_SUMS])
    j = joined_facts(driver_tables, [P1, P2]).withColumn("verify_users", F.col("verify_person_count"))

    def roll(p, sfx):
        src = {m: c for m, _, c, _ in PERIOD_SUMS}
        return (j.where(F.col("report_date").between(F.lit(p.start), F.lit(p.end))).groupBy("shop_id")
                .agg(*[F.sum(src[m]).alias(f"{m}{sfx}") for m, *_ in PERIOD_SUMS]))

    other = roll(P1, "_p1").join(roll(P2, "_p2"), "shop_id", "full").select(*base.columns)
    assert base.exceptAll(other).count() == 0 and other.exceptAll(base).count() == 0


def test_layout_sizes_and_deltas(spark, driver_tables):
    rep = period_report(driver_tables, P1, P2)
    n = rep.base.count()
    assert rep.rows8.count() == 8 * n and rep.detail31.count() == 31 * n
    bad = rep.wide.where("exposure_users_delta <> exposure_users_p2 - exposure_users_p1 OR "
                         "promotion_cost_delta <> promotion_cost_p2 - promotion_cost_p1").count()
    assert bad == 0
    seqs = [r.seq for r in rep.base.orderBy("shop_id").select("seq").collect()]
    assert seqs == list(range(1, n + 1))


def test_cell_rendering_of_missing_and_zero_values(spark):
    """Cells as the sheet shows them: a missing period prints '0' (not '0.00'), an
    undefined rate '0%', a defined zero rate '0.0%'; differences keep two decimals
    once one side exists; the detail rate difference has two decimals."""
    store = [store_row("1", "2024-01-09", "A", exposure_users=40, visit_users=0, verify_person_count=3,
                       verify_after_discount=12.3, promotion_cost=0)]
    t = make_tables(spark, store=store)
    rep = period_report(t, P1, P2)
    lines = {r.line_no: r for r in rep.rows8.collect()}
    p1, p2, delta = lines[2], lines[3], lines[4]
    # block 1: c07 discount, c08 exposure, c10 exposure rate, c13 order rate, c20 avg price
    assert (p1.c07, p1.c08, p1.c10, p1.c13, p1.c20) == ("0", "0", "0%", "0%", "0")
    assert (p2.c07, p2.c08, p2.c10, p2.c13, p2.c20) == ("12.30", "40", "0.0%", "0%", "4.10")
    assert (delta.c07, delta.c08, delta.c10, delta.c13, delta.c20) == ("12.30", "40", "0.0%", "0%", "4.10")
    assert lines[7].c07 == "0.00" and lines[6].c07 == "0"          # promotion cost: present zero vs missing
    d = {r.label: r for r in rep.detail31.collect()}
    assert (d["曝光访问转化率："].p2, d["曝光访问转化率："].delta) == ("0.0%", "0.00%")
    assert (d["意向转化率："].p2, d["意向转化率："].delta) == ("0%", "0%")


def test_shop_list_as_dataframe_equals_literal_list(spark, driver_tables):
    ids = ["3", "5", "8", "13", "21"]
    as_list = period_report(driver_tables, P1, P2, shop_ids=ids).wide
    as_df = period_report(driver_tables, P1, P2,
                          shop_ids=spark.createDataFrame([(i,) for i in ids], "shop_id string")).wide
    assert as_list.count() == len(ids)
    assert as_list.exceptAll(as_df).count() == 0 and as_df.exceptAll(as_list).count() == 0


def test_quarantine_leaves_out_failing_shops(spark):
    store = [store_row("1", "2024-01-02", "A", exposure_users=5),
             store_row("2", "2024-01-03", "B", exposure_users=-1),          # breaks a rule
             store_row("2", "2024-01-09", "B", exposure_users=4)]
    t = make_tables(spark, store=store)
    rep = period_report(t, P1, P2, quarantine=True)
    assert [r.shop_id for r in rep.wide.collect()] == ["1"] and rep.wide.first().seq == 1
    bad = rep.rejected.collect()
    assert [(r.shop_id, str(r.report_date)) for r in bad] == [("2", "2024-01-03")]
    assert "negative exposure_users" in bad[0].errors
    assert [(r.shop_id, r.errors, r.exposure_users_p1, r.exposure_users_p2) for r in rep.failed.collect()] == [("2", "negative exposure_users", -1, 4)]
    assert period_report(t, P1, P2).wide.count() == 2                        # default: no quarantine


def test_service_signatures(spark):
    from shoplens import custom_report, monthly_report, weekly_report

    t = make_tables(spark, store=[store_row("1", "2024-01-02", "A", exposure_users=3),
                                  store_row("2", "2024-01-09", "B", exposure_users=4)])
    w = weekly_report(t, "2024-01-01", "2024-01-07", "2024-01-08", "2024-01-14").wide
    m = monthly_report(t, "2024-01-01", "2024-01-07", "2024-01-08", "2024-01-14").wide
    c = custom_report(t, "2024-01-01", "2024-01-07", "2024-01-08", "2024-01-14", shop_id="2").wide
    assert w.exceptAll(m).count() == 0 and w.count() == 2
    assert [(r.shop_id, r.exposure_users_p2) for r in c.collect()] == [("2", 4)]


def _no_shop(row):
    return (None, *row[1:])


def test_a_failing_shop_does_not_stop_the_others(spark):
    big = 2 ** 62
    store = [store_row("1", "2024-01-02", "A", exposure_users=5), store_row("2", "2024-01-02", "B", visit_users=big, exposure_users=3),
             store_row("3", "2024-01-02", "C", visit_users=big), store_row("3", "2024-01-03", "C2", visit_users=big), store_row("3", "2024-01-09", "C2", visit_users=7),
             store_row("4", "2024-01-03", "D", exposure_users=-1), store_row("4", "2024-01-04", "D", exposure_users=-1, visit_users=-2),
             store_row("5", None, "E"), _no_shop(store_row("", "2024-01-09", "F", exposure_users=7)), store_row("6", "2024-01-10", "G", visit_users=big)]
    t = make_tables(spark, store=store)
    for rename in ("sum_latest", "last_group"):
        rep = period_report(t, P1, P2, quarantine=True, rename=rename)
        # With last_group only one name of shop 3 counts, and its figures fit.
        others = [] if rename == "sum_latest" else ["3"]
        assert [(r.shop_id, r.seq) for r in rep.wide.orderBy("seq").collect()] == [(x, i) for i, x in enumerate(["1", *others, "6"], 1)]
        bad = {r.shop_id: r for r in rep.failed.collect()}
        assert set(bad) == {"2", "4", "5", None} | ({"3"} - set(others))
        assert bad["2"].errors == "overflow in exposure_rate_p1" and bad["2"].visit_users_p1 == big and bad["2"].visit_users_p2 is None
        if rename == "sum_latest":                       # both names of shop 3 are added up
            assert bad["3"].errors == "overflow in visit_users_p1" and bad["3"].visit_users_p1 is None and bad["3"].visit_users_p2 == 7
        assert bad["4"].errors == "negative exposure_users; negative exposure_users; negative visit_users" and bad["4"].exposure_users_p1 == -2
        assert (bad["5"].errors, bad["5"].has_p1, bad["5"].shop_name) == ("missing report_date", False, None)
        assert (bad[None].errors, bad[None].shop_name, bad[None].exposure_users_p2) == ("missing shop_id", "F", 7)
    with pytest.raises(Exception, match="OVERFLOW"):
        period_report(t, P1, P2).wide.collect()


def test_an_overflow_within_one_name_fails_the_shop(spark):
    big = 2 ** 62
    t = make_tables(spark, store=[store_row("1", "2024-01-02", "A", visit_users=big), store_row("1", "2024-01-03", "A", visit_users=big),
                                  store_row("1", "2024-01-04", "B", visit_users=1), store_row("2", "2024-01-04", "A", visit_users=None)])
    rep = period_report(t, P1, P2, quarantine=True)
    assert [(r.shop_id, r.errors, r.visit_users_p1) for r in rep.failed.collect()] == [("1", "overflow in visit_users_p1", None)]
    assert [r.shop_id for r in rep.wide.collect()] == ["2"]


def test_negative_differences_that_overflow(spark):
    day = store_row("1", "2024-01-02")[1]
    later = store_row("1", "2024-01-09")[1]
    t = make_tables(spark, store=[store_row("1", "2024-01-02"), store_row("1", "2024-01-09"), store_row("2", "2024-01-02")],
                    promo=[("1", day, -2 ** 62, 0, None, 0, 0), ("1", later, 2 ** 62 + 1, 0, None, 0, 0)])
    rep = period_report(t, P1, P2, quarantine=True)
    assert [(r.shop_id, r.errors) for r in rep.failed.collect()] == [("1", "overflow in phone_clicks_delta; overflow in view_phone_delta")]


def test_an_empty_shop_id_names_no_shop(spark):
    t = make_tables(spark, store=[store_row("1", "2024-01-02"), store_row("2", "2024-01-02")],
                    accounts=[("a1", '[{"shop_id":1}]', None, "s", "c", None)])
    assert _wide(t, shop_id="") == {}
    assert set(_wide(t, shop_id="", unresolved="all")) == {"1", "2"}
    assert set(_wide(t, shop_id="", accounts=["a1"], unresolved="all")) == {"1"}
