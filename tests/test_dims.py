"""G1-G4, A8, J3, P3-P5 on hand-written account rows (FIXTURES.md §3)."""

import pytest

from shoplens.operators.dims import region_dim, resolved_shops, shop_dim, shop_filter
from tests.micro import make_tables, store_row

REGIONS = ('{"1":{"regions":{"city":{"regionName":"Bj"},"district":{"regionName":"Cy"},'
           '"business":{"regionName":"Sl"}}},'
           '"2":{"regions":[]},"3":5,"4":{"other":1},'
           '"5":{"regions":{"city":"x","district":{"regionName":7}}}}')


def _accounts(spark, rows):
    return make_tables(spark, accounts=rows, users=[(1, "Ann"), (2, "Bo")])


def test_store_ids_follow_python_rules(spark):
    t = _accounts(spark, [
        ("a1", '[{"shop_id":1},{"shop_id":"7"},7,{"x":1},{"shop_id":""},[{"shop_id":9}]]', None, "s1", "c1", 1),
        ("a2", '{"shop_id":5}', None, "s2", "c2", 2),              # root_obj: not a list -> ignored
        ("a3", "not json", None, "s3", "c3", None),                # malformed -> ignored
        ("a4", '[{"shop_id":11,"shop_id":12}]', None, "s4", "c4", 1),   # dup_key: last wins
        ("a5", None, None, "s5", "c5", 1),                         # no stores_json
    ])
    got = sorted(r.shop_id for r in resolved_shops(t, None).collect())
    assert got == ["1", "12", "7"]


def test_shop_dim_attributes_and_owner_rule(spark):
    t = _accounts(spark, [
        ("a1", '[{"shop_id":1},{"shop_id":2}]', None, "s1", None, 1),
        ("a2", '[{"shop_id":2}]', None, None, "c2", 9),            # dup_owner: shop 2 in two accounts
    ])
    got = {r.shop_id: (r.operator, r.sales, r.city) for r in shop_dim(t).collect()}
    assert got["1"] == ("Ann", "s1", "")
    # greatest (account, position) owns the shop; NULL attributes read as ''
    assert got["2"] == ("", "", "c2")


def test_region_dim_type_guards(spark):
    t = _accounts(spark, [("a1", "[]", REGIONS, None, None, None),
                          ("a2", "[]", "broken {", None, None, None)])
    got = {r.shop_id: (r.region_city, r.region_district, r.region_business) for r in region_dim(t).collect()}
    assert got["1"] == ("Bj", "Cy", "Sl")
    assert "2" not in got          # regions is a list -> skipped
    assert "3" not in got          # value is not an object -> skipped
    assert got["4"] == ("", "", "")    # no regions key -> an entry of empty names
    assert got["5"] == ("", "7", "")   # city is not an object -> ''; numeric name kept as text


def test_account_filter_unresolved_modes(spark):
    store = [store_row(s, "2024-01-10") for s in ("1", "2")]
    t = make_tables(spark, store=store, accounts=[("a1", "not json", None, None, None, None)])
    none = shop_filter(t, accounts=["a1"])                     # default: no shop
    assert none is not None and none.count() == 0
    assert shop_filter(t, accounts=["a1"], unresolved="all") is None   # original: no filter
    assert shop_filter(t, accounts=["missing"], unresolved="all") is None
    assert shop_filter(t, accounts=[]).count() == 0            # a list that names nothing selects nothing
    assert shop_filter(t, accounts=[], unresolved="all") is None
    one = shop_filter(t, shop_id=2)                           # a literal predicate
    assert [r.shop_id for r in t.store_daily.where(one).collect()] == ["2"]


def test_accounts_as_dataframe_semi_join(spark):
    t = _accounts(spark, [("a1", '[{"shop_id":1}]', None, None, None, None),
                          ("a2", '[{"shop_id":2}]', None, None, None, None)])
    accs = spark.createDataFrame([("a2",)], "account string")
    assert [r.shop_id for r in resolved_shops(t, accs).collect()] == ["2"]
    assert [r.shop_id for r in shop_dim(t, accs).collect()] == ["2"]


def test_normalized_inputs(spark):
    import datetime as dt

    from shoplens.plans.daily import daily_report

    t = make_tables(spark, store=[store_row("7", "2024-01-10", "A")])
    numeric = t.store_daily.selectExpr("CAST(shop_id AS BIGINT) AS shop_id", "CAST(report_date AS TIMESTAMP) "
                                       "AS report_date", *[c for c in t.store_daily.columns
                                                            if c not in ("shop_id", "report_date")])
    n = t.replace(store_daily=numeric).normalized()
    assert dict(n.store_daily.dtypes)["shop_id"] == "string" and dict(n.store_daily.dtypes)["report_date"] == "date"
    row = daily_report(n, dt.date(2024, 1, 10)).summary.first()
    assert row.shop_id == "7" and row.seq == 1
    assert t.normalized().store_daily is t.store_daily        # already typed: untouched


def test_a_filter_that_names_nothing_follows_one_rule(spark):
    from shoplens.plans.params import Period
    from shoplens.plans.period import period_report

    t = make_tables(spark, store=[store_row("1", "2024-01-03", "A"), store_row("2", "2024-01-10", "B")],
                    accounts=[("a1", '[{"shop_id":1}]', None, "s", "c", None)], users=[(1, "Op")])
    p = (Period.of("2024-01-01", "2024-01-07"), Period.of("2024-01-08", "2024-01-14"))
    nothing = spark.createDataFrame([], "shop_id string, account string")
    for kw in ({"shop_ids": []}, {"shop_ids": nothing}, {"accounts": []}, {"accounts": nothing}, {"accounts": ["missing"]}):
        assert period_report(t, *p, **kw).wide.count() == 0, kw
        assert period_report(t, *p, unresolved="all", **kw).wide.count() == 2, kw
    many = [str(i) for i in range(3000)]                       # one path for every list length
    assert period_report(t, *p, shop_ids=many).wide.count() == 2
    with pytest.raises(ValueError):
        period_report(t, *p, by_city=True)
