"""Stored trailing totals: corrections of single days equal summing again, without reading the other days."""

import datetime as dt
import random

from pyspark.sql import functions as F

from shoplens.operators.facts import trailing_sum
from shoplens.operators.trailing import TrailingState
from shoplens.plans.params import Period

D0 = dt.date(2024, 1, 1)
SCHEMA = "shop_id string, report_date date, x long"


def _day(k):
    return D0 + dt.timedelta(days=k)


def _want(rows, report, days=7):
    out = {}
    for k in range((report.end - report.start).days + 1):
        d = report.start + dt.timedelta(days=k)
        for shop, day, x in rows:
            if d - dt.timedelta(days=days - 1) <= day <= d:
                out[shop, d] = out.get((shop, d), 0) + (x or 0)
    return out


def _got(state, report):
    rows = state.totals(report).collect()
    assert len({(r.shop_id, r.report_date) for r in rows}) == len(rows)
    return {(r.shop_id, r.report_date): r.total for r in rows}


def _random_rows(r, days):
    return [(s, _day(k), r.choice([0, 3, None, r.randint(1, 50)])) for s in ("1", "2", "3", None) for k in days for _ in range(r.choice([0, 1, 1, 2]))]


def test_built_totals_equal_the_plain_sums(spark, tmp_path):
    rows = _random_rows(random.Random(1), range(-8, 12))
    df = spark.createDataFrame(rows, SCHEMA)
    state, report = TrailingState(spark, str(tmp_path / "s")), Period(_day(0), _day(11))
    state.build(df, "x", report)
    assert _got(state, report) == _want(rows, report)
    plain = trailing_sum(df.where("shop_id is not null"), "x", Period(_day(3), _day(3)), out="t").collect()
    assert {(r.shop_id, r.t or 0) for r in plain} == {(s, t) for (s, d), t in _got(state, report).items() if d == _day(3) and s is not None}


def test_corrections_equal_building_again(spark, tmp_path):
    r = random.Random(2)
    rows = _random_rows(r, range(-6, 10))
    state, report = TrailingState(spark, str(tmp_path / "s")), Period(_day(0), _day(9))
    state.build(spark.createDataFrame(rows, SCHEMA), "x", report)
    for changed in ([3], [8, 0], [9]):
        days = [_day(k) for k in changed]
        rows = [x for x in rows if x[1] not in days] + [x for x in _random_rows(r, changed) if x[0] != "2"] + [("new", days[0], 7)]
        written = state.correct(spark.createDataFrame(rows, SCHEMA), "x", days)
        assert written == sorted({_day(k + i) for k in changed for i in range(7) if k + i <= 9})
        assert _got(state, report) == _want(rows, report), changed
    before = _got(state, report)
    state.correct(spark.createDataFrame(rows, SCHEMA), "x", [_day(3)])                  # again: no difference
    assert _got(state, report) == before
    assert state.correct(spark.createDataFrame(rows, SCHEMA), "x", [_day(40)]) == []


def test_only_the_changed_day_is_read(spark, tmp_path):
    rows = [(str(s), _day(k), 1) for s in range(20) for k in range(10)]
    spark.createDataFrame(rows, SCHEMA).write.partitionBy("report_date").parquet(str(tmp_path / "facts"))
    facts = spark.read.schema(SCHEMA).parquet(str(tmp_path / "facts"))
    state, report = TrailingState(spark, str(tmp_path / "s")), Period(_day(0), _day(9))
    state.build(facts, "x", report)
    # The facts of the other days raise when they are read.
    trap = facts.withColumn("x", F.when(F.col("report_date") == F.lit(_day(4)), F.col("x") + 9).otherwise(F.raise_error(F.lit("read")).cast("long")))
    state.correct(trap, "x", [_day(4)])
    got = _got(state, report)
    assert got["3", _day(3)] == 4 and got["3", _day(4)] == 5 + 9 and got["3", _day(9)] == 7 + 9


def test_a_day_that_loses_all_rows(spark, tmp_path):
    state, report = TrailingState(spark, str(tmp_path / "s"), days=2), Period(_day(0), _day(3))
    state.build(spark.createDataFrame([("1", _day(1), 5)], SCHEMA), "x", report)
    assert _got(state, report) == {("1", _day(1)): 5, ("1", _day(2)): 5}
    state.correct(spark.createDataFrame([], SCHEMA), "x", [_day(1)])
    assert _got(state, report) == {}
    state.correct(spark.createDataFrame([("1", _day(1), None)], SCHEMA), "x", [_day(1)])
    assert _got(state, report) == {("1", _day(1)): 0, ("1", _day(2)): 0}
