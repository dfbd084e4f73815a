"""Split planning (S6): every wanted row satisfies exactly one predicate. The database is DuckDB inside this process."""

import datetime as dt
import random

import duckdb
import pytest

from shoplens.plans.params import Period
from shoplens.sources.jdbc import histogram_query, plan_predicates, split_predicates, wanted_days

D = dt.date


@pytest.mark.parametrize("kind", ["BIGINT", "VARCHAR", "DECIMAL(20,0)"])
@pytest.mark.parametrize("date_kind", ["DATE", "TIMESTAMP"])
@pytest.mark.parametrize("rows", [1, 7, 50, 100_000])
def test_every_row_satisfies_exactly_one_predicate(kind, date_kind, rows):
    r = random.Random(rows)
    con = duckdb.connect()
    con.execute(f"create table facts (shop_id {kind}, report_date {date_kind}, x int)")
    ids = [-(2 ** 62), -9, -3, -1, 0, 1, 5, 10, 99, 2 ** 62, None] if kind != "VARCHAR" else ["", "-3", "10", "9", "O'Neil", "a", "A", "é", "日本", " ", None]
    data = []
    for k in range(400):
        day = r.choice([None, D(2024, 1, 4), D(2024, 1, 10), D(2024, 1, 10), D(2024, 1, 10), D(2024, 1, 14), D(2024, 2, 1), D(2024, 2, 2), D(2023, 5, 5)])
        if day and date_kind == "TIMESTAMP":
            day = dt.datetime(day.year, day.month, day.day, r.choice([0, 12, 23]), 59, 59)
        data.append((r.choice(ids) if r.random() < 0.7 else (k if kind != "VARCHAR" else f"s{k}"), day, k))
    con.executemany("insert into facts values (?, ?, ?)", data)
    periods = [Period.of("2024-01-08", "2024-01-14"), Period.of("2024-02-01", "2024-02-02")]
    got = plan_predicates(lambda q: con.execute(f"select * from {q}").fetchall(), "facts", "report_date", "shop_id", periods, rows, lookback_days=6)
    hits = " + ".join(f"(case when {p} then 1 else 0 end)" for p in got)
    days = ", ".join(f"date '{d}'" for d in wanted_days(periods))
    wanted = f"(report_date is null or cast(report_date as date) in ({days}))"
    assert con.execute(f"select count(*) from facts where {wanted} and ({hits}) <> 1").fetchone()[0] == 0
    assert con.execute(f"select count(*) from facts where not {wanted} and ({hits}) <> 0").fetchone()[0] == 0
    sizes = [con.execute(f"select count(*) from facts where {p}").fetchone()[0] for p in got[:-1]]
    assert sum(sizes) + con.execute("select count(*) from facts where report_date is null").fetchone()[0] == con.execute(f"select count(*) from facts where {wanted}").fetchone()[0]
    if rows == 7:
        # A part holds about ``rows`` rows beside those of one id, which can't be cut.
        heaviest = con.execute("select max(n) from (select count(*) n from facts group by shop_id, cast(report_date as date))").fetchone()[0]
        assert max(sizes) <= 2 * rows + heaviest + 7 and len(got) > 10


def test_cuts_keep_the_order_of_the_database():
    con = duckdb.connect()
    con.execute("create table facts (shop_id varchar collate nocase, report_date date)")
    ids = ["b", "A", "a", "C", "c", "B", "d", "E", "_", "Z", "z"]
    con.executemany("insert into facts values (?, ?)", [(i, D(2024, 1, 10)) for i in ids * 5])
    got = plan_predicates(lambda q: con.execute(f"select * from {q}").fetchall(), "facts", "report_date", "shop_id", [Period.of("2024-01-10", "2024-01-10")], 4)
    hits = " + ".join(f"(case when {p} then 1 else 0 end)" for p in got)
    assert len(got) > 5 and con.execute(f"select count(*) from facts where ({hits}) <> 1").fetchone()[0] == 0


def test_small_days_are_read_together_and_gaps_are_not():
    days = {D(2024, 1, k): 10 for k in range(1, 8)} | {D(2024, 3, 1): 10}
    got = split_predicates(days, {}, "d", "s", 1000)
    assert got == ["((d >= '2024-01-01' AND d < '2024-01-08') OR (d >= '2024-03-01' AND d < '2024-03-02'))", "d IS NULL"]
    assert len(split_predicates(days, {}, "d", "s", 20)) == 5
    cut = split_predicates({D(2024, 1, 1): 100}, {D(2024, 1, 1): [-5, -5, 7]}, "d", "s", 40)
    day = "d >= '2024-01-01' AND d < '2024-01-02'"
    assert cut == [f"{day} AND (s < -5 OR s IS NULL)", f"{day} AND NOT (s < -5) AND s < 7", f"{day} AND NOT (s < 7)", "d IS NULL"]
    assert "2024-02" not in histogram_query("t", "d", wanted_days([Period.of("2024-01-10", "2024-01-10"), Period.of("2024-03-10", "2024-03-10")]))
    assert split_predicates({}, {}, "d", "s", 5) == ["d IS NULL"]
