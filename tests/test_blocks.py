"""Dyadic block rollups equal the rollup of the facts, and read fewer rows."""

import datetime as dt
import random

import pytest

from shoplens.operators.blocks import BlockRollup, cover, day_number
from shoplens.operators.facts import RollupSpec, joined_facts, period_rollup
from shoplens.plans.params import Period
from shoplens.plans.period import period_report
from shoplens.sources.tables import ReportTables
from tests.micro import make_tables, store_row

D0 = dt.date(2024, 1, 1)


def _period(a, b):
    return Period(D0 + dt.timedelta(days=a), D0 + dt.timedelta(days=b))


def test_cover_is_exact_and_short():
    r = random.Random(1)
    for _ in range(300):
        start = dt.date(1969, 6, 1) + dt.timedelta(days=r.randint(0, 30_000))
        p = Period(start, start + dt.timedelta(days=r.randint(-2, 900)))
        days = [n for level, b in cover(p) for n in range(b << level, (b + 1) << level)]
        assert days == list(range(day_number(p.start), day_number(p.end) + 1))
        n = len(days)
        assert len(cover(p)) <= 2 * max(1, n.bit_length()) + n // 512


def _equal(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.fixture(scope="module")
def driver(spark, tmp_path_factory):
    t = ReportTables.from_driver_tables(spark, "/root/testdata/sf0.001")
    blocks = BlockRollup(spark, str(tmp_path_factory.mktemp("blocks")), levels=6)
    blocks.build(t, _period(0, 29))
    return t, blocks


@pytest.mark.parametrize("spec", [RollupSpec(), RollupSpec("last_group"), RollupSpec("last_group", True), RollupSpec(checked=True)])
def test_blocks_equal_the_rollup_of_the_facts(spark, driver, spec):
    t, blocks = driver
    r = random.Random(spec.rename)
    for _ in range(2):
        p1, p2 = (_period(a, a + r.randint(0, 20)) for a in (r.randint(0, 15), r.randint(0, 15)))      # overlapping ones too
        want = period_rollup(joined_facts(t, [p1, p2]), p1, p2, spec)
        assert _equal(blocks.rollup(p1, p2, spec).select(*want.columns), want)


def test_blocks_read_fewer_rows(spark, driver):
    t, blocks = driver
    p1, p2 = _period(0, 14), _period(15, 29)
    assert blocks.touching(p1, p2).count() < 0.6 * joined_facts(t, [p1, p2]).count()
    parts = {(r.level, r.block) for r in blocks.touching(p1, p2).select("level", "block").distinct().collect()}
    assert parts <= {*cover(p1, 6), *cover(p2, 6)}
    plan = blocks.rollup(p1, p2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "level#" in plan.split("PartitionFilters: [")[1][:80]


def test_reports_from_blocks_equal_those_from_facts(spark, driver):
    t, blocks = driver
    p1, p2 = _period(0, 6), _period(7, 13)
    assert _equal(period_report(t, p1, p2, blocks=blocks).wide, period_report(t, p1, p2).wide)
    assert _equal(period_report(t, p1, p2, shop_id="17", blocks=blocks).wide, period_report(t, p1, p2, shop_id="17").wide)
    for wrong in (dict(quarantine=True), dict(dedupe_right=True)):
        with pytest.raises(ValueError):
            period_report(t, p1, p2, blocks=blocks, **wrong)


def test_touched_days_are_rebuilt(spark, tmp_path):
    days = [str(D0 + dt.timedelta(days=k)) for k in range(9)]
    t = make_tables(spark, store=[store_row(s, d, f"N{s}", exposure_users=1) for s in "12" for d in days])
    blocks = BlockRollup(spark, str(tmp_path), levels=4)
    blocks.build(t, _period(0, 8))
    # A late change of one day, a day that loses all its rows, and a new day beyond the built ones.
    changed = [store_row(s, d, f"N{s}", exposure_users=1) for s in "12" for d in days if d not in (days[2], days[5])]
    changed += [store_row("1", days[2], "Late", exposure_users=50), store_row("3", "2024-01-12", "New", exposure_users=9)]
    now = make_tables(spark, store=changed)
    blocks.update(now, [D0 + dt.timedelta(days=k) for k in (2, 5, 11)])
    for a, b in ((0, 8), (2, 2), (5, 5), (3, 11), (0, 11)):
        p1, p2 = _period(a, b), _period(4, 9)
        want = period_rollup(joined_facts(now, [p1, p2]), p1, p2)
        assert _equal(blocks.rollup(p1, p2).select(*want.columns), want), (a, b)
    assert blocks.rollup(_period(5, 5), _period(5, 5)).count() == 0


def test_duplicates_are_folded_when_asked(spark, tmp_path):
    d = D0
    t = make_tables(spark, store=[store_row("1", str(d), exposure_users=10)], promo=[("1", d, 3, 1, None, 1, 0), ("1", d, 5, 1, None, 1, 0)])
    p = _period(0, 0)
    for folded, want in ((False, 20), (True, 10)):
        blocks = BlockRollup(spark, str(tmp_path), folded, levels=2)
        blocks.build(t, p)
        assert blocks.rollup(p, p).first().exposure_users_p1 == want
