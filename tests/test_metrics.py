"""N1-N9 rounding and text rules against Python's own arithmetic on the same values."""

import random
from decimal import ROUND_HALF_EVEN, Decimal

from shoplens.functions import metrics as M

TIES = [(49, 400), (1, 16), (3, 80), (0, 5), (5, 0), (1, 8), (7, 40), (1, 3), (2, 3), (0, 0), (35, 100), (57, 100)]


def _pairs(seed=7, n=1500):
    rnd = random.Random(seed)
    out = list(TIES)
    for _ in range(n):
        d = rnd.choice([rnd.randint(1, 50), rnd.randint(1, 10_000), 8 * rnd.randint(1, 500),
                        16 * rnd.randint(1, 500), 40 * rnd.randint(1, 100), rnd.randint(1, 10**12)])
        out.append((rnd.randint(0, 3 * d), d))
    return out


TENTH, CENT = Decimal("0.1"), Decimal("0.01")


def expected_rate(n, d):
    """SURVEY N1: n/d*100 to one decimal, half-even; the integer 0 when d <= 0."""
    return (Decimal(n) * 100 / Decimal(d)).quantize(TENTH, ROUND_HALF_EVEN) if d > 0 else 0


def expected_avg(total_cents, count):
    """SURVEY N2: total/count to two decimals, half-even; the integer 0 when count <= 0."""
    return (Decimal(total_cents) / 100 / Decimal(count)).quantize(CENT, ROUND_HALF_EVEN) if count > 0 else 0


def test_rate_text_and_value_match_decimal(spark):
    pairs = _pairs()
    df = spark.createDataFrame(pairs, "n bigint, d bigint")
    got = df.selectExpr("n", "d", f"{M.rate_text('n', 'd')} AS t", f"{M.rate_value('n', 'd')} AS v").collect()
    for r in got:
        want = expected_rate(r.n, r.d)
        assert r.t == f"{want}%", (r.n, r.d, r.t, want)
        assert Decimal(r.v) == Decimal(want), (r.n, r.d, r.v, want)


def test_avg_price_matches_decimal(spark):
    rnd = random.Random(3)
    rows = [(0, 5), (5, 0), (125, 2), (375, 2), (1, 8), (100, 3)]
    rows += [(rnd.randint(0, 10**9), rnd.choice([rnd.randint(1, 40), 8 * rnd.randint(1, 300)])) for _ in range(1500)]
    df = spark.createDataFrame([(Decimal(c) / 100, n) for c, n in rows], "total decimal(18,2), n bigint")
    got = df.selectExpr("total", "n", f"{M.avg_value('total', 'n')} AS v", f"{M.avg_cents('total', 'n')} AS c"
                        ).collect()
    for (cents, n), r in zip(rows, got):
        want = expected_avg(cents, n)
        assert Decimal(r.v) == Decimal(want), (cents, n, r.v, want)


def test_summary_rate_difference_texts(spark):
    # Differences of the two rates (an undefined rate counts as 0).
    pairs = [((1, 3), (2, 3)), ((0, 0), (0, 0)), ((0, 0), (0, 5)), ((5, 10), (5, 10)), ((7, 9), (0, 0)),
             ((49, 400), (3, 80))]
    rows = [(a, b, c, d) for (a, b), (c, d) in pairs]
    df = spark.createDataFrame(rows, "n1 bigint, d1 bigint, n2 bigint, d2 bigint")
    t1, t2 = M.rate_tenths("n1", "d1"), M.rate_tenths("n2", "d2")
    got = df.selectExpr(f"{M.tenths_diff_text(t1, t2)} AS s", f"{M.tenths_diff_text2(t1, t2)} AS s2").collect()
    for (n1, d1, n2, d2), r in zip(rows, got):
        a, b = expected_rate(n1, d1), expected_rate(n2, d2)
        both_undefined = d1 <= 0 and d2 <= 0
        # One decimal; '0%' only when both rates are undefined
        assert r.s == ("0%" if both_undefined else f"{(Decimal(b) - Decimal(a)).quantize(TENTH)}%"), (n1, d1, n2, d2)
        # N5 (legacy detail): two decimals
        assert r.s2 == ("0%" if both_undefined else f"{(Decimal(b) - Decimal(a)).quantize(CENT)}%"), (n1, d1, n2, d2)


def test_daily_float_rate_text_and_threshold(spark):
    pairs = _pairs(seed=11, n=800) + [(3, 10), (4, 10), (30, 100), (2, 5), (40, 100), (12, 40), (9, 30)]
    pairs = [(n, d) for n, d in pairs if d < 10**9]
    df = spark.createDataFrame(pairs, "n bigint, d bigint")
    got = df.selectExpr("n", "d", f"{M.float_rate_text('n', 'd')} AS t",
                        f"{M.float_rate_at_least('n', 'd', 30)} AS p30",
                        f"{M.float_rate_at_least('n', 'd', 40)} AS p40").collect()
    for r in got:
        x = (r.n / r.d * 100) if r.d > 0 else 0
        assert r.t == f"{x:.1f}%", (r.n, r.d, r.t)
        assert r.p30 == (x >= 30) and r.p40 == (x >= 40), (r.n, r.d)


def test_money_cells(spark):
    df = spark.createDataFrame([(None,), (Decimal("0.00"),), (Decimal("12.30"),)], "x decimal(18,2)")
    got = [tuple(r) for r in df.selectExpr(M.money_cell_daily("x"), M.money_cell_period("x")).collect()]
    assert got == [("0", "0"), ("0", "0.00"), ("12.30", "12.30")]
