"""Numeric report functions as Spark SQL expression text.

Every function takes SQL expressions (usually column names) and returns SQL
text; callers put it in ``selectExpr``/``F.expr``, so a whole projection is one
JVM call and every expression is a built-in (codegen, no Python UDF).

Rounding agrees with Python ``Decimal`` half-even rounding:

* a rate ``round(n/d*100, 1)`` is ``round_half_even(n*1000 / d)`` tenths;
* an average price ``round(total/count, 2)`` is ``round_half_even(cents / count)``.

``decimal(20,0) / decimal(20,0)`` keeps 18 fractional digits; a quotient that is
not an exact tie is at least ``1/(2d)`` away from one, far above 1e-18 for any
count below 1e15, so ``bround`` on it is exact. Every ratio is guarded
(``d > 0``): ANSI mode raises on division by zero.
"""

from __future__ import annotations

RATE_TYPE = "decimal(20,1)"
RATE_DIFF2_TYPE = "decimal(20,2)"
MONEY_TYPE = "decimal(38,2)"


def half_even_div(n: str, d: str) -> str:
    """``round(n / d)`` half to even, integers, ``d > 0``."""
    return f"CAST(bround(CAST({n} AS DECIMAL(20,0)) / CAST({d} AS DECIMAL(20,0)), 0) AS BIGINT)"


def rate_tenths(n: str, d: str) -> str:
    """Tenths of a percent, half-even; NULL when the denominator is NULL or <= 0."""
    return (f"(CASE WHEN {d} > 0 THEN "
            f"{half_even_div(f'CAST(coalesce({n}, 0) AS BIGINT) * 1000', f'CAST({d} AS BIGINT)')} END)")


def tenths_value(t: str) -> str:
    """Tenths (bigint) -> DECIMAL(20,1); NULL stays NULL."""
    return f"CAST(CAST({t} AS DECIMAL(20,0)) * 0.1 AS {RATE_TYPE})"


def rate_value(n: str, d: str) -> str:
    """N1 numeric value: the rate, or 0.0 when undefined."""
    return f"coalesce({tenths_value(rate_tenths(n, d))}, CAST(0 AS {RATE_TYPE}))"


def tenths_text(t: str) -> str:
    """``12.3%`` when defined, ``0%`` when the rate is undefined."""
    return f"(CASE WHEN {t} IS NOT NULL THEN concat(CAST({tenths_value(t)} AS STRING), '%') ELSE '0%' END)"


def rate_text(n: str, d: str) -> str:
    return tenths_text(rate_tenths(n, d))


def _tdiff(t1: str, t2: str) -> str:
    return f"(coalesce({t2}, 0) - coalesce({t1}, 0))"


def tenths_diff_value(t1: str, t2: str) -> str:
    """Numeric rate difference (an undefined rate counts as 0)."""
    return tenths_value(_tdiff(t1, t2))


def tenths_diff_text(t1: str, t2: str) -> str:
    """Summary rate difference, one decimal; ``0%`` only when both undefined."""
    return (f"(CASE WHEN {t1} IS NULL AND {t2} IS NULL THEN '0%' "
            f"ELSE concat(CAST({tenths_diff_value(t1, t2)} AS STRING), '%') END)")


def tenths_diff_text2(t1: str, t2: str) -> str:
    """Detail rate difference, two decimals (``1.20%``); ``0%`` when both undefined."""
    return (f"(CASE WHEN {t1} IS NULL AND {t2} IS NULL THEN '0%' "
            f"ELSE concat(CAST(CAST({tenths_diff_value(t1, t2)} AS {RATE_DIFF2_TYPE}) AS STRING), '%') END)")


def money_cents(x: str) -> str:
    """DECIMAL money -> integer cents (exact: money has two decimals)."""
    return f"CAST({x} * 100 AS BIGINT)"


def avg_cents(total: str, count: str) -> str:
    """``round(total / count, 2)`` in cents; NULL when count is NULL or <= 0."""
    return (f"(CASE WHEN {count} > 0 THEN "
            f"{half_even_div(money_cents(f'coalesce({total}, 0)'), f'CAST({count} AS BIGINT)')} END)")


def cents_value(c: str) -> str:
    return f"CAST(CAST({c} AS DECIMAL(36,0)) * 0.01 AS {MONEY_TYPE})"


def avg_value(total: str, count: str) -> str:
    """N2 numeric value: the average, or 0.00 when undefined."""
    return f"coalesce({cents_value(avg_cents(total, count))}, CAST(0 AS {MONEY_TYPE}))"


def money(x: str) -> str:
    """Money to cents, NULL -> 0."""
    return f"coalesce(CAST({x} AS {MONEY_TYPE}), CAST(0 AS {MONEY_TYPE}))"


def count0(x: str) -> str:
    """A counter with NULL (or a missing row) read as 0."""
    return f"coalesce(CAST({x} AS BIGINT), CAST(0 AS BIGINT))"


# ---- text renderings of cells --------------------------------------------

def money_cell_daily(x: str) -> str:
    """Daily cell: ``round(x, 2) if x else 0`` — NULL and zero print as ``0``."""
    return f"(CASE WHEN {x} IS NULL OR {x} = 0 THEN '0' ELSE CAST(CAST({x} AS {MONEY_TYPE}) AS STRING) END)"


def money_cell_period(x: str) -> str:
    """Period cell: a missing sum prints ``0``, a present one with two decimals."""
    return f"coalesce(CAST(CAST({x} AS {MONEY_TYPE}) AS STRING), '0')"


def money_diff_cell(x1: str, x2: str) -> str:
    """``round(x2 - x1, 2)``: ``0`` only when both sides are missing."""
    return (f"(CASE WHEN {x1} IS NULL AND {x2} IS NULL THEN '0' ELSE "
            f"CAST(CAST(coalesce({x2}, 0) - coalesce({x1}, 0) AS {MONEY_TYPE}) AS STRING) END)")


def count_cell(x: str) -> str:
    return f"CAST({count0(x)} AS STRING)"


def count_diff_cell(x1: str, x2: str) -> str:
    return f"CAST({count0(x2)} - {count0(x1)} AS STRING)"


def avg_cell(c: str) -> str:
    """Average-price cell from cents: undefined prints ``0``."""
    return f"coalesce(CAST({cents_value(c)} AS STRING), '0')"


def avg_diff_value(c1: str, c2: str) -> str:
    return cents_value(f"(coalesce({c2}, 0) - coalesce({c1}, 0))")


def avg_diff_cell(c1: str, c2: str) -> str:
    return f"(CASE WHEN {c1} IS NULL AND {c2} IS NULL THEN '0' ELSE CAST({avg_diff_value(c1, c2)} AS STRING) END)"


# ---- daily check rates (binary double, as the original formats them) -------

def float_rate(n: str, d: str) -> str:
    """``n / d * 100`` in IEEE double, exactly as a float division computes it."""
    return f"(CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE) * 100.0D)"


def float_rate_tenths(n: str, d: str) -> str:
    """Tenths of ``format(n/d*100, '.1f')``: correct rounding of the double.

    Off an exact tie the double sits on the same side as the exact ratio, so
    exact rounding applies. On an exact tie the exact binary value of the double
    decides, and half-even only if it is the tie itself: with k fraction bits the
    double times 2**k is an integer, which is compared with (2q + 1) / 20 * 2**k.
    """
    n0, d0 = f"CAST(coalesce({n}, 0) AS BIGINT)", f"CAST(coalesce({d}, 0) AS BIGINT)"
    v = f"(CAST({n0} * 1000 AS DECIMAL(20,0)) / CAST({d0} AS DECIMAL(20,0)))"
    qq = f"CAST(floor({v}) AS BIGINT)"
    frac = f"({v} - floor({v}))"
    x = float_rate(n0, d0)

    def side(bits: int) -> str:
        """-1, 0, 1: the double below, on, above the tie; exact where it has at most ``bits`` fraction bits."""
        own = f"CAST(CAST({x} * {float(1 << bits)!r}D AS BIGINT) AS DECIMAL(20,0)) * 20"
        return f"CAST(signum({own} - CAST(2 * {qq} + 1 AS DECIMAL(12,0)) * CAST({1 << bits} AS DECIMAL(18,0))) AS INT)"

    # A double below 32 has up to 57 fraction bits here (ties are 0.05 or more), below 65,536 up to 47, and so on.
    at = f"(CASE WHEN {x} < 32 THEN {side(57)} WHEN {x} < 65536 THEN {side(47)} ELSE {side(36)} END)"
    on_tie = f"(CASE {at} WHEN -1 THEN {qq} WHEN 1 THEN {qq} + 1 ELSE {qq} + {qq} % 2 END)"
    return (f"(CASE WHEN {d0} > 0 THEN CASE WHEN {frac} > 0.5 THEN {qq} + 1 WHEN {frac} < 0.5 THEN {qq} "
            f"ELSE {on_tie} END END)")


def float_rate_text(n: str, d: str) -> str:
    """``12.3%``; an undefined rate prints ``0.0%`` (unlike N3)."""
    t = float_rate_tenths(n, d)
    return f"concat(CAST(coalesce({tenths_value(t)}, CAST(0 AS {RATE_TYPE})) AS STRING), '%')"


def float_rate_at_least(n: str, d: str, threshold: float) -> str:
    """The unrounded double rate against a threshold; an undefined rate fails."""
    d0 = f"coalesce({d}, 0)"
    return (f"(CASE WHEN {d0} > 0 THEN {float_rate(f'coalesce({n}, 0)', d0)} >= {float(threshold)}D "
            f"ELSE false END)")
