"""Data quality (Q1, Q2, A10).

* ``validate`` (Q1) marks every store-day row with the rules it breaks, so a
  report can go on with the good rows and keep the rejected ones, with their
  reasons, beside it — the original quarantined a failing shop and continued.
* ``default_profile`` (Q2, A10) lists, per shop and period, each summed metric
  that took the default 0 because the period had no row or the sum was NULL —
  the original printed these as debug lines.

* ``arithmetic_errors`` (Q1) names every figure of a shop that can't be computed, so
  that one shop's overflow fails that shop and not the report.

* ``row_profile`` (A10) describes the joined rows of every shop column by column: type, rows, NULLs,
  defaults, least and greatest value — the original printed a row's values and types.

All are single projections (plus one aggregate for duplicate keys); nothing is
collected to the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.operators.facts import PERIOD_SUMS, PROMO_COLS, STATS_COLS, STORE_COLS, date_in, joined_facts
from shoplens.operators.layout import S, unpivot_rows
from shoplens.plans.params import Period
from shoplens.sources.tables import ReportTables

COUNTERS = ["exposure_users", "visit_users", "order_users", "verify_person_count", "order_coupon_count",
            "verify_coupon_count", "coupon_pay_order_count", "promotion_exposure_count", "promotion_click_count",
            "new_good_review_count", "new_review_count", "new_collect_users", "consult_users"]
MONEY = ["promotion_cost", "order_sale_amount", "verify_sale_amount", "verify_after_discount"]
_LARGEST = "9223372036854775807"       # of a bigint
RATE_TEXT = r"^[0-9]+(\.[0-9]+)?%$"


def validate(tables: ReportTables, ranges: Sequence[Period]) -> DataFrame:
    """Q1: every store-day row in ``ranges``, or without a date, with ``status`` ok/rejected and ``errors``.

    Rules: key present; counters and money not negative; ``intent_rate`` text
    like ``12%``; at most one promotion row and one stats row per store-day
    (more would multiply the row's sums in the report join).
    """
    # A row without a date belongs to no range; it is checked, and rejected, with every one.
    k = tables.store_daily.where(date_in(F.col("report_date"), ranges) | F.col("report_date").isNull()).withColumn(
        "shop_id", F.col("shop_id").cast("string"))
    dup_p = (tables.promotion_daily.where(date_in(F.col("report_date"), ranges))
             .groupBy(F.col("shop_id").cast("string").alias("shop_id"), "report_date")
             .agg(F.count(F.lit(1)).alias("_np")))
    dup_s = (tables.store_stats.where(date_in(F.col("date"), ranges))
             .groupBy(F.col("store_id").cast("string").alias("shop_id"), F.col("date").alias("report_date"))
             .agg(F.count(F.lit(1)).alias("_ns")))
    j = k.join(dup_p, ["shop_id", "report_date"], "left").join(dup_s, ["shop_id", "report_date"], "left")
    checks = ["CASE WHEN shop_id IS NULL OR shop_id = '' THEN 'missing shop_id' END",
              "CASE WHEN report_date IS NULL THEN 'missing report_date' END"]
    checks += [f"CASE WHEN {c} < 0 THEN 'negative {c}' END" for c in COUNTERS + MONEY]
    checks += [f"CASE WHEN intent_rate IS NOT NULL AND intent_rate <> '' AND NOT regexp_like(intent_rate, "
               f"'{RATE_TEXT.replace(chr(92), chr(92) * 2)}') THEN 'bad intent_rate' END",
               "CASE WHEN _np > 1 THEN 'duplicate promotion rows' END",
               "CASE WHEN _ns > 1 THEN 'duplicate stats rows' END"]
    errors = "concat_ws('; ', " + ", ".join(checks) + ")"
    return j.selectExpr("shop_id", "report_date", f"{errors} AS errors").selectExpr(
        "shop_id", "report_date", "CASE WHEN errors = '' THEN 'ok' ELSE 'rejected' END AS status", "errors")


def split_valid(tables: ReportTables, ranges: Sequence[Period]) -> tuple[DataFrame, DataFrame]:
    """Q1 as two tables: store-day rows that pass, and rejected keys with reasons."""
    v = validate(tables, ranges)
    k = tables.store_daily.where(date_in(F.col("report_date"), ranges)).withColumn(
        "shop_id", F.col("shop_id").cast("string"))
    good = k.join(v.where("status = 'ok'").select("shop_id", "report_date"), ["shop_id", "report_date"],
                  "left_semi")
    return good, v.where("status = 'rejected'")


def arithmetic_errors(rates: Mapping[str, tuple[str, str]], averages: Mapping[str, tuple[str, str]]) -> str:
    """SQL text over a checked rollup: what overflows in a shop's figures, joined by ``; ``, or NULL.

    Sums come from ``lost``; a rate multiplies its numerator by 1000, an average its total by 100, and every
    difference must fit the type of its sides.
    """
    errors = ["nullif(array_join(transform(lost, x -> concat('overflow in ', x)), '; '), '')"]
    for name, (n, den) in rates.items():
        for sfx in ("_p1", "_p2"):
            errors.append(f"CASE WHEN {den}{sfx} > 0 AND try_multiply({n}{sfx}, 1000L) IS NULL AND {n}{sfx} IS NOT NULL THEN 'overflow in {name}{sfx}' END")
        a, b = f"coalesce({n}_p1, 0L)", f"coalesce({n}_p2, 0L)"
        wide = f"abs(CAST({a} AS DECIMAL(38,0))) + abs(CAST({b} AS DECIMAL(38,0)))"
        errors.append(f"CASE WHEN {den}_p1 > 0 AND {den}_p2 > 0 AND signum({a}) * signum({b}) < 0 AND ({wide}) * 1000 > {_LARGEST} THEN 'overflow in {name}_delta' END")
    for name, (t, n) in averages.items():
        errors += [f"CASE WHEN {n}{sfx} > 0 AND abs({t}{sfx}) * 100 > {_LARGEST} THEN 'overflow in {name}{sfx}' END" for sfx in ("_p1", "_p2")]
    for name, _, _, kind in PERIOD_SUMS:
        if kind == "count":
            errors.append(f"CASE WHEN try_subtract(coalesce({name}_p2, 0L), coalesce({name}_p1, 0L)) IS NULL THEN 'overflow in {name}_delta' END")
    return "nullif(concat_ws('; ', " + ", ".join(errors) + "), '')"


def default_profile(period_base: DataFrame) -> DataFrame:
    """Q2/A10: (shop_id, seq, period, metric, reason) for every defaulted sum."""
    rows = []
    for sfx, period, has in (("_p1", "p1", "has_p1"), ("_p2", "p2", "has_p2")):
        for name, *_ in PERIOD_SUMS:
            reason = (f"CASE WHEN NOT coalesce({has}, false) THEN 'row missing' "
                      f"WHEN {name}{sfx} IS NULL THEN 'null' ELSE '' END")
            rows.append([period, name, S(reason)])
    out = unpivot_rows(period_base, ["shop_id", "seq"], rows, ["period", "metric", "reason"])
    return out.where("reason <> ''").drop("row_no")


#: Columns of the joined rows that ``row_profile`` describes.
PROFILED = ["report_date", *STORE_COLS, *PROMO_COLS, *STATS_COLS]


def row_profile(tables: ReportTables, ranges: Sequence[Period], shops=None, columns: Sequence[str] = tuple(PROFILED)) -> DataFrame:
    """A10: (shop_id, field, data_type, n_rows, n_null, n_default, least, greatest) over the joined rows of ``ranges``.

    A default is 0 of a number and '' of a text; least and greatest are printed as text and leave NULLs out.
    One aggregate by shop holds four figures of every column side by side and combines before its
    shuffle; only its one row per shop is laid out by column. NULL shop ids are described as one shop.
    """
    rows = joined_facts(tables, ranges, shops=shops).select("shop_id", *columns)
    types = dict(rows.dtypes)
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for c in columns:
        default = F.col(c) == ("" if types[c] == "string" else 0) if types[c] != "date" else F.lit(False)
        aggs += [F.count_if(F.col(c).isNull()).alias(f"_null_{c}"), F.count_if(default).alias(f"_default_{c}"),
                 F.min(c).alias(f"_least_{c}"), F.max(c).alias(f"_greatest_{c}")]
    lines = [[c, types[c], S(f"_least_{c}"), S(f"_greatest_{c}"), S("_rows"), S(f"_null_{c}"), S(f"_default_{c}")] for c in columns]
    out = unpivot_rows(rows.groupBy("shop_id").agg(*aggs), ["shop_id"], lines, ["field", "data_type", "least", "greatest"],
                       flags=[("n_rows", "bigint"), ("n_null", "bigint"), ("n_default", "bigint")])
    known = F.col("n_null") < F.col("n_rows")
    return out.select("shop_id", "field", "data_type", "n_rows", "n_null", "n_default", *[F.when(known, F.col(c)).alias(c) for c in ("least", "greatest")])
