"""Fact joins and rollups.

Plan shape at scale:

* each fact input is cut to the report dates *before* the join (the predicate
  is written on every input, so each scan gets its own partition filter);
* facts ⟕ promotion ⟕ stats join on (shop_id, report_date): both joins hash on
  the same keys, so the second reuses the first's partitioning. A store-day key
  is unique in the facts, so even a shop holding a third of all rows is spread
  over many join partitions by date;
* the two-period rollup is ONE conditional aggregate grouped by shop_id with
  map-side partial aggregation: every task ships at most one row per shop.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shoplens.plans.params import Period
from shoplens.sources.tables import ReportTables

# (output name, source alias, source column, kind) — A1's 23 sums, in order.
PERIOD_SUMS: list[tuple[str, str, str, str]] = [
    ("verify_after_discount", "k", "verify_after_discount", "money"),
    ("exposure_users", "k", "exposure_users", "count"),
    ("visit_users", "k", "visit_users", "count"),
    ("order_users", "k", "order_users", "count"),
    ("order_coupon_count", "k", "order_coupon_count", "count"),
    ("verify_users", "k", "verify_person_count", "count"),
    ("verify_coupon_count", "k", "verify_coupon_count", "count"),
    ("order_sale_amount", "k", "order_sale_amount", "money"),
    ("verify_sale_amount", "k", "verify_sale_amount", "money"),
    ("coupon_orders", "k", "coupon_pay_order_count", "count"),
    ("phone_clicks", "p", "view_phone_count", "count"),
    ("promotion_cost", "k", "promotion_cost", "money"),
    ("promotion_exposure", "k", "promotion_exposure_count", "count"),
    ("promotion_clicks", "k", "promotion_click_count", "count"),
    ("promotion_orders", "p", "order_count", "count"),
    ("view_groupbuy", "p", "view_groupbuy_count", "count"),
    ("view_phone", "p", "view_phone_count", "count"),
    ("consult_users", "k", "consult_users", "count"),
    ("address_clicks", "p", "view_address_count", "count"),
    ("new_collect", "k", "new_collect_users", "count"),
    ("new_good_reviews", "k", "new_good_review_count", "count"),
    ("new_reviews", "k", "new_review_count", "count"),
    ("checkin_count", "s", "checkin_count", "count"),
]
SUM_KIND = {name: kind for name, _, _, kind in PERIOD_SUMS}

STORE_COLS = [
    "shop_name", "city", "exposure_users", "visit_users", "order_users", "verify_person_count",
    "order_coupon_count", "verify_coupon_count", "coupon_pay_order_count", "promotion_cost",
    "promotion_exposure_count", "promotion_click_count", "new_good_review_count", "new_review_count",
    "new_collect_users", "consult_users", "intent_rate", "order_sale_amount", "verify_sale_amount",
    "verify_after_discount",
]
PROMO_COLS = ["view_phone_count", "view_address_count", "click_avg_price", "order_count", "view_groupbuy_count"]
STATS_COLS = ["order_user_rank", "verify_amount_rank", "checkin_count", "ad_balance", "ad_order_count",
              "is_force_offline"]


def date_in(col: Column, ranges: Sequence[Period]) -> Column:
    """Inclusive date ranges, OR-ed."""
    cond = None
    for p in ranges:
        c = col.between(F.lit(p.start), F.lit(p.end))
        cond = c if cond is None else (cond | c)
    return cond


def _dedupe(df: DataFrame, cols: list[str]) -> DataFrame:
    """J9 option: one right-side row per key (sums for counters, max otherwise)."""
    if not cols:
        return df.select("shop_id", "report_date").distinct()
    aggs = [F.max(c).alias(c) if c in ("click_avg_price", "ad_balance", "order_user_rank",
                                         "verify_amount_rank", "is_force_offline") else F.sum(c).alias(c) for c in cols]
    return df.groupBy("shop_id", "report_date").agg(*aggs)


def joined_facts(tables: ReportTables, ranges: Sequence[Period], shops: DataFrame | Column | None = None,
                 dedupe_right: bool = False, store_cols: Sequence[str] = tuple(STORE_COLS),
                 promo_cols: Sequence[str] = tuple(PROMO_COLS),
                 stats_cols: Sequence[str] = tuple(STATS_COLS), ad_today: bool = False) -> DataFrame:
    """J1 + J2: store facts ⟕ promotion ⟕ stats on (shop_id, report_date).

    Duplicate keys on the right multiply the left row, as a plain left join
    does (J9); ``dedupe_right=True`` folds them first. ``ad_today`` adds the
    same-day ad count (J8), which is the same on every row of a shop and day.
    """
    from shoplens.operators.dims import apply_shop_filter

    k = (tables.store_daily.where(date_in(F.col("report_date"), ranges))
         .select(F.col("shop_id").cast("string").alias("shop_id"), "report_date", *store_cols))
    k = apply_shop_filter(k, shops)
    p = (tables.promotion_daily.where(date_in(F.col("report_date"), ranges))
         .select(F.col("shop_id").cast("string").alias("shop_id"), "report_date", *promo_cols))
    s = (tables.store_stats.where(date_in(F.col("date"), ranges))
         .select(F.col("store_id").cast("string").alias("shop_id"), F.col("date").alias("report_date"),
                 *stats_cols))
    # The shops limit every input before the join: a literal predicate reaches each scan, a
    # set of shops is a semi join, so that other shops' rows are not shuffled.
    p, s = apply_shop_filter(p, shops), apply_shop_filter(s, shops)
    if dedupe_right:
        p, s = _dedupe(p, list(promo_cols)), _dedupe(s, list(stats_cols))
    if ad_today:
        # One same-day ad figure per shop and day, the greatest of its stats rows; the
        # window needs the rows where the join needs them, so it adds no shuffle.
        s = s.withColumn("ad_today", F.max("ad_order_count").over(W.partitionBy("shop_id", "report_date")))
    return k.join(p, ["shop_id", "report_date"], "left").join(s, ["shop_id", "report_date"], "left")


def _src(name: str) -> Column:
    for out, _, src, _ in PERIOD_SUMS:
        if out == name:
            return F.col(src)
    raise KeyError(name)


@dataclass(frozen=True)
class RollupSpec:
    """A2/A4 options.

    rename='sum_latest' (default): one group per shop over all its names; the
    shown name is the latest one in the period.
    rename='last_group': the original per-(shop, name[, city]) groups, keeping
    one group per shop and period (the greatest name, then city) — its other
    rows are dropped, as the original's keyed dictionary dropped them.

    checked=True: a sum that does not fit its type is NULL instead of an error that ends the
    job, and ``lost`` lists the sums of a shop to which that happened (names like
    ``visit_users_p1``); without it ANSI mode raises.
    """
    rename: str = "sum_latest"
    by_city: bool = False
    checked: bool = False


def period_rollup(joined: DataFrame, p1: Period, p2: Period, spec: RollupSpec = RollupSpec()) -> DataFrame:
    """A1 + A2: both periods in one pass over the facts; periods may overlap.

    Level 1 groups the fact rows by (shop_id, shop_name[, city]) — string keys,
    fixed-width buffers, so it runs as a hash aggregate with map-side partial
    aggregation. Level 2 works on one row per shop and name: it adds the
    groups up (``sum_latest``) or keeps one (``last_group``); only here, on
    small input, is a name chosen by ``max_by``.

    Output: shop_id, has_p1, has_p2, name_p1, name_p2, and ``<metric>_p1`` /
    ``<metric>_p2`` sums (NULL when a period has no row or only NULLs); with
    ``checked`` also ``lost``.
    """
    in1 = F.col("report_date").between(F.lit(p1.start), F.lit(p1.end))
    in2 = F.col("report_date").between(F.lit(p2.start), F.lit(p2.end))
    return flagged_rollup(joined.where(in1 | in2).select(
        "shop_id", F.col("report_date").alias("last"), "shop_name", "city", in1.alias("_in1"), in2.alias("_in2"), *metric_columns()), spec)


def metric_columns() -> list[Column]:
    """The 23 figures of the joined facts under their report names."""
    return [_src(m).alias(m) for m, *_ in PERIOD_SUMS]


def flagged_rollup(src: DataFrame, spec: RollupSpec = RollupSpec()) -> DataFrame:
    """``period_rollup`` over rows that say in which periods they count (``_in1``, ``_in2``) and their ``last`` day:
    single days, or sums of a name over several days."""
    if spec.rename not in ("sum_latest", "last_group"):
        raise ValueError(f"rename must be 'sum_latest' or 'last_group', not {spec.rename!r}")
    if spec.by_city and spec.rename != "last_group":
        raise ValueError("by_city groups by (shop, name, city) and needs rename='last_group'")
    names = [m for m, *_ in PERIOD_SUMS]
    total = "try_sum" if spec.checked else "sum"
    periods = (("_in1", "_p1"), ("_in2", "_p2"))
    seen = lost = []
    if spec.checked:
        # One bit per metric: which sums have had a value, so that a NULL among those is an overflow.
        src = src.withColumn("_bits", F.expr(_bits(f"{m} IS NOT NULL" for m in names)))
        seen = [F.expr(f"bit_or(CASE WHEN {flag} THEN _bits ELSE 0L END) AS _seen{sfx}") for flag, sfx in periods]
    keys = ["shop_id", "shop_name"] + (["city"] if spec.by_city else [])
    groups = src.groupBy(*keys).agg(
        F.expr("bool_or(_in1) AS has_p1"), F.expr("bool_or(_in2) AS has_p2"),
        F.expr("max(CASE WHEN _in1 THEN last END) AS last_p1"),
        F.expr("max(CASE WHEN _in2 THEN last END) AS last_p2"),
        *[F.expr(f"{total}(CASE WHEN {flag} THEN {m} END) AS {m}{sfx}") for flag, sfx in periods for m in names], *seen)
    if spec.checked:
        groups = _with_lost(groups, names)
    flags = [F.expr("bool_or(has_p1) AS has_p1"), F.expr("bool_or(has_p2) AS has_p2")]

    if spec.rename == "sum_latest":
        if spec.checked:
            lost = [F.expr(f"bit_or({c}{sfx}) AS {c}{sfx}") for _, sfx in periods for c in ("_seen", "_lost")]
        out = groups.groupBy("shop_id").agg(
            *flags,
            F.expr("max_by(shop_name, last_p1) AS name_p1"),
            F.expr("max_by(shop_name, last_p2) AS name_p2"),
            *[F.expr(f"{total}({m}{sfx}) AS {m}{sfx}") for sfx in ("_p1", "_p2") for m in names], *lost)
        return _lost_named(_with_lost(out, names), names) if spec.checked else out

    order = "struct(" + ", ".join(keys[1:]) + ")"
    extra = ["_lost"] if spec.checked else []

    def pick(flag: str, suffix: str) -> Column:
        vals = ", ".join(["shop_name AS name"] + [f"{m}{suffix} AS {m}" for m in [*names, *extra]])
        return F.expr(f"max_by(struct({vals}), CASE WHEN {flag} THEN {order} END) AS g{suffix}")

    picked = groups.groupBy("shop_id").agg(*flags, pick("has_p1", "_p1"), pick("has_p2", "_p2"))
    out = picked.selectExpr(
        "shop_id", "has_p1", "has_p2", "g_p1.name AS name_p1", "g_p2.name AS name_p2",
        *[f"g{sfx}.{m} AS {m}{sfx}" for sfx in ("_p1", "_p2") for m in [*names, *extra]])
    return _lost_named(out, names) if spec.checked else out


def _bits(conditions) -> str:
    """A long with bit i set where the i-th condition holds."""
    return " | ".join(f"(CASE WHEN {c} THEN {1 << i}L ELSE 0L END)" for i, c in enumerate(conditions))


def _with_lost(groups: DataFrame, names: Sequence[str]) -> DataFrame:
    """``_lost_p1``, ``_lost_p2``: the sums that overflowed here or in a part; those are NULL."""
    for sfx in ("_p1", "_p2"):
        have = f"_lost{sfx}" if f"_lost{sfx}" in groups.columns else "0L"
        now = _bits(f"{m}{sfx} IS NULL" for m in names)
        groups = groups.withColumn(f"_lost{sfx}", F.expr(f"{have} | (_seen{sfx} & ({now}))"))
        groups = groups.withColumns({f"{m}{sfx}": F.expr(f"CASE WHEN _lost{sfx} & {1 << i}L = 0 THEN {m}{sfx} END") for i, m in enumerate(names)})
    return groups


def _lost_named(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    cases = ", ".join(f"CASE WHEN coalesce(_lost{sfx}, 0L) & {1 << i}L <> 0 THEN '{m}{sfx}' END" for sfx in ("_p1", "_p2") for i, m in enumerate(names))
    return rows.withColumn("lost", F.expr(f"array_compact(array({cases}))")).drop("_seen_p1", "_seen_p2", "_lost_p1", "_lost_p2")


def trailing_sum(df: DataFrame, value_col: str, report: Period, days: int = 7,
                 key: str = "shop_id", date_col: str = "report_date", out: str | None = None,
                 wanted: DataFrame | None = None) -> DataFrame:
    """Per key and report day d in ``report``, the sum over [d-days+1, d].

    One report day is one plain aggregate by key. For a range the rows are first
    summed by (key, day), combined before the shuffle, then a RANGE window adds up
    each key's days; a key has at most as many rows there as the range and the
    lookback have days, and about one row per input row is shuffled. Days without
    an input row get a sum only where ``wanted`` (key, day) lists them.
    """
    out = out or f"{value_col}_{days}d"
    lo = F.date_sub(F.lit(report.start), days - 1)
    rows = (df.where(F.col(date_col).between(lo, F.lit(report.end)))
            .select(F.col(key).cast("string").alias(key), date_col, value_col))
    if report.start == report.end:
        return rows.groupBy(key).agg(F.sum(value_col).alias(out)).select(key, F.lit(report.start).alias(date_col), out)
    if wanted is not None:
        rows = rows.unionByName(wanted.select(key, date_col, F.lit(None).cast(dict(rows.dtypes)[value_col]).alias(value_col)))
    daily = rows.groupBy(key, date_col).agg(F.sum(value_col).alias("_day"))
    span = W.partitionBy(key).orderBy(F.datediff(F.col(date_col), F.lit("1970-01-01"))).rangeBetween(-(days - 1), 0)
    return (daily.select(key, date_col, F.sum("_day").over(span).alias(out))
            .where(F.col(date_col).between(F.lit(report.start), F.lit(report.end))))


def trailing_sum_window(df: DataFrame, value_col: str, report: Period, days: int = 7,
                        key: str = "shop_id", date_col: str = "report_date") -> DataFrame:
    """W3 as a RANGE window (one row per key-day must hold): reference form for tests."""
    day_no = F.datediff(F.col(date_col), F.lit("1970-01-01"))
    w = W.partitionBy(key).orderBy(day_no).rangeBetween(-(days - 1), 0)
    lo = F.date_sub(F.lit(report.start), days - 1)
    return (df.where(F.col(date_col).between(lo, F.lit(report.end)))
            .select(key, date_col, F.sum(value_col).over(w).alias(f"{value_col}_{days}d"))
            .where(F.col(date_col).between(F.lit(report.start), F.lit(report.end))))
