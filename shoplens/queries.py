"""Registered report queries over the driver tables, and their oracle SQL.

Each query is a function of the report inputs (``ReportTables``). ``queries()``
binds them to ``(spark, sf_dir)``: the inputs are then the fixture views over the
whole driver tables in ``sf_dir``; ``table_queries()`` runs them on any other
inputs (stored tables, a catalog, JDBC). Parameters follow
FIXTURES.md §4: events span 2024-01-01..2024-01-30; daily date 2024-01-10;
weekly 01-01..07 vs 01-08..14; monthly stand-in 01-01..15 vs 01-16..30.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shoplens import oracle as O
from shoplens.operators.blocks import BlockRollup
from shoplens.operators.dims import region_dim, resolved_shops, shop_dim
from shoplens.operators.quality import row_profile, validate
from shoplens.plans.daily import daily_report
from shoplens.plans.params import Period
from shoplens.plans.period import period_report
from shoplens.session import ensure_checkpoint_dir
from shoplens.sources.fixtures import with_variant
from shoplens.sources.tables import ReportTables

W1 = Period.of("2024-01-01", "2024-01-07")
W2 = Period.of("2024-01-08", "2024-01-14")
M1 = Period.of("2024-01-01", "2024-01-15")
M2 = Period.of("2024-01-16", "2024-01-30")
OVERLAP1 = Period.of("2024-01-01", "2024-01-10")
OVERLAP2 = Period.of("2024-01-05", "2024-01-14")
ONE1 = Period.of("2024-01-10", "2024-01-10")
ONE2 = Period.of("2024-01-11", "2024-01-11")
ACCOUNTS = ["acct_1", "acct_7", "acct_12"]       # acct_7 holds unparsable stores_json
ONE_SHOP = "17"
SHOP_LIST = ["3", "5", "8", "13", "21", "34", "55", "89", "144"]

QueryFn = Callable[[SparkSession, str], DataFrame]
TablesFn = Callable[[ReportTables], DataFrame]
_QUERIES: dict[str, TablesFn] = {}
_ORACLE: dict[str, Callable[[], str]] = {}


def register(name: str, oracle: Callable[[], str] | None = None):
    """Register a report query written as a function of the input tables."""
    def deco(fn: TablesFn) -> TablesFn:
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLE[name] = oracle
        return fn
    return deco


def tables(spark: SparkSession, sf_dir: str) -> ReportTables:
    """The report inputs derived from the whole driver tables in ``sf_dir``."""
    return ReportTables.from_driver_tables(spark, sf_dir)


# ---- period reports ------------------------------------------------------------

def _period_oracle(select, p1, p2, **kw):
    return lambda: O.period_base_sql(p1, p2, **kw) + select(p1, p2)


@register("weekly_wide", _period_oracle(O.wide_select, W1, W2))
def weekly_wide(t):
    return period_report(t, W1, W2).wide


@register("weekly_rows8", _period_oracle(O.rows8_select, W1, W2))
def weekly_rows8(t):
    return period_report(t, W1, W2).rows8


@register("period_detail31", _period_oracle(O.detail31_select, W1, W2))
def period_detail31(t):
    return period_report(t, W1, W2).detail31


@register("trend_flags", _period_oracle(lambda a, b: O.trend_select(), W1, W2))
def trend_flags(t):
    return period_report(t, W1, W2).trend


@register("monthly_rows8", _period_oracle(O.rows8_select, M1, M2))
def monthly_rows8(t):
    return period_report(t, M1, M2).rows8


@register("weekly_by_account", _period_oracle(O.wide_select, W1, W2, accounts=ACCOUNTS))
def weekly_by_account(t):
    return period_report(t, W1, W2, accounts=ACCOUNTS).wide


@register("custom_one_shop", _period_oracle(O.wide_select, W1, W2, accounts=["acct_1"], shop_id=ONE_SHOP))
def custom_one_shop(t):
    return period_report(t, W1, W2, accounts=["acct_1"], shop_id=ONE_SHOP).wide


@register("custom_shop_list", _period_oracle(O.wide_select, W1, W2, shop_ids=SHOP_LIST))
def custom_shop_list(t):
    return period_report(t, W1, W2, shop_ids=SHOP_LIST).wide


@register("custom_overlap", _period_oracle(O.wide_select, OVERLAP1, OVERLAP2))
def custom_overlap(t):
    return period_report(t, OVERLAP1, OVERLAP2).wide


@register("custom_overlap_blocks", _period_oracle(O.wide_select, OVERLAP1, OVERLAP2))
def custom_overlap_blocks(t):
    """Overlapping periods from a stored block rollup of all their days."""
    spark = t.store_daily.sparkSession
    blocks = BlockRollup(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/blocks-{uuid.uuid4().hex}", levels=4)
    blocks.build(t, Period(min(OVERLAP1.start, OVERLAP2.start), max(OVERLAP1.end, OVERLAP2.end)))
    return period_report(t, OVERLAP1, OVERLAP2, blocks=blocks).wide


@register("custom_one_sided", _period_oracle(O.wide_select, ONE1, ONE2))
def custom_one_sided(t):
    return period_report(t, ONE1, ONE2).wide


@register("rename_last_group", _period_oracle(O.wide_select, W1, W2, rename="last_group"))
def rename_last_group(t):
    return period_report(t, W1, W2, rename="last_group").wide


@register("custom_city", _period_oracle(O.rows8_select, W1, W2, rename="last_group", by_city=True))
def custom_city(t):
    return period_report(t, W1, W2, rename="last_group", by_city=True).rows8


@register("weekly_rows16_legacy", _period_oracle(O.rows16_select, W1, W2))
def weekly_rows16_legacy(t):
    return period_report(t, W1, W2).rows8_legacy


@register("weekly_unresolved_none", _period_oracle(O.wide_select, W1, W2, accounts=["acct_7"]))
def weekly_unresolved_none(t):
    return period_report(t, W1, W2, accounts=["acct_7"]).wide


@register("weekly_unresolved_all", _period_oracle(O.wide_select, W1, W2, accounts=["acct_7"], unresolved="all"))
def weekly_unresolved_all(t):
    return period_report(t, W1, W2, accounts=["acct_7"], unresolved="all").wide


@register("custom_empty_list", _period_oracle(O.wide_select, W1, W2, shop_ids=[]))
def custom_empty_list(t):
    return period_report(t, W1, W2, shop_ids=[]).wide


@register("section_names_period", _period_oracle(lambda a, b: O.sections_period_select(), W1, W2))
def section_names_period(t):
    return period_report(t, W1, W2).sections


@register("weekly_fanout", _period_oracle(O.wide_select, W1, W2, variant="stats_duplicates"))
def weekly_fanout(t):
    """A second stats row of a store-day multiplies its sums, as a plain left join does."""
    return period_report(with_variant(t, "stats_duplicates"), W1, W2).wide


@register("weekly_dedupe", _period_oracle(O.detail31_select, W1, W2, variant="stats_duplicates", dedupe=True))
def weekly_dedupe(t):
    """J9 option: duplicate right-side rows are folded before the join."""
    return period_report(with_variant(t, "stats_duplicates"), W1, W2, dedupe_right=True).detail31


@register("weekly_quarantine", _period_oracle(O.wide_select, W1, W2, variant="null_dates", quarantine=True))
def weekly_quarantine(t):
    """Q1: shops with a rejected store-day are left out, the others go on."""
    return period_report(with_variant(t, "null_dates"), W1, W2, quarantine=True).wide


@register("quarantine_null_shop", _period_oracle(O.wide_select, W1, W2, variant="null_shops", quarantine=True))
def quarantine_null_shop(t):
    """Q1: store-days without a shop id are rejected, and no shop without an id is reported."""
    return period_report(with_variant(t, "null_shops"), W1, W2, quarantine=True).wide


@register("quarantine_overflow", _period_oracle(O.wide_select, W1, W2, variant="large_counters", quarantine=True))
def quarantine_overflow(t):
    """Q1: a shop whose figures overflow is left out, the others go on."""
    return period_report(with_variant(t, "large_counters"), W1, W2, quarantine=True).wide


@register("quarantine_failed", lambda: O.failed_sql(W1, W2, "large_counters"))
def quarantine_failed(t):
    """Q1: the shops left out, with their errors and both periods' sums."""
    return period_report(with_variant(t, "large_counters"), W1, W2, quarantine=True).failed


@register("custom_empty_id", _period_oracle(O.wide_select, W1, W2, shop_id=""))
def custom_empty_id(t):
    """P5: the empty shop id names no shop."""
    return period_report(t, W1, W2, shop_id="").wide


@register("section_names_clash", _period_oracle(lambda a, b: O.sections_period_select(), W1, W2, variant="name_clashes"))
def section_names_clash(t):
    """Names that meet the numbered forms of others, in any case, stay distinct."""
    return period_report(with_variant(t, "name_clashes"), W1, W2).sections


# ---- dimensions ------------------------------------------------------------------

@register("shop_dim", lambda: O.shop_dim_select())
def shop_dim_q(t):
    return shop_dim(t)


@register("shop_dim_null_accounts", lambda: O.shop_dim_select(variant="null_accounts"))
def shop_dim_null_accounts(t):
    """Accounts without a shop list give no shops."""
    return shop_dim(with_variant(t, "null_accounts"))


@register("region_dim", lambda: O.region_dim_select())
def region_dim_q(t):
    return region_dim(t)


@register("accounts_filter", lambda: O.accounts_filter_select(ACCOUNTS))
def accounts_filter(t):
    return resolved_shops(t, ACCOUNTS)


# ---- daily reports -------------------------------------------------------------

DAY = "2024-01-10"
DAY_RANGE = Period.of("2024-01-08", "2024-01-14")


def _daily_oracle(select, start=DAY, end=DAY, accounts=None, variant=None):
    return lambda: O.daily_base_sql(start, end, accounts, variant) + select()


@register("daily_summary", _daily_oracle(O.daily_summary_select))
def daily_summary(t):
    return daily_report(t, DAY).summary


@register("daily_detail", _daily_oracle(O.daily_detail_select))
def daily_detail(t):
    return daily_report(t, DAY).detail


@register("daily_detail_legacy", _daily_oracle(lambda: O.daily_detail_select(legacy=True)))
def daily_detail_legacy(t):
    return daily_report(t, DAY, legacy=True).detail


@register("daily_checks", _daily_oracle(O.daily_checks_select))
def daily_checks(t):
    return daily_report(t, DAY).checks


@register("coupon_7d", _daily_oracle(O.coupon_7d_select))
def coupon_7d(t):
    return daily_report(t, DAY).coupon_7d


@register("ad_7d", _daily_oracle(O.ad_7d_select))
def ad_7d(t):
    return daily_report(t, DAY).ad_orders_7d(t)


@register("rank_labels", _daily_oracle(O.rank_labels_select))
def rank_labels(t):
    return daily_report(t, DAY).ranks


@register("section_names", _daily_oracle(O.section_names_select))
def section_names(t):
    return daily_report(t, DAY).sections


@register("section_names_daily_clash", _daily_oracle(O.section_names_select, DAY_RANGE.start, DAY_RANGE.end, variant="name_clashes"))
def section_names_daily_clash(t):
    """W2 per date: colliding names over a range of report days."""
    return daily_report(with_variant(t, "name_clashes"), DAY_RANGE).sections


@register("daily_by_account", _daily_oracle(O.daily_summary_select, accounts=ACCOUNTS))
def daily_by_account(t):
    return daily_report(t, DAY, accounts=ACCOUNTS).summary


@register("daily_range", _daily_oracle(O.daily_summary_select, DAY_RANGE.start, DAY_RANGE.end))
def daily_range(t):
    return daily_report(t, DAY_RANGE).summary


@register("store_count", lambda: O.store_count_sql(DAY, W1, W2))
def store_count(t):
    daily = daily_report(t, DAY).shop_count.withColumnRenamed("store_count", "daily_stores")
    period = period_report(t, W1, W2).shop_count.withColumnRenamed("store_count", "period_stores")
    return (daily.unionByName(period, allowMissingColumns=True)
            .selectExpr("max(daily_stores) AS daily_stores", "max(period_stores) AS period_stores"))


# ---- data quality ----------------------------------------------------------------

@register("null_profile", _period_oracle(lambda a, b: O.default_profile_select(), W1, W2))
def null_profile(t):
    return period_report(t, W1, W2).defaults


@register("row_profile", lambda: O.row_profile_sql([W1, W2]))
def row_profile_q(t):
    """A10: type, NULLs, defaults and range of every column of a shop's rows."""
    return row_profile(t, [W1, W2])


@register("quarantine", lambda: O.validate_sql([W1, W2]))
def quarantine(t):
    return validate(t, [W1, W2])


@register("quarantine_dates", lambda: O.validate_sql([W1, W2], "null_dates"))
def quarantine_dates(t):
    return validate(with_variant(t, "null_dates"), [W1, W2])


@register("ad_today_duplicates", _daily_oracle(O.daily_checks_select, variant="stats_duplicates"))
def ad_today_duplicates(t):
    """One same-day ad figure per shop, also where a shop-day has two stats rows."""
    return daily_report(with_variant(t, "stats_duplicates"), DAY).checks


@register("rate_ties", _daily_oracle(O.daily_checks_select, variant="rate_ties"))
def rate_ties(t):
    """N8 on ratios that lie exactly between two printed tenths."""
    return daily_report(with_variant(t, "rate_ties"), DAY).checks


def table_queries() -> dict[str, TablesFn]:
    """Registered queries as functions of a ``ReportTables`` bundle."""
    return dict(_QUERIES)


def queries() -> dict[str, QueryFn]:
    """Registered queries as ``(spark, sf_dir) -> DataFrame`` over the driver tables."""
    def bind(fn: TablesFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tables(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        return run
    return {name: bind(fn) for name, fn in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: fn() for name, fn in _ORACLE.items()}
