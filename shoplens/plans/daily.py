"""Daily report (R1) and a batch of daily reports over a date range.

Plan: store facts ⟕ promotion ⟕ stats for the report date(s) (P1) → trailing
7-day coupon totals (W3, one distributed aggregate instead of one query per
shop) → shop attributes and regions (J4, J5) → running number per date (W1)
and sheet names (T5, W2) → summary (L1), 39-line detail (L2), checks (N8, N9).

The same-day ad count (J8) comes from the stats rows that are joined anyway, not
from a second lookup per shop: the greatest of a shop and day, so that shop-days
with several stats rows show one figure.

The rows are evaluated once, when an output that shows a number (summary, detail, sections) is
first asked for: they are written in the session's shared folder, and numbers, names and those
outputs come from that copy. Checks, ranks and totals read the stored rows if there are any and the plain
ones otherwise. Building a report runs no job. Several rows of a shop and day (fan-out) are numbered in the
order of all their columns.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.functions import labels as L
from shoplens.functions import metrics as M
from shoplens.functions import texts as X
from shoplens.operators.dims import Accounts, apply_shop_filter, given, region_dim, shop_dim, shop_filter
from shoplens.operators.facts import joined_facts, trailing_sum
from shoplens.operators.layout import S, unpivot_rows
from shoplens.operators.names import unique_names
from shoplens.operators.ranks import numbered, stored
from shoplens.plans.params import Period, as_period

# Thresholds of the four daily checks (N9). FIXED VALUES.
REVIEW_RATE_MIN = 30
COLLECT_RATE_MIN = 40
COUPON_7D_MIN = 10
AD_TODAY_MIN = 1
TRAILING_DAYS = 7


@dataclass
class DailyReport:
    rows: DataFrame            # one row per (report_date, shop row) with its inputs, not numbered
    dates: Period
    options: dict = field(default_factory=dict)

    @cached_property
    def kept(self) -> DataFrame:
        """The rows, evaluated once and stored."""
        return stored(self.rows, "daily-rows")

    @cached_property
    def row_count(self) -> int:
        return self.kept.count()

    @property
    def plain(self) -> DataFrame:
        """The rows for outputs without a number: the stored ones if they were made."""
        return self.__dict__.get("kept", self.rows)

    @cached_property
    def base(self) -> DataFrame:
        """The stored rows with ``seq`` per date."""
        order = ["shop_id", *[c for c in self.rows.columns if c not in ("shop_id", "report_date")]]
        return numbered(self.kept, order, ["report_date"], "seq", count=self.row_count).withColumn("seq", F.col("seq").cast("int"))

    @cached_property
    def named(self) -> DataFrame:
        """The rows with ``seq`` per date and the unique ``sheet_name``, for the outputs that show it."""
        return unique_names(self.base, "clean_name", ["report_date"], count=self.row_count)

    @cached_property
    def summary(self) -> DataFrame:
        """L1: one row per shop and date, the 23 summary columns plus keys."""
        return self.base.selectExpr(
            "report_date", "shop_id",
            f"{L.weekday_name('report_date')} AS weekday",
            f"{L.date_label('report_date')} AS date_label",
            "seq", "operator", "city", "sales", "shop_name",
            f"{M.count0('exposure_users')} AS exposure_users",
            f"{M.count0('visit_users')} AS visit_users",
            f"{M.count0('order_users')} AS order_users",
            f"{M.count0('verify_person_count')} AS verify_users",
            f"{M.count0('order_coupon_count')} AS order_coupon_count",
            f"{M.count0('verify_coupon_count')} AS verify_coupon_count",
            f"{M.count0('view_phone_count')} AS phone_clicks",
            f"{M.count0('view_address_count')} AS address_clicks",
            f"{M.money('promotion_cost')} AS promotion_cost",
            f"{M.count0('new_good_review_count')} AS new_good_review_count",
            f"{L.text_or('intent_rate', '0%')} AS intent_rate",
            f"{M.money('order_sale_amount')} AS order_sale_amount",
            f"{M.money('verify_sale_amount')} AS verify_sale_amount",
            f"{M.money('verify_after_discount')} AS verify_after_discount",
            f"{L.rank_label('order_user_rank')} AS order_rank_label",
            f"{L.rank_label('verify_amount_rank')} AS verify_rank_label",
        )

    @cached_property
    def checks(self) -> DataFrame:
        """The four pass/fail checks per shop and date."""
        return self.plain.selectExpr(
            "report_date", "shop_id",
            f"{REVIEW_RATE} AS review_rate", f"{REVIEW_OK} AS review_pass",
            f"{COLLECT_RATE} AS collect_rate", f"{COLLECT_OK} AS collect_pass",
            "coupon_orders_7d", f"{COUPON_OK} AS coupon_pass",
            "ad_today", f"{L.ad_text('ad_today')} AS ad_text", f"{AD_OK} AS ad_pass",
        )

    @cached_property
    def ranks(self) -> DataFrame:
        """Summary and detail rank labels with the region path."""
        return self.plain.selectExpr(
            "report_date", "shop_id",
            f"{L.rank_label('order_user_rank')} AS order_rank_label",
            f"{L.rank_label('verify_amount_rank')} AS verify_rank_label",
            "region_path",
            f"{L.rank_label_region('region_path', 'order_user_rank')} AS order_rank_detail",
            f"{L.rank_label_region('region_path', 'verify_amount_rank')} AS verify_rank_detail",
        )

    @cached_property
    def sections(self) -> DataFrame:
        """T5 + W2: the cleaned name and the unique sheet name per shop and date."""
        return self.named.select("report_date", "shop_id", "seq", "clean_name", "sheet_name")

    @cached_property
    def coupon_7d(self) -> DataFrame:
        """A5: 7-day coupon-code order total per shop and date."""
        return self.plain.select("report_date", "shop_id", "coupon_orders_7d")

    def ad_orders_7d(self, tables) -> DataFrame:
        """7-day ad-order total from the stats table, per shop and date."""
        stats = tables.store_stats.select(F.col("store_id").cast("string").alias("shop_id"),
                                          F.col("date").alias("report_date"), "ad_order_count")
        stats = apply_shop_filter(stats, self.options.get("shops"))
        own = self.plain.select("report_date", "shop_id")
        sums = trailing_sum(stats, "ad_order_count", self.dates, days=TRAILING_DAYS, out="_ad7", wanted=own)
        return (own.join(sums, ["shop_id", "report_date"], "left")
                .selectExpr("report_date", "shop_id", f"{M.count0('_ad7')} AS ad_orders_7d"))

    @cached_property
    def detail(self) -> DataFrame:
        """L2: 39 lines x 3 cells per shop and date (cells as text)."""

        def line(a, b="", c="", section=False, check=None, alert=None):
            return [a, b, c, section, check, alert]

        def count(label, col):
            return line(label, S(M.count_cell(col)))

        def money(label, col):
            return line(label, S(M.money_cell_daily(col)))

        blank = line("")
        legacy = self.options.get("legacy", False)
        rows = [
            line(S("shop_name"), S(L.status_message("is_force_offline", legacy)),
                 alert=S("coalesce(is_force_offline, 0) > 0")),
            line(X.DAILY_TITLE, S(f"concat({L.lit(X.DAILY_DATE_PREFIX + '(')}, {L.date_short('report_date')}, ')')")),
            line(X.SECTION_FUNNEL, section=True),
            count(X.LABEL_EXPOSURE, "exposure_users"),
            count(X.LABEL_VISIT, "visit_users"),
            count(X.LABEL_ORDER_USERS, "order_users"),
            count(X.LABEL_ORDER_COUPONS, "order_coupon_count"),
            count(X.LABEL_VERIFY_USERS, "verify_person_count"),
            count(X.LABEL_VERIFY_COUPONS, "verify_coupon_count"),
            count(X.LABEL_PHONE, "view_phone_count"),
            count(X.LABEL_ADDRESS, "view_address_count"),
            count(X.LABEL_CONSULT, "consult_users"),
            blank,
            line(X.SECTION_IN_STORE, section=True),
            count(X.LABEL_NEW_COLLECT, "new_collect_users"),
            count(X.LABEL_NEW_CHECKIN, "checkin_count"),
            count(X.LABEL_NEW_REVIEW, "new_review_count"),
            blank,
            line(X.SECTION_PROMOTION, section=True),
            money(X.LABEL_PROMO_COST, "promotion_cost"),
            money(X.LABEL_PROMO_CLICK_PRICE, "click_avg_price"),
            count(X.LABEL_PROMO_ORDERS, "order_count"),
            money(X.LABEL_AD_BALANCE, "ad_balance"),
            blank,
            line(X.LABEL_REVIEW_CHECK, S(REVIEW_RATE), S(L.pass_fail(REVIEW_OK)), check=S(REVIEW_OK)),
            line(X.LABEL_COLLECT_CHECK, S(COLLECT_RATE), S(L.pass_fail(COLLECT_OK)), check=S(COLLECT_OK)),
            line(X.LABEL_COUPON_CHECK, S("coupon_orders_7d"), S(L.pass_fail(COUPON_OK)), check=S(COUPON_OK)),
            line(X.LABEL_AD_CHECK, S(L.ad_text("ad_today")), S(L.pass_fail(AD_OK)), check=S(AD_OK)),
            blank,
            money(X.LABEL_ORDER_AMOUNT, "order_sale_amount"),
            money(X.LABEL_VERIFY_AMOUNT, "verify_sale_amount"),
            line(X.LABEL_ORDER_RANK, S(L.rank_label_region("region_path", "order_user_rank"))),
            line(X.LABEL_VERIFY_RANK, S(L.rank_label_region("region_path", "verify_amount_rank"))),
            blank,
            count(X.LABEL_FORCE_OFFLINE, "is_force_offline"),
            blank,
            line(X.LABEL_OPERATOR, S("operator")),
            line(X.LABEL_SALES, S("sales")),
            line(X.LABEL_CITY, S("city")),
        ]
        return unpivot_rows(self.named, ["report_date", "shop_id", "seq", "sheet_name"], rows,
                            ["col_a", "col_b", "col_c"],
                            flags=[("is_section", "boolean"), ("passed", "boolean"), ("alert", "boolean")])

    @cached_property
    def shop_count(self) -> DataFrame:
        """Number of shops in the report (one row)."""
        return self.plain.selectExpr("count(DISTINCT shop_id) AS store_count")

    def outputs(self) -> dict[str, DataFrame]:
        return {"summary": self.summary, "detail": self.detail, "checks": self.checks}


# N8/N9 checks over base columns.
REVIEW_RATE = M.float_rate_text("new_review_count", "verify_person_count")
REVIEW_OK = M.float_rate_at_least("new_review_count", "verify_person_count", REVIEW_RATE_MIN)
COLLECT_RATE = M.float_rate_text("new_collect_users", "order_users")
COLLECT_OK = M.float_rate_at_least("new_collect_users", "order_users", COLLECT_RATE_MIN)
COUPON_OK = f"(coupon_orders_7d >= {COUPON_7D_MIN})"
AD_OK = f"(ad_today >= {AD_TODAY_MIN})"


def _as_period(report_date) -> Period:
    return as_period(report_date)


def _daily_rows(tables, dates: Period, accounts: Accounts, shops, dedupe_right: bool) -> DataFrame:
    rows = joined_facts(tables, [dates], shops=shops, dedupe_right=dedupe_right, ad_today=True)
    history = tables.store_daily.select(F.col("shop_id").cast("string").alias("shop_id"), "report_date",
                                        "coupon_pay_order_count")
    # the trailing sum is per shop: only the reported shops' history is needed
    history = apply_shop_filter(history, shops)
    coupons = trailing_sum(history, "coupon_pay_order_count", dates, days=TRAILING_DAYS, out="coupon_orders_7d")
    dim, reg = shop_dim(tables, accounts), region_dim(tables, accounts)
    if isinstance(shops, Column):                      # a literal limit is pushed down; others would only add a join
        dim, reg = dim.where(shops), reg.where(shops)
    rows = rows.withColumnsRenamed({"city": "store_city", "shop_name": "raw_shop_name"})
    joined = (rows.join(coupons, ["shop_id", "report_date"], "left")
              .join(dim, "shop_id", "left")
              .join(reg, "shop_id", "left"))
    # A region entry's city (possibly '') when the entry exists, else the account city.
    region_city = "CASE WHEN region_city IS NOT NULL THEN region_city ELSE coalesce(city, '') END"
    return joined.selectExpr(
        *[c for c in rows.columns if c != "ad_today"],
        f"{M.count0('coupon_orders_7d')} AS coupon_orders_7d",
        f"{M.count0('ad_today')} AS ad_today",
        "coalesce(operator, '') AS operator",
        "coalesce(sales, '') AS sales",
        "coalesce(city, '') AS city",
        f"{L.daily_shop_name('raw_shop_name', 'shop_id')} AS shop_name",
        f"{L.region_path(region_city, 'region_district', 'region_business', 'city')} AS region_path",
        f"{CLEAN_NAME} AS clean_name",
    )


CLEAN_NAME = L.clean_section_name(L.daily_shop_name("raw_shop_name", "shop_id"))


def daily_report(tables, report_date: str | dt.date | Period | Sequence, accounts: Accounts = None,
                 unresolved: str = "none", dedupe_right: bool = False, legacy: bool = False) -> DailyReport:
    """R1 for one date, R5 for a date range (numbering restarts per date)."""
    dates = _as_period(report_date)
    accounts = given(accounts, unresolved)
    shops = shop_filter(tables, accounts=accounts, unresolved=unresolved)
    rows = _daily_rows(tables, dates, accounts, shops, dedupe_right)
    return DailyReport(rows=rows, dates=dates, options=dict(accounts=accounts, legacy=legacy, shops=shops))
