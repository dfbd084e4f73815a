"""Hand-written micro fixtures (FIXTURES.md §3): tiny report inputs built from rows."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from shoplens.sources.tables import ReportTables

STORE_SCHEMA = (
    "shop_id string, report_date date, shop_name string, city string, exposure_users bigint, visit_users bigint, "
    "order_users bigint, verify_person_count bigint, order_coupon_count bigint, verify_coupon_count bigint, "
    "coupon_pay_order_count bigint, order_sale_amount decimal(18,2), verify_sale_amount decimal(18,2), "
    "verify_after_discount decimal(18,2), promotion_cost decimal(18,2), promotion_exposure_count bigint, "
    "promotion_click_count bigint, new_collect_users bigint, new_review_count bigint, "
    "new_good_review_count bigint, consult_users bigint, intent_rate string")
PROMO_SCHEMA = ("shop_id string, report_date date, view_phone_count bigint, view_address_count bigint, "
                "click_avg_price decimal(18,2), order_count bigint, view_groupbuy_count bigint")
STATS_SCHEMA = ("store_id string, date date, order_user_rank int, verify_amount_rank int, checkin_count bigint, "
                "ad_balance decimal(18,2), ad_order_count bigint, is_force_offline int")
ACCOUNT_SCHEMA = ("account string, stores_json string, compareRegions_json string, sales_name string, "
                  "city_name string, operator_id bigint")
USER_SCHEMA = "id bigint, name string"

STORE_COLS = [f.split()[0] for f in STORE_SCHEMA.split(", ")]


def day(s: str | None) -> dt.date | None:
    return None if s is None else dt.date.fromisoformat(s)


def store_row(shop_id, date, name="S", **vals):
    row = {c: None for c in STORE_COLS}
    row.update(shop_id=str(shop_id), report_date=day(date), shop_name=name, city="C")
    for c in STORE_COLS[4:]:
        if c in ("order_sale_amount", "verify_sale_amount", "verify_after_discount", "promotion_cost"):
            row[c] = Decimal("0.00")
        elif c != "intent_rate":
            row[c] = 0
    for k, v in vals.items():
        row[k] = Decimal(str(v)) if k in ("order_sale_amount", "verify_sale_amount", "verify_after_discount",
                                          "promotion_cost") and v is not None else v
    return tuple(row[c] for c in STORE_COLS)


def make_tables(spark, store=(), promo=(), stats=(), accounts=(), users=()) -> ReportTables:
    return ReportTables(
        store_daily=spark.createDataFrame(list(store), STORE_SCHEMA),
        promotion_daily=spark.createDataFrame(list(promo), PROMO_SCHEMA),
        store_stats=spark.createDataFrame(list(stats), STATS_SCHEMA),
        platform_accounts=spark.createDataFrame(list(accounts), ACCOUNT_SCHEMA),
        saas_users=spark.createDataFrame(list(users), USER_SCHEMA),
    )
