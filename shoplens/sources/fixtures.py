"""Fixture views: the five report inputs derived from the driver tables.

The driver tables (``events``, ``customer``, ``nation``, ``region``) hold no
store reports, so each logical input is a view over them. Every statement is
valid in both Spark SQL and DuckDB, so the Spark plans and the SQL oracle share
the text. Table names are written as ``{events}``-style tokens and replaced
verbatim (never with ``str.format``: the JSON literals contain braces).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = ("events", "customer", "nation", "region")

STORE_DAILY = """
select cast(user_id as string) as shop_id, cast(ts as date) as report_date,
 concat('Shop/', cast(user_id % 40 as string), case when user_id % 10 = 0 and cast(ts as date) >= date '2024-01-05' then '*New' else '' end) as shop_name,
 concat('City_', cast(user_id % 7 as string)) as city,
 cast(count(*) * 10 as bigint) as exposure_users,
 cast(count(case when event_type in ('view','click') then 1 end) as bigint) as visit_users,
 cast(count(case when event_type = 'purchase' then 1 end) as bigint) as order_users,
 cast(count(case when event_type = 'purchase' and event_id % 3 > 0 then 1 end) as bigint) as verify_person_count,
 cast(sum(case when event_type = 'purchase' then event_id % 4 end) as bigint) as order_coupon_count,
 cast(sum(case when event_type = 'purchase' then event_id % 3 end) as bigint) as verify_coupon_count,
 cast(sum(case when event_type = 'purchase' then event_id % 5 end) as bigint) as coupon_pay_order_count,
 cast(sum(case when event_type = 'purchase' then cast(value as decimal(18,2)) end) as decimal(18,2)) as order_sale_amount,
 cast(sum(case when event_type = 'purchase' and event_id % 3 > 0 then cast(value as decimal(18,2)) end) as decimal(18,2)) as verify_sale_amount,
 cast(sum(case when event_type = 'purchase' and event_id % 3 = 1 then cast(value as decimal(18,2)) end) as decimal(18,2)) as verify_after_discount,
 cast(sum(case when event_type = 'click' then cast(value as decimal(18,2)) end) as decimal(18,2)) as promotion_cost,
 cast(count(case when event_type = 'view' then 1 end) as bigint) as promotion_exposure_count,
 cast(count(case when event_type = 'click' then 1 end) as bigint) as promotion_click_count,
 cast(count(case when event_type = 'signup' then 1 end) as bigint) as new_collect_users,
 cast(count(case when event_type = 'signup' and event_id % 2 = 0 then 1 end) as bigint) as new_review_count,
 cast(count(case when event_type = 'signup' and event_id % 4 = 0 then 1 end) as bigint) as new_good_review_count,
 cast(count(case when event_type = 'view' and event_id % 2 = 0 then 1 end) as bigint) as consult_users,
 max(case when event_type = 'view' then concat(cast(event_id % 100 as string), '%') end) as intent_rate
from {events} group by user_id, cast(ts as date)
"""

PROMOTION_DAILY = """
select cast(user_id as string) as shop_id, cast(ts as date) as report_date,
 cast(count(*) as bigint) as view_phone_count, cast(sum(event_id % 3) as bigint) as view_address_count,
 cast(max(cast(value as decimal(18,2))) as decimal(18,2)) as click_avg_price,
 cast(sum(event_id % 2) as bigint) as order_count, cast(sum(event_id % 5) as bigint) as view_groupbuy_count
from {events} where event_type = 'click' group by user_id, cast(ts as date)
"""

STORE_STATS = """
select cast(user_id as string) as store_id, cast(ts as date) as date,
 cast((user_id * 37 + extract(day from cast(ts as date)) * 11) % 140 as int) as order_user_rank,
 cast((user_id * 53 + extract(day from cast(ts as date)) * 7) % 140 as int) as verify_amount_rank,
 cast(count(*) as bigint) as checkin_count, cast(max(cast(value as decimal(18,2))) as decimal(18,2)) as ad_balance,
 cast(sum(event_id % 2) as bigint) as ad_order_count,
 cast(sum(case when event_id % 11 = 0 then 1 else 0 end) as int) as is_force_offline
from {events} where event_type = 'error' group by user_id, cast(ts as date)
"""

SAAS_USERS = """
select r_regionkey as id, r_name as name from {region}
"""

# Every customer is listed. An account holds the customers of one nation and one block of
# customer keys, so an account's JSON stays bounded and the number of accounts grows with
# the data. Residue 4 (mod 9) gives elements without a shop id and region values that are
# no objects; some accounts have unparsable or NULL shop lists.
PLATFORM_ACCOUNTS = """
select concat('acct_', cast(account_no as string)) as account,
 case when n_nationkey % 8 = 7 then 'not json' when account_no % 29 = 28 then null else concat('[', string_agg(case when c_custkey % 9 = 4 then concat('{"name":"', cast(c_custkey as string), '"}') else concat('{"shop_id":', cast(c_custkey as string), '}') end, ','), ',7,{"x":1}]') end as stores_json,
 concat('{', string_agg(concat('"', cast(c_custkey as string), '":', case when c_custkey % 9 = 4 then '"none"' else concat('{"regions":{"city":{"regionName":"', n_name, '"},"district":{"regionName":"D', cast(c_custkey % 5 as string), '"}', case when c_custkey % 3 = 0 then '' else concat(',"business":{"regionName":"B', cast(c_custkey % 11 as string), '"}') end, '}}') end), ','), '}') as compareRegions_json,
 concat('sales_', cast(n_nationkey % 4 as string)) as sales_name, n_name as city_name,
 case when n_nationkey % 6 = 5 then null else n_regionkey end as operator_id
from (select c_custkey, n_nationkey, n_name, n_regionkey, n_nationkey + 25 * cast(floor(c_custkey / 2500) as bigint) as account_no
      from {customer} join {nation} on c_nationkey = n_nationkey) t
group by account_no, n_nationkey, n_name, n_regionkey
"""

VIEWS = {
    "store_daily": STORE_DAILY,
    "promotion_daily": PROMOTION_DAILY,
    "store_stats": STORE_STATS,
    "saas_users": SAAS_USERS,
    "platform_accounts": PLATFORM_ACCOUNTS,
}


_STORE_COLUMNS = [
    "shop_name", "city", "exposure_users", "visit_users", "order_users", "verify_person_count", "order_coupon_count",
    "verify_coupon_count", "coupon_pay_order_count", "order_sale_amount", "verify_sale_amount", "verify_after_discount",
    "promotion_cost", "promotion_exposure_count", "promotion_click_count", "new_collect_users", "new_review_count",
    "new_good_review_count", "consult_users", "intent_rate"]


def _store_daily(**changed: str) -> str:
    cols = ", ".join(f"{changed[c]} as {c}" if c in changed else c for c in ("shop_id", "report_date", *_STORE_COLUMNS))
    return f"select {cols} from {{base}}"


# Inputs with the flaws and edge values that the plain views lack: (view, SQL over that view as {base}).
VARIANTS = {
    "stats_duplicates": ("store_stats", """
select * from {base} union all
select store_id, date, order_user_rank, verify_amount_rank, cast(checkin_count + 2 as bigint), ad_balance,
 cast(ad_order_count + 1 as bigint), is_force_offline from {base} where cast(store_id as bigint) % 3 = 1
"""),
    "null_dates": ("store_daily", _store_daily(report_date="case when cast(shop_id as bigint) % 7 = 3 and visit_users % 4 = 1 then null else report_date end")),
    "rate_ties": ("store_daily", _store_daily(new_review_count="cast((cast(shop_id as bigint) % 997) * 2 + 1 as bigint)", verify_person_count="cast(2000 as bigint)",
                                              new_collect_users="cast((cast(shop_id as bigint) % 97) * 2 + 1 as bigint)", order_users="cast(400 as bigint)")),
    # Names that meet each other's numbered forms, in other cases and with long common beginnings.
    "name_clashes": ("store_daily", _store_daily(shop_name="""case cast(shop_id as bigint) % 9 when 0 then 'Alpha' when 1 then 'Alpha_2' when 2 then 'ALPHA'
 when 3 then concat('alpha_', cast(cast(shop_id as bigint) % 60 as string)) when 4 then concat(repeat('x', 28), 'ab') when 5 then concat(repeat('X', 28), 'cd')
 when 6 then concat(repeat('x', 28), '_3') when 7 then 'Alpha_02' else concat('One', shop_id) end""")),
    "null_shops": ("store_daily", _store_daily(shop_id="case when cast(shop_id as bigint) % 7 = 3 and visit_users % 4 = 1 then null else shop_id end")),
    # Counters near the largest bigint: some fit alone but not as a sum, some not when a rate is taken.
    "large_counters": ("store_daily", _store_daily(visit_users="""case when cast(shop_id as bigint) % 11 = 5 then cast(4611686018427387904 as bigint)
 when cast(shop_id as bigint) % 11 = 6 and extract(day from report_date) = 9 then cast(9223372036854775 as bigint) else visit_users end""")),
    "null_accounts": ("platform_accounts", """
select account, case when cast(substring(account, 6, 9) as bigint) % 5 = 2 then null else stores_json end as stores_json,
 compareRegions_json, sales_name, city_name, operator_id from {base}
"""),
}


def render(sql: str, names: dict[str, str]) -> str:
    """Replace ``{table}`` tokens by concrete relation names."""
    for token, name in names.items():
        sql = sql.replace("{" + token + "}", name)
    return sql


def duckdb_ctes(variant: str | None = None) -> str:
    """The five views, one of them possibly in a variant, as a ``with`` clause over DuckDB's pre-registered tables."""
    names = {t: t for t in DRIVER_TABLES}
    parts = []
    for view, sql in VIEWS.items():
        body = render(sql, names).strip()
        if variant and VARIANTS[variant][0] == view:
            parts.append(f"{view}_base as ({body})")
            body = VARIANTS[variant][1].replace("{base}", f"{view}_base").strip()
        parts.append(f"{view} as ({body})")
    return "with " + ",\n".join(parts) + "\n"


def with_variant(tables, variant: str):
    """A bundle of inputs with one of them in a variant."""
    view, sql = VARIANTS[variant]
    base = getattr(tables, view)
    return tables.replace(**{view: base.sparkSession.sql(sql, base=base)})


_REGISTERED: dict[tuple[int, str], dict[str, str]] = {}


def register_driver_tables(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Register the driver parquet tables under names unique to ``sf_dir``.

    Registered once per session and folder (the footers are read once); the
    views stay lazy, so every query still scans the whole tables.
    """
    key = (id(spark._jsparkSession), sf_dir)
    names = _REGISTERED.get(key)
    if names and all(spark.catalog.tableExists(n) for n in names.values()):
        return names
    tag = hashlib.sha1(sf_dir.encode()).hexdigest()[:10]
    names = {}
    for t in DRIVER_TABLES:
        name = f"shoplens_{t}_{tag}"
        path = f"{sf_dir.rstrip('/')}/{t}.parquet"
        df = spark.read.parquet(path)
        if dict(df.dtypes).get("ts") == "timestamp":
            # events.ts holds wall-clock times; read it without a time zone even when
            # the session does not infer TIMESTAMP_NTZ, so days never shift.
            schema = ", ".join(f"`{c}` {'timestamp_ntz' if c == 'ts' else ty}" for c, ty in df.dtypes)
            df = spark.read.schema(schema).parquet(path)
        df.createOrReplaceTempView(name)
        names[t] = name
    _REGISTERED[key] = names
    return names


def fixture_views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The five report inputs as lazy DataFrames over the driver tables."""
    names = register_driver_tables(spark, sf_dir)
    return {v: spark.sql(render(sql, names)) for v, sql in VIEWS.items()}
