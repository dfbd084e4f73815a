"""Oracle SQL (DuckDB dialect) for the registered queries.

Written independently of the Spark plans, of which nothing is imported: sums,
rates, averages and display orders are spelled out here; the period report is
two separate rollups matched through the union of their shop keys (the original
shape, not the one-pass conditional aggregate), rounding is integer-only
arithmetic, numbering is a plain ``row_number()``. Shared are the report wording
(fixed texts), the period parameters and the text of the fixture views.
"""

from __future__ import annotations

from collections.abc import Sequence

from shoplens.functions import texts as X
from shoplens.plans.params import Period
from shoplens.sources.fixtures import duckdb_ctes

# FIXED VALUES. The 23 sums of a period, in report order: name = summed column.
SUMS = {
    "verify_after_discount": "verify_after_discount", "exposure_users": "exposure_users", "visit_users": "visit_users",
    "order_users": "order_users", "order_coupon_count": "order_coupon_count", "verify_users": "verify_person_count",
    "verify_coupon_count": "verify_coupon_count", "order_sale_amount": "order_sale_amount",
    "verify_sale_amount": "verify_sale_amount", "coupon_orders": "coupon_pay_order_count", "phone_clicks": "view_phone_count",
    "promotion_cost": "promotion_cost", "promotion_exposure": "promotion_exposure_count",
    "promotion_clicks": "promotion_click_count", "promotion_orders": "order_count", "view_groupbuy": "view_groupbuy_count",
    "view_phone": "view_phone_count", "consult_users": "consult_users", "address_clicks": "view_address_count",
    "new_collect": "new_collect_users", "new_good_reviews": "new_good_review_count", "new_reviews": "new_review_count",
    "checkin_count": "checkin_count",
}
AMOUNTS = {"verify_after_discount", "order_sale_amount", "verify_sale_amount", "promotion_cost"}
# Percentages: 100 * first / second. Unit prices: first / second.
PERCENT = {
    "exposure_rate": ("visit_users", "exposure_users"),
    "order_rate": ("order_users", "visit_users"),
    "promotion_rate": ("promotion_orders", "promotion_clicks"),
    "collect_rate": ("new_collect", "visit_users"),
    "collect_rate_detail": ("new_collect", "order_users"),
    "review_rate": ("new_good_reviews", "verify_users"),
}
UNIT = {
    "avg_price": ("verify_after_discount", "verify_users"),
    "click_price": ("promotion_cost", "promotion_clicks"),
}
# Columns of the two summary blocks, and lines of the detail sheet ("-": a section line).
FIRST = [
    "verify_after_discount", "exposure_users", "visit_users", "exposure_rate", "order_users", "order_coupon_count", "order_rate",
    "verify_users", "verify_coupon_count", "order_sale_amount", "verify_sale_amount", "coupon_orders", "phone_clicks", "avg_price",
]
SECOND = [
    "promotion_cost", "promotion_exposure", "promotion_clicks", "click_price", "promotion_orders", "promotion_rate", "view_groupbuy",
    "view_phone", "consult_users", "address_clicks", "new_collect", "collect_rate", "new_good_reviews", "review_rate",
]
SHEET = [
    "exposure_users", "visit_users", "exposure_rate", "order_users", "verify_users", "order_rate", "order_coupon_count",
    "verify_coupon_count", "order_sale_amount", "verify_sale_amount", "verify_after_discount", "avg_price", "phone_clicks",
    "address_clicks", "consult_users", "-", "new_good_reviews", "review_rate", "new_collect", "collect_rate_detail", "checkin_count",
    "-", "promotion_orders", "promotion_cost", "promotion_exposure", "promotion_clicks", "click_price", "view_groupbuy",
    "view_phone",
]
# Store-day columns that must not be negative, in the order in which reasons are listed.
NOT_NEGATIVE = [
    "exposure_users", "visit_users", "order_users", "verify_person_count", "order_coupon_count", "verify_coupon_count",
    "coupon_pay_order_count", "promotion_exposure_count", "promotion_click_count", "new_good_review_count", "new_review_count",
    "new_collect_users", "consult_users", "promotion_cost", "order_sale_amount", "verify_sale_amount", "verify_after_discount",
]
PERCENT_TEXT = r"^[0-9]+(\.[0-9]+)?%$"


def spec(name: str) -> tuple[str, str, tuple[str, ...]]:
    """(name, kind, arguments) of a displayed figure."""
    if name in PERCENT:
        return name, "rate", PERCENT[name]
    if name in UNIT:
        return name, "avg", UNIT[name]
    return name, "sum", ()


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def d(x) -> str:
    return f"DATE '{x}'"


# ---- integer-only rounding ---------------------------------------------------

def half_even(a: str, b: str) -> str:
    """round(a / b) half-even for a >= 0, b > 0 (BIGINT SQL expressions)."""
    return (f"(({a}) // ({b}) + case when 2 * (({a}) % ({b})) > ({b}) or "
            f"(2 * (({a}) % ({b})) = ({b}) and (({a}) // ({b})) % 2 = 1) then 1 else 0 end)")


def tenths(n: str, den: str) -> str:
    n0, d0 = f"coalesce({n}, 0)", f"coalesce({den}, 0)"
    return f"(case when {d0} > 0 then {half_even(f'cast({n0} as bigint) * 1000', f'cast({d0} as bigint)')} end)"


def cents(total: str, count: str) -> str:
    t0, c0 = f"cast(coalesce({total}, 0) * 100 as bigint)", f"coalesce({count}, 0)"
    return f"(case when {c0} > 0 then {half_even(t0, f'cast({c0} as bigint)')} end)"


def tenths_dec(t: str) -> str:
    return f"cast(cast({t} as decimal(20,0)) * 0.1 as decimal(20,1))"


def cents_dec(c: str) -> str:
    return f"cast(cast({c} as decimal(36,0)) * 0.01 as decimal(38,2))"


def tenths_text(t: str) -> str:
    return f"(case when {t} is null then '0%' else cast({tenths_dec(t)} as varchar) || '%' end)"


def diff_text(t1: str, t2: str, two_places: bool = False) -> str:
    diff = tenths_dec(f"(coalesce({t2}, 0) - coalesce({t1}, 0))")
    if two_places:
        diff = f"cast({diff} as decimal(20,2))"
    return f"(case when {t1} is null and {t2} is null then '0%' else cast({diff} as varchar) || '%' end)"


# ---- the period base ---------------------------------------------------------

def _joined(date_where: str, shop_where: str = "", dedupe: bool = False) -> str:
    """Facts with promotion and stats; ``ad_today`` is the greatest figure of a shop and day. ``dedupe`` folds
    the right sides first: the greatest price, balance, rank and offline flag, sums of the rest."""
    promo, stats = "promotion_daily", "store_stats"
    if dedupe:
        promo = """(select shop_id, report_date, sum(view_phone_count) as view_phone_count, sum(view_address_count) as view_address_count,
      max(click_avg_price) as click_avg_price, sum(order_count) as order_count, sum(view_groupbuy_count) as view_groupbuy_count
      from promotion_daily group by 1, 2)"""
        stats = """(select store_id, date, max(order_user_rank) as order_user_rank, max(verify_amount_rank) as verify_amount_rank,
      sum(checkin_count) as checkin_count, max(ad_balance) as ad_balance, sum(ad_order_count) as ad_order_count,
      max(is_force_offline) as is_force_offline from store_stats group by 1, 2)"""
    cols_k = ", ".join(f"k.{c}" for c in [
        "shop_name", "city", "exposure_users", "visit_users", "order_users", "verify_person_count",
        "order_coupon_count", "verify_coupon_count", "coupon_pay_order_count", "promotion_cost",
        "promotion_exposure_count", "promotion_click_count", "new_good_review_count", "new_review_count",
        "new_collect_users", "consult_users", "intent_rate", "order_sale_amount", "verify_sale_amount",
        "verify_after_discount"])
    return f"""
    select k.shop_id, k.report_date, {cols_k},
      p.view_phone_count, p.view_address_count, p.click_avg_price, p.order_count, p.view_groupbuy_count,
      s.order_user_rank, s.verify_amount_rank, s.checkin_count, s.ad_balance, s.ad_order_count, s.is_force_offline,
      (select max(x.ad_order_count) from {stats} x where x.store_id = k.shop_id and x.date = k.report_date) as ad_today
    from store_daily k
    left join {promo} p on k.shop_id = p.shop_id and k.report_date = p.report_date
    left join {stats} s on k.shop_id = s.store_id and k.report_date = s.date
    where {date_where} {shop_where}"""


def _sum_cols(alias: str = "") -> str:
    out = []
    for name, src in SUMS.items():
        t = "decimal(38,2)" if name in AMOUNTS else "bigint"
        out.append(f"cast(sum({alias}{src}) as {t}) as {name}")
    return ",\n      ".join(out)


def accounts_where(accounts: Sequence[str] | None, col: str = "account") -> str:
    if not accounts:
        return ""
    return f" and {col} in ({', '.join(q(a) for a in accounts)})"


def shop_dim_cte(accounts: Sequence[str] | None = None) -> str:
    """shop_id -> operator, sales, city ('' for NULL); greatest (account, pos) wins."""
    return f"""
  acc_rows as (
    select pa.account, coalesce(pa.sales_name, '') as sales, coalesce(pa.city_name, '') as city,
      coalesce(su.name, '') as operator,
      case when json_valid(pa.stores_json) and json_type(pa.stores_json) = 'ARRAY'
           then json_extract(pa.stores_json, '$[*]') end as elems
    from platform_accounts pa left join saas_users su on pa.operator_id = su.id
    where pa.stores_json is not null {accounts_where(accounts, 'pa.account')}
  ),
  acc_elems as (
    select account, sales, city, operator, unnest(elems) as elem, generate_subscripts(elems, 1) as pos
    from acc_rows where elems is not null
  ),
  acc_shops as (
    select account, pos, sales, city, operator, elem ->> '$.shop_id' as shop_id
    from acc_elems where json_type(elem) = 'OBJECT'
  ),
  shop_dim as (
    select shop_id, operator, sales, city from (
      select *, row_number() over (partition by shop_id order by account desc, pos desc) as rn
      from acc_shops where shop_id is not null and shop_id <> '') t
    where rn = 1
  )"""


def region_dim_cte(accounts: Sequence[str] | None = None) -> str:
    return f"""
  reg_rows as (
    select account, case when json_valid(compareRegions_json) and json_type(compareRegions_json) = 'OBJECT'
                         then compareRegions_json end as j
    from platform_accounts where compareRegions_json is not null {accounts_where(accounts)}
  ),
  reg_keys as (
    select account, j, unnest(json_keys(j)) as shop_id, generate_subscripts(json_keys(j), 1) as pos
    from reg_rows where j is not null
  ),
  reg_vals as (
    select account, pos, shop_id, json_extract(j, '/' || shop_id) as v from reg_keys
  ),
  reg_ok as (
    select account, pos, shop_id,
      coalesce(json_extract_string(v, '$.regions.city.regionName'), '') as region_city,
      coalesce(json_extract_string(v, '$.regions.district.regionName'), '') as region_district,
      coalesce(json_extract_string(v, '$.regions.business.regionName'), '') as region_business
    from reg_vals
    where json_type(v) = 'OBJECT'
      and (json_type(v, '$.regions') is null or json_type(v, '$.regions') = 'OBJECT')
  ),
  region_dim as (
    select shop_id, region_city, region_district, region_business from (
      select *, row_number() over (partition by shop_id order by account desc, pos desc) as rn from reg_ok) t
    where rn = 1
  )"""


def resolved_cte(accounts: Sequence[str]) -> str:
    return f"""
  res_rows as (
    select account, case when json_valid(stores_json) and json_type(stores_json) = 'ARRAY'
                         then json_extract(stores_json, '$[*]') end as elems
    from platform_accounts where true {accounts_where(accounts)}
  ),
  res_elems as (select unnest(elems) as elem from res_rows where elems is not null),
  resolved as (
    select distinct elem ->> '$.shop_id' as shop_id from res_elems
    where json_type(elem) = 'OBJECT' and (elem ->> '$.shop_id') is not null and (elem ->> '$.shop_id') <> ''
  )"""


def names_ctes(rows: str, out: str, group: str) -> str:
    """CTEs from ``rows`` to ``out`` with sheet_name: the first of a name keeps it, the others try
    2, 3, 4 ... behind the name's first 28 characters and take the numbers that no kept name has."""
    return f""",
  nm_use as (select *, {group} as g, row_number() over (partition by {group}, lower(clean_name) order by seq) as use_no from {rows}),
  nm_own as (select g, lower(clean_name) as own from nm_use where use_no = 1),
  nm_wait as (
    select g, seq, lower(substring(clean_name, 1, 28)) as stem,
      row_number() over (partition by g, lower(substring(clean_name, 1, 28)) order by seq) as k
    from nm_use where use_no > 1),
  nm_room as (
    select w.g, w.stem, max(w.k) + (select count(*) from nm_own o where o.g = w.g and starts_with(o.own, w.stem || '_')) as most
    from nm_wait w group by w.g, w.stem),
  nm_try as (select g, stem, unnest(range(2, most + 2)) as n from nm_room),
  nm_free as (
    select t.g, t.stem, t.n, row_number() over (partition by t.g, t.stem order by t.n) as k
    from nm_try t left join nm_own o on o.g = t.g and o.own = t.stem || '_' || cast(t.n as varchar) where o.own is null),
  {out} as (
    select u.* exclude (g, use_no),
      case when use_no = 1 then clean_name else substring(clean_name, 1, 28) || '_' || cast(f.n as varchar) end as sheet_name
    from nm_use u left join nm_wait w on w.g = u.g and w.seq = u.seq
    left join nm_free f on f.g = w.g and f.stem = w.stem and f.k = w.k)"""


def failed_ctes(p1: Period, p2: Period) -> str:
    """CTEs ending in ``failed``: shops with a rejected store-day, or a figure beyond the largest bigint, with both periods' sums."""
    largest = "9223372036854775807"
    parts = [validate_ctes([p1, p2])]
    for tag, p in (("q1", p1), ("q2", p2)):
        sums = ", ".join(f"sum({src}) as {name}" for name, src in SUMS.items())
        j = _joined(f"k.report_date between {d(p.start)} and {d(p.end)}")
        parts.append(f"""
  {tag} as (select shop_id, arg_max(shop_name, report_date) as shop_name, {sums} from ({j}) jj group by shop_id)""")
    counters = [n for n in SUMS if n not in AMOUNTS]
    errors = ["days"] + [f"case when {t}.{n} > {largest} then 'overflow in {n}_{p}' end" for t, p in (("q1", "p1"), ("q2", "p2")) for n in counters]
    seen = list(dict.fromkeys(x for x in FIRST + SECOND + SHEET if x in PERCENT or x in UNIT))
    sides = (("q1", "p1"), ("q2", "p2"))
    for name in [x for x in seen if x in PERCENT]:
        n, den = PERCENT[name]
        errors += [f"case when {t}.{den} between 1 and {largest} and {t}.{n} <= {largest} and {t}.{n} * 1000 > {largest} then 'overflow in {name}_{p}' end" for t, p in sides]
    for name in [x for x in seen if x in UNIT]:
        total, n = UNIT[name]
        errors += [f"case when {t}.{n} between 1 and {largest} and {t}.{total} * 100 > {largest} then 'overflow in {name}_{p}' end" for t, p in sides]
    kept = []
    for n in SUMS:
        for t, p in sides:
            value = f"cast({t}.{n} as decimal(38,2))" if n in AMOUNTS else f"cast(case when {t}.{n} <= {largest} then {t}.{n} end as bigint)"
            kept.append(f"{value} as {n}_{p}")
    parts.append(f"""
  bad_days as (select shop_id, string_agg(distinct errors, '; ' order by errors) as days from v where errors <> '' group by shop_id),
  every_shop as (select shop_id from q1 union select shop_id from q2 union select shop_id from bad_days),
  failed as (
    select * from (
      select e.shop_id,
        case when q2.shop_name is not null and q2.shop_name <> '' then q2.shop_name when q1.new_reviews is not null or q1.exposure_users is not null then q1.shop_name
             when q2.exposure_users is not null then {q(X.UNKNOWN_SHOP)} end as shop_name,
        concat_ws('; ', {", ".join(errors)}) as errors, q1.exposure_users is not null as has_p1, q2.exposure_users is not null as has_p2,
        {", ".join(kept)}
      from every_shop e left join q1 on q1.shop_id is not distinct from e.shop_id left join q2 on q2.shop_id is not distinct from e.shop_id
      left join bad_days b on b.shop_id is not distinct from e.shop_id) t
    where errors <> '')""")
    return ",".join(parts)


def failed_sql(p1: Period, p2: Period, variant: str) -> str:
    return duckdb_ctes(variant).rstrip() + "," + failed_ctes(p1, p2) + "\nselect * from failed"


def period_base_sql(p1: Period, p2: Period, accounts: Sequence[str] | None = None,
                    shop_id: str | None = None, shop_ids: Sequence[str] | None = None,
                    rename: str = "sum_latest", by_city: bool = False, unresolved: str = "none",
                    dedupe: bool = False, quarantine: bool = False, variant: str | None = None) -> str:
    """CTE text ending in ``base``: one row per shop with seq, attributes, sums and
    derived tenths/cents, named like the Spark base."""
    ctes = []
    if shop_id:
        shop_where = f" and k.shop_id = {q(str(shop_id))}"
    elif shop_id is not None:
        shop_where = " and false"
    elif shop_ids is not None and not shop_ids:
        shop_where = " and false" if unresolved == "none" else ""
    elif shop_ids:
        shop_where = f" and k.shop_id in ({', '.join(q(str(s)) for s in shop_ids)})"
    elif accounts:
        ctes.append(resolved_cte(accounts))
        shop_where = " and k.shop_id in (select shop_id from resolved)"
        if unresolved == "all":
            shop_where = " and (k.shop_id in (select shop_id from resolved) or not exists (select 1 from resolved))"
    else:
        shop_where = ""
    ctes.append(shop_dim_cte(accounts))
    if quarantine:
        ctes.append(failed_ctes(p1, p2))
        shop_where += " and not exists (select 1 from failed x where x.shop_id is not distinct from k.shop_id)"

    def rollup(tag: str, p: Period) -> str:
        j = _joined(f"k.report_date between {d(p.start)} and {d(p.end)}", shop_where, dedupe)
        if rename == "sum_latest":
            return f"""
  {tag} as (
    select shop_id, arg_max(shop_name, report_date) as shop_name,
      {_sum_cols()}
    from ({j}) jj group by shop_id
  )"""
        keys = "shop_id, shop_name" + (", city" if by_city else "")
        order = "shop_name desc nulls last" + (", city desc nulls last" if by_city else "")
        return f"""
  {tag}_g as (
    select {keys},
      {_sum_cols()}
    from ({j}) jj group by {keys}
  ),
  {tag} as (
    select * exclude (rn) from (
      select *, row_number() over (partition by shop_id order by {order}) as rn from {tag}_g) t
    where rn = 1
  )"""

    ctes.append(rollup("w1", p1))
    ctes.append(rollup("w2", p2))
    sums = []
    for name in SUMS:
        sums.append(f"w1.{name} as {name}_p1")
        sums.append(f"w2.{name} as {name}_p2")
    ctes.append(f"""
  keys as (select shop_id from w1 union select shop_id from w2),
  b0 as (
    select keys.shop_id,
      row_number() over (order by keys.shop_id) as seq,
      coalesce(nullif(sd.operator, ''), '--') as operator,
      coalesce(nullif(sd.sales, ''), '--') as sales,
      coalesce(nullif(sd.city, ''), '--') as city,
      w1.shop_id is not null as has_p1, w2.shop_id is not null as has_p2,
      case when w2.shop_name is not null and w2.shop_name <> '' then w2.shop_name
           when w1.shop_id is not null then w1.shop_name else {q(X.UNKNOWN_SHOP)} end as shop_name,
      {", ".join(sums)}
    from keys
    left join w1 on w1.shop_id = keys.shop_id
    left join w2 on w2.shop_id = keys.shop_id
    left join shop_dim sd on sd.shop_id = keys.shop_id
  )""")
    derived, seen = [], set()
    for name, kind, args in map(spec, FIRST + SECOND + [x for x in SHEET if x != "-"]):
        if kind == "sum" or name in seen:
            continue
        seen.add(name)
        for sfx in ("_p1", "_p2"):
            a, b = args[0] + sfx, args[1] + sfx
            if kind == "rate":
                derived.append(f"{tenths(a, b)} as {name}{sfx}_t")
            else:
                derived.append(f"{cents(a, b)} as {name}{sfx}_c")
    ctes.append(f"""
  b1 as (
    select *, {", ".join(derived)},
      coalesce(nullif(substring(translate(shop_name, {q(X.SECTION_NAME_ILLEGAL)}, ''), 1, 31), ''), 'Sheet') as clean_name
    from b0
  )""" + names_ctes("b1", "base", "0"))
    return duckdb_ctes(variant).rstrip() + ",\n" + ",".join(ctes) + "\n"


# ---- per-metric SQL over base ------------------------------------------------

def _money(x: str) -> str:
    return f"coalesce(cast({x} as decimal(38,2)), cast(0 as decimal(38,2)))"


def _count(x: str) -> str:
    return f"coalesce(cast({x} as bigint), cast(0 as bigint))"


def value_sql(name, kind, sfx) -> str:
    if kind == "sum":
        return _money(name + sfx) if name in AMOUNTS else _count(name + sfx)
    if kind == "rate":
        return f"coalesce({tenths_dec(f'{name}{sfx}_t')}, cast(0 as decimal(20,1)))"
    return f"coalesce({cents_dec(f'{name}{sfx}_c')}, cast(0 as decimal(38,2)))"


def delta_sql(name, kind) -> str:
    if kind == "rate":
        return tenths_dec(f"(coalesce({name}_p2_t, 0) - coalesce({name}_p1_t, 0))")
    if kind == "avg":
        return cents_dec(f"(coalesce({name}_p2_c, 0) - coalesce({name}_p1_c, 0))")
    t = "decimal(38,2)" if name in AMOUNTS else "bigint"
    return f"cast({value_sql(name, kind, '_p2')} - {value_sql(name, kind, '_p1')} as {t})"


def cell_sql(name, kind, sfx) -> str:
    if kind == "rate":
        return tenths_text(f"{name}{sfx}_t")
    if kind == "avg":
        return f"coalesce(cast({cents_dec(f'{name}{sfx}_c')} as varchar), '0')"
    if name in AMOUNTS:
        return f"coalesce(cast(cast({name}{sfx} as decimal(38,2)) as varchar), '0')"
    return f"cast({_count(name + sfx)} as varchar)"


def delta_cell_sql(name, kind, detail: bool = False) -> str:
    if kind == "rate":
        return diff_text(f"{name}_p1_t", f"{name}_p2_t", two_places=detail)
    if kind == "avg":
        c1, c2 = f"{name}_p1_c", f"{name}_p2_c"
        return (f"(case when {c1} is null and {c2} is null then '0' else "
                f"cast({cents_dec(f'(coalesce({c2}, 0) - coalesce({c1}, 0))')} as varchar) end)")
    if name in AMOUNTS:
        a, b = f"{name}_p1", f"{name}_p2"
        return (f"(case when {a} is null and {b} is null then '0' else cast(cast(coalesce({b}, 0) - "
                f"coalesce({a}, 0) as decimal(38,2)) as varchar) end)")
    return f"cast({_count(name + '_p2')} - {_count(name + '_p1')} as varchar)"


def trend_sql(name, kind) -> str:
    return f"cast(sign({delta_sql(name, kind)}) as integer)"


def wide_select(p1: Period, p2: Period) -> str:
    cols = ["shop_id", "cast(seq as integer) as seq", "operator", "city", "sales", "shop_name",
            f"{q(p1.label)} as p1_label", f"{q(p2.label)} as p2_label"]
    for name, kind, _args in map(spec, FIRST + SECOND):
        cols.append(f"{value_sql(name, kind, '_p1')} as {name}_p1")
        cols.append(f"{value_sql(name, kind, '_p2')} as {name}_p2")
        cols.append(f"{delta_sql(name, kind)} as {name}_delta")
        if kind == "rate":
            cols.append(f"{tenths_text(name + '_p1_t')} as {name}_p1_text")
            cols.append(f"{tenths_text(name + '_p2_t')} as {name}_p2_text")
            cols.append(f"{diff_text(name + '_p1_t', name + '_p2_t')} as {name}_delta_text")
    return "select " + ",\n  ".join(cols) + "\nfrom base"


def _lines(rows: list[list[str]], columns: list[str], keys: str = "shop_id, cast(seq as integer) as seq",
           row_col: str = "row_no") -> str:
    parts = []
    for i, r in enumerate(rows, start=1):
        cells = ", ".join(f"{v} as {c}" for v, c in zip(r, columns))
        parts.append(f"select {keys}, cast({i} as integer) as {row_col}, {cells} from base")
    return "\nunion all\n".join(parts)


def rows8_select(p1: Period, p2: Period) -> str:
    def block(metrics):
        return ([cell_sql(n, k, "_p1") for n, k, _ in map(spec, metrics)], [cell_sql(n, k, "_p2") for n, k, _ in map(spec, metrics)],
                [delta_cell_sql(n, k) for n, k, _ in map(spec, metrics)])

    b1 = block(FIRST)
    b2 = block(SECOND)
    blank5 = ["''"] * 5
    shop = ["cast(seq as varchar)", "operator", "city", "sales", "coalesce(shop_name, '')"]
    rows = [
        [q(h) for h in X.PERIOD_HEADER_1] + ["1", "'header'", "true", "false"],
        shop + [q(p1.label)] + b1[0] + ["1", "'p1'", "false", "false"],
        blank5 + [q(p2.label)] + b1[1] + ["1", "'p2'", "false", "false"],
        blank5 + [q(X.PERIOD_DELTA)] + b1[2] + ["1", "'delta'", "false", "true"],
        [q(h) for h in X.PERIOD_HEADER_2] + ["2", "'header'", "true", "false"],
        blank5 + [q(p1.label)] + b2[0] + ["2", "'p1'", "false", "false"],
        blank5 + [q(p2.label)] + b2[1] + ["2", "'p2'", "false", "false"],
        blank5 + [q(X.PERIOD_DELTA)] + b2[2] + ["2", "'delta'", "false", "true"],
    ]
    columns = [f"c{i:02d}" for i in range(1, 21)] + ["block", "line_type", "is_header", "is_delta"]
    rows = [r[:20] + [f"cast({r[20]} as integer)", r[21], r[22], r[23]] for r in rows]
    return _lines(rows, columns, row_col="line_no")


def detail31_select(p1: Period, p2: Period) -> str:
    rows = [["coalesce(shop_name, '')", "''", "''", "''", "true", "false", "0"],
            [q(X.DETAIL_HEADER), q(p1.label), q(p2.label), q(X.DETAIL_DELTA_HEADER), "true", "false", "0"]]
    labels = iter(X.DETAIL_LABELS)
    for line in SHEET:
        label = next(labels)
        if line == "-":
            rows.append([q(label), "''", "''", "''", "true", "false", "0"])
            continue
        n, k, _ = spec(line)
        rows.append([q(label), cell_sql(n, k, "_p1"), cell_sql(n, k, "_p2"), delta_cell_sql(n, k, detail=True),
                     "false", "true", trend_sql(n, k)])
    rows = [r[:6] + [f"cast({r[6]} as integer)"] for r in rows]
    return _lines(rows, ["label", "p1", "p2", "delta", "is_section", "is_metric", "trend"],
                  keys="shop_id, cast(seq as integer) as seq, sheet_name")


def trend_select() -> str:
    rows = [[q(n), f"cast({delta_sql(n, k)} as varchar)", trend_sql(n, k)] for n, k, _ in map(spec, FIRST + SECOND)]
    return _lines(rows, ["metric", "delta", "trend"])


# ---- daily report -----------------------------------------------------------

def float_rate_text_sql(n: str, den: str) -> str:
    """A double printed with one decimal by the database itself, as the original's formatting prints it."""
    n0, d0 = f"coalesce({n}, 0)", f"coalesce({den}, 0)"
    return f"(case when {d0} > 0 then printf('%.1f', cast({n0} as double) / cast({d0} as double) * 100.0) else '0.0' end || '%')"


def float_pass_sql(n: str, den: str, threshold: int) -> str:
    n0, d0 = f"coalesce({n}, 0)", f"coalesce({den}, 0)"
    return (f"(case when {d0} > 0 then cast({n0} as double) / cast({d0} as double) * 100.0 >= {float(threshold)} "
            f"else false end)")


def rank_label_sql(r: str) -> str:
    return (f"(case when {r} is null or {r} = 0 then {q(X.RANK_NONE)} when {r} < 100 then "
            f"{q(X.RANK_PREFIX)} || cast({r} as varchar) || {q(X.RANK_SUFFIX)} else {q(X.RANK_OVER_100)} end)")


def rank_detail_sql(region: str, r: str) -> str:
    return (f"(case when {r} is not null and {r} <> 0 and {r} < 100 then {region} || "
            f"{q(X.RANK_REGION_SEP + X.RANK_PREFIX)} || cast({r} as varchar) || {q(X.RANK_SUFFIX)} "
            f"else {region} || {q(X.RANK_REGION_SEP + X.RANK_OVER_100)} end)")


def trailing_sql(table: str, key: str, date_col: str, value: str, out: str) -> str:
    """Correlated 7-day window sum for every (shop_id, report_date) of ``j``."""
    return f"""
    select jj.shop_id, jj.report_date, cast(coalesce(sum(t.{value}), 0) as bigint) as {out}
    from (select distinct shop_id, report_date from j) jj
    left join {table} t on t.{key} = jj.shop_id and t.{date_col} between jj.report_date - 6 and jj.report_date
    group by jj.shop_id, jj.report_date"""


def daily_base_sql(start, end, accounts: Sequence[str] | None = None, variant: str | None = None) -> str:
    ctes = [shop_dim_cte(accounts), region_dim_cte(accounts)]
    shop_where = ""
    if accounts:
        ctes.append(resolved_cte(accounts))
        shop_where = " and k.shop_id in (select shop_id from resolved)"
    ctes.append(f"""
  j as ({_joined(f"k.report_date between {d(start)} and {d(end)}", shop_where)}),
  c7 as ({trailing_sql('store_daily', 'shop_id', 'report_date', 'coupon_pay_order_count', 'coupon_orders_7d')}),
  a7 as ({trailing_sql('store_stats', 'store_id', 'date', 'ad_order_count', 'ad_orders_7d')}),
  db0 as (
    select j.* exclude (ad_today), c7.coupon_orders_7d, a7.ad_orders_7d,
      cast(coalesce(j.ad_today, 0) as bigint) as ad_today,
      coalesce(sd.operator, '') as operator, coalesce(sd.sales, '') as sales, coalesce(sd.city, '') as acity,
      rd.region_city, rd.region_district, rd.region_business,
      case when j.shop_name is not null and j.shop_name <> '' then j.shop_name
           else {q(X.SHOP_NAME_PREFIX)} || j.shop_id end as dname
    from j
    left join c7 on c7.shop_id = j.shop_id and c7.report_date = j.report_date
    left join a7 on a7.shop_id = j.shop_id and a7.report_date = j.report_date
    left join shop_dim sd on sd.shop_id = j.shop_id
    left join region_dim rd on rd.shop_id = j.shop_id
  ),
  db1 as (
    select *,
      row_number() over (partition by report_date order by shop_id) as seq,
      case when coalesce(region_business, '') <> ''
           then coalesce(case when region_city is not null then region_city else acity end, '') || ' | ' ||
                coalesce(region_district, '') || ' | ' || region_business
           else acity end as region_path,
      coalesce(nullif(substring(translate(dname, {q(X.SECTION_NAME_ILLEGAL)}, ''), 1, 31), ''), 'Sheet') as clean_name
    from db0
  )""" + names_ctes("db1", "dbase", "report_date"))
    return duckdb_ctes(variant).rstrip() + ",\n" + ",".join(ctes) + "\n"


def _cnt(x: str) -> str:
    return f"cast(coalesce({x}, 0) as bigint)"


def _money_daily_cell(x: str) -> str:
    return f"(case when {x} is null or {x} = 0 then '0' else cast(cast({x} as decimal(38,2)) as varchar) end)"


def daily_summary_select() -> str:
    wd = "[" + ", ".join(q(w) for w in X.WEEKDAY_NAMES) + "]"
    return f"""select report_date, shop_id,
  {wd}[isodow(report_date)] as weekday,
  strftime(report_date, '%m月%d日') as date_label,
  cast(seq as integer) as seq, operator, acity as city, sales, dname as shop_name,
  {_cnt('exposure_users')} as exposure_users, {_cnt('visit_users')} as visit_users,
  {_cnt('order_users')} as order_users, {_cnt('verify_person_count')} as verify_users,
  {_cnt('order_coupon_count')} as order_coupon_count, {_cnt('verify_coupon_count')} as verify_coupon_count,
  {_cnt('view_phone_count')} as phone_clicks, {_cnt('view_address_count')} as address_clicks,
  {_money('promotion_cost')} as promotion_cost, {_cnt('new_good_review_count')} as new_good_review_count,
  case when intent_rate is not null and intent_rate <> '' then intent_rate else '0%' end as intent_rate,
  {_money('order_sale_amount')} as order_sale_amount, {_money('verify_sale_amount')} as verify_sale_amount,
  {_money('verify_after_discount')} as verify_after_discount,
  {rank_label_sql('order_user_rank')} as order_rank_label, {rank_label_sql('verify_amount_rank')} as verify_rank_label
from dbase"""


def daily_checks_select() -> str:
    return f"""select report_date, shop_id,
  {float_rate_text_sql('new_review_count', 'verify_person_count')} as review_rate,
  {float_pass_sql('new_review_count', 'verify_person_count', 30)} as review_pass,
  {float_rate_text_sql('new_collect_users', 'order_users')} as collect_rate,
  {float_pass_sql('new_collect_users', 'order_users', 40)} as collect_pass,
  coupon_orders_7d, coupon_orders_7d >= 10 as coupon_pass,
  ad_today, {q(X.AD_TODAY_PREFIX)} || cast(ad_today as varchar) || {q(X.AD_TODAY_SUFFIX)} as ad_text,
  ad_today >= 1 as ad_pass
from dbase"""


def rank_labels_select() -> str:
    return f"""select report_date, shop_id,
  {rank_label_sql('order_user_rank')} as order_rank_label, {rank_label_sql('verify_amount_rank')} as verify_rank_label,
  region_path,
  {rank_detail_sql('region_path', 'order_user_rank')} as order_rank_detail,
  {rank_detail_sql('region_path', 'verify_amount_rank')} as verify_rank_detail
from dbase"""


def section_names_select() -> str:
    return "select report_date, shop_id, cast(seq as integer) as seq, clean_name, sheet_name from dbase"


def coupon_7d_select() -> str:
    return "select report_date, shop_id, coupon_orders_7d from dbase"


def ad_7d_select() -> str:
    return "select report_date, shop_id, cast(coalesce(ad_orders_7d, 0) as bigint) as ad_orders_7d from dbase"


def daily_detail_select(legacy: bool = False) -> str:
    def pf(c):
        return f"(case when {c} then {q(X.PASS)} else {q(X.FAIL)} end)"

    review_ok = float_pass_sql('new_review_count', 'verify_person_count', 30)
    collect_ok = float_pass_sql('new_collect_users', 'order_users', 40)
    fo = "coalesce(is_force_offline, 0)"
    prefix = (X.STATUS_WARN_LEGACY_MARK if legacy else "") + X.STATUS_WARN_PREFIX
    status = (f"(case when {fo} > 0 then {q(prefix)} || cast({fo} as varchar) || {q(X.STATUS_WARN_SUFFIX)} "
              f"else {q(X.STATUS_OK)} end)")
    nb = "cast(null as boolean)"

    def line(a, b="''", c="''", section="false", check=nb, alert=nb):
        return [a, b, c, section, check, alert]

    def cnt(label, col):
        return line(q(label), f"cast({_cnt(col)} as varchar)")

    def money(label, col):
        return line(q(label), _money_daily_cell(col))

    blank = line("''")
    rows = [
        line("dname", status, alert=f"({fo} > 0)"),
        line(q(X.DAILY_TITLE), f"{q(X.DAILY_DATE_PREFIX + '(')} || strftime(report_date, '%m/%d') || ')'"),
        line(q(X.SECTION_FUNNEL), section="true"),
        cnt(X.LABEL_EXPOSURE, "exposure_users"), cnt(X.LABEL_VISIT, "visit_users"),
        cnt(X.LABEL_ORDER_USERS, "order_users"), cnt(X.LABEL_ORDER_COUPONS, "order_coupon_count"),
        cnt(X.LABEL_VERIFY_USERS, "verify_person_count"), cnt(X.LABEL_VERIFY_COUPONS, "verify_coupon_count"),
        cnt(X.LABEL_PHONE, "view_phone_count"), cnt(X.LABEL_ADDRESS, "view_address_count"),
        cnt(X.LABEL_CONSULT, "consult_users"),
        blank,
        line(q(X.SECTION_IN_STORE), section="true"),
        cnt(X.LABEL_NEW_COLLECT, "new_collect_users"), cnt(X.LABEL_NEW_CHECKIN, "checkin_count"),
        cnt(X.LABEL_NEW_REVIEW, "new_review_count"),
        blank,
        line(q(X.SECTION_PROMOTION), section="true"),
        money(X.LABEL_PROMO_COST, "promotion_cost"), money(X.LABEL_PROMO_CLICK_PRICE, "click_avg_price"),
        cnt(X.LABEL_PROMO_ORDERS, "order_count"), money(X.LABEL_AD_BALANCE, "ad_balance"),
        blank,
        line(q(X.LABEL_REVIEW_CHECK), float_rate_text_sql('new_review_count', 'verify_person_count'),
             pf(review_ok), check=review_ok),
        line(q(X.LABEL_COLLECT_CHECK), float_rate_text_sql('new_collect_users', 'order_users'),
             pf(collect_ok), check=collect_ok),
        line(q(X.LABEL_COUPON_CHECK), "cast(coupon_orders_7d as varchar)", pf("coupon_orders_7d >= 10"),
             check="coupon_orders_7d >= 10"),
        line(q(X.LABEL_AD_CHECK), f"{q(X.AD_TODAY_PREFIX)} || cast(ad_today as varchar) || {q(X.AD_TODAY_SUFFIX)}",
             pf("ad_today >= 1"), check="ad_today >= 1"),
        blank,
        money(X.LABEL_ORDER_AMOUNT, "order_sale_amount"), money(X.LABEL_VERIFY_AMOUNT, "verify_sale_amount"),
        line(q(X.LABEL_ORDER_RANK), rank_detail_sql("region_path", "order_user_rank")),
        line(q(X.LABEL_VERIFY_RANK), rank_detail_sql("region_path", "verify_amount_rank")),
        blank,
        cnt(X.LABEL_FORCE_OFFLINE, "is_force_offline"),
        blank,
        line(q(X.LABEL_OPERATOR), "operator"), line(q(X.LABEL_SALES), "sales"), line(q(X.LABEL_CITY), "acity"),
    ]
    parts = []
    for i, r in enumerate(rows, start=1):
        parts.append(f"select report_date, shop_id, cast(seq as integer) as seq, sheet_name, cast({i} as integer) "
                     f"as row_no, {r[0]} as col_a, {r[1]} as col_b, {r[2]} as col_c, {r[3]} as is_section, "
                     f"{r[4]} as passed, {r[5]} as alert from dbase")
    return "\nunion all\n".join(parts)


# ---- dimensions -----------------------------------------------------------

def shop_dim_select(accounts=None, variant: str | None = None) -> str:
    return duckdb_ctes(variant).rstrip() + ",\n" + shop_dim_cte(accounts) + "\nselect shop_id, operator, sales, city from shop_dim"


def region_dim_select(accounts=None) -> str:
    return (duckdb_ctes().rstrip() + ",\n" + region_dim_cte(accounts)
            + "\nselect shop_id, region_city, region_district, region_business from region_dim")


def accounts_filter_select(accounts) -> str:
    return duckdb_ctes().rstrip() + ",\n" + resolved_cte(accounts) + "\nselect shop_id from resolved"


# ---- quality -----------------------------------------------------------------

def default_profile_select() -> str:
    parts = []
    for sfx, period, has in (("_p1", "p1", "has_p1"), ("_p2", "p2", "has_p2")):
        for name in SUMS:
            reason = (f"case when not coalesce({has}, false) then 'row missing' "
                      f"when {name}{sfx} is null then 'null' else '' end")
            parts.append(f"select shop_id, cast(seq as integer) as seq, '{period}' as period, '{name}' as metric, "
                         f"{reason} as reason from base")
    return "select * from (\n" + "\nunion all\n".join(parts) + "\n) t where reason <> ''"


def validate_ctes(ranges) -> str:
    """CTEs ending in ``v``: every store-day of the ranges, or without a date, with its errors."""
    def rng(col):
        return "(" + " or ".join(f"{col} between {d(p.start)} and {d(p.end)}" for p in ranges) + ")"

    checks = ["case when k.shop_id is null or k.shop_id = '' then 'missing shop_id' end",
              "case when k.report_date is null then 'missing report_date' end"]
    checks += [f"case when k.{c} < 0 then 'negative {c}' end" for c in NOT_NEGATIVE]
    checks += [f"case when k.intent_rate is not null and k.intent_rate <> '' and "
               f"not regexp_full_match(k.intent_rate, '{PERCENT_TEXT}') then 'bad intent_rate' end",
               "case when dp._np > 1 then 'duplicate promotion rows' end",
               "case when ds._ns > 1 then 'duplicate stats rows' end"]
    return f"""
  dp as (select shop_id, report_date, count(*) as _np from promotion_daily where {rng('report_date')} group by 1, 2),
  ds as (select store_id as shop_id, date as report_date, count(*) as _ns from store_stats where {rng('date')}
         group by 1, 2),
  v as (
    select k.shop_id, k.report_date, concat_ws('; ', {", ".join(checks)}) as errors
    from store_daily k
    left join dp on dp.shop_id = k.shop_id and dp.report_date = k.report_date
    left join ds on ds.shop_id = k.shop_id and ds.report_date = k.report_date
    where {rng('k.report_date')} or k.report_date is null
  )"""


def validate_sql(ranges, variant: str | None = None) -> str:
    return (duckdb_ctes(variant).rstrip() + "," + validate_ctes(ranges)
            + "\nselect shop_id, report_date, case when errors = '' then 'ok' else 'rejected' end as status, errors from v")


#: FIXED VALUES. Columns of the joined rows with their types, in order.
ROW_COLUMNS = {
    "report_date": "date", "shop_name": "string", "city": "string", "exposure_users": "bigint", "visit_users": "bigint",
    "order_users": "bigint", "verify_person_count": "bigint", "order_coupon_count": "bigint", "verify_coupon_count": "bigint",
    "coupon_pay_order_count": "bigint", "promotion_cost": "decimal(18,2)", "promotion_exposure_count": "bigint",
    "promotion_click_count": "bigint", "new_good_review_count": "bigint", "new_review_count": "bigint",
    "new_collect_users": "bigint", "consult_users": "bigint", "intent_rate": "string", "order_sale_amount": "decimal(18,2)",
    "verify_sale_amount": "decimal(18,2)", "verify_after_discount": "decimal(18,2)", "view_phone_count": "bigint",
    "view_address_count": "bigint", "click_avg_price": "decimal(18,2)", "order_count": "bigint", "view_groupbuy_count": "bigint",
    "order_user_rank": "int", "verify_amount_rank": "int", "checkin_count": "bigint", "ad_balance": "decimal(18,2)",
    "ad_order_count": "bigint", "is_force_offline": "int",
}


def row_profile_sql(ranges) -> str:
    """Every joined row is laid out by column, then grouped by shop and column."""
    where = "(" + " or ".join(f"k.report_date between {d(p.start)} and {d(p.end)}" for p in ranges) + ")"
    parts = []
    for c, kind in ROW_COLUMNS.items():
        default = "false" if kind == "date" else f"{c} = ''" if kind == "string" else f"{c} = 0"
        parts.append(f"select shop_id, '{c}' as field, '{kind}' as data_type, count(*) as n_rows, count(*) filter ({c} is null) as n_null, "
                     f"count(*) filter ({default}) as n_default, cast(min({c}) as varchar) as least, cast(max({c}) as varchar) as greatest from j group by shop_id")
    return duckdb_ctes().rstrip() + f",\n  j as ({_joined(where)})\n" + "\nunion all\n".join(parts)


def sections_period_select() -> str:
    return "select shop_id, cast(seq as integer) as seq, clean_name, sheet_name from base"


def rows16_select(p1: Period, p2: Period) -> str:
    keep = ", ".join(["c05"] + [f"c{i:02d}" for i in range(6, 21)])
    return (f"select shop_id, seq, line_no, {keep}, block, line_type, is_header, is_delta from (\n"
            + rows8_select(p1, p2) + "\n) t")


def store_count_sql(day, p1: Period, p2: Period) -> str:
    rng = f"(report_date between {d(p1.start)} and {d(p1.end)} or report_date between {d(p2.start)} and {d(p2.end)})"
    return (duckdb_ctes().rstrip() + "\n"
            f"select (select count(distinct shop_id) from store_daily where report_date = {d(day)}) as daily_stores, "
            f"(select count(distinct shop_id) from store_daily where {rng}) as period_stores")
