"""Text and date report functions (T*, D*) as Spark SQL expression text.

Arguments are SQL expressions (usually column names); results are SQL text.
"""

from __future__ import annotations

from shoplens.functions import texts as X


def lit(s) -> str:
    """A Spark SQL literal (strings escaped for Spark's backslash-escaping parser)."""
    if s is None:
        return "NULL"
    if isinstance(s, bool):
        return "true" if s else "false"
    if isinstance(s, (int, float)):
        return repr(s)
    return "'" + str(s).replace("\\", "\\\\").replace("'", "\\'") + "'"


def truthy_text(x: str) -> str:
    """Python truthiness of a text value: not NULL and not empty."""
    return f"({x} IS NOT NULL AND {x} <> '')"


def text_or(x: str, default: str) -> str:
    """``x or default`` for text (NULL and '' take the default)."""
    return f"(CASE WHEN {truthy_text(x)} THEN {x} ELSE {lit(default)} END)"


# ---- dates (D2, D3) ---------------------------------------------------------

def weekday_name(d: str) -> str:
    """Monday=0 -> 周一 .. 周日."""
    names = ", ".join(lit(n) for n in X.WEEKDAY_NAMES)
    return f"element_at(array({names}), weekday({d}) + 1)"


def date_label(d: str) -> str:
    """D3: ``MM月dd日``."""
    return f"date_format({d}, 'MM月dd日')"


def date_short(d: str) -> str:
    """D3: ``MM/dd``."""
    return f"date_format({d}, 'MM/dd')"


# ---- ranks, regions, status (T1-T4) ----------------------------------------

def _rank_known(r: str) -> str:
    return f"({r} IS NOT NULL AND {r} <> 0)"


def rank_label(r: str) -> str:
    """NULL/0 -> ``--``; < 100 -> ``第N名``; otherwise ``大于100名``."""
    return (f"(CASE WHEN NOT {_rank_known(r)} THEN {lit(X.RANK_NONE)} "
            f"WHEN {r} < 100 THEN concat({lit(X.RANK_PREFIX)}, CAST({r} AS STRING), {lit(X.RANK_SUFFIX)}) "
            f"ELSE {lit(X.RANK_OVER_100)} END)")


def rank_label_region(region: str, r: str) -> str:
    """``region：第N名`` for a known rank below 100, else ``region：大于100名``."""
    reg = f"coalesce({region}, '')"
    return (f"(CASE WHEN {_rank_known(r)} AND {r} < 100 THEN concat({reg}, "
            f"{lit(X.RANK_REGION_SEP + X.RANK_PREFIX)}, CAST({r} AS STRING), {lit(X.RANK_SUFFIX)}) "
            f"ELSE concat({reg}, {lit(X.RANK_REGION_SEP + X.RANK_OVER_100)}) END)")


def region_path(region_city: str, district: str, business: str, account_city: str) -> str:
    """``city | district | business`` when business is set, else the account city."""
    rc, rd, rb = (f"coalesce({v}, '')" for v in (region_city, district, business))
    return (f"(CASE WHEN {truthy_text(business)} THEN concat({rc}, ' | ', {rd}, ' | ', {rb}) "
            f"ELSE coalesce({account_city}, '') END)")


def status_message(force_offline: str, legacy: bool = False) -> str:
    """T4: warning with the forced-offline count, else the all-clear text."""
    n = f"coalesce({force_offline}, 0)"
    prefix = (X.STATUS_WARN_LEGACY_MARK if legacy else "") + X.STATUS_WARN_PREFIX
    return (f"(CASE WHEN {n} > 0 THEN concat({lit(prefix)}, CAST({n} AS STRING), {lit(X.STATUS_WARN_SUFFIX)}) "
            f"ELSE {lit(X.STATUS_OK)} END)")


# ---- names (T5-T7, T9) ------------------------------------------------------

def clean_section_name(name: str) -> str:
    """T5: drop ``\\ / * ? : [ ]``, keep 31 code points, empty -> ``Sheet``."""
    cleaned = f"substring(translate({name}, {lit(X.SECTION_NAME_ILLEGAL)}, ''), 1, {X.SECTION_NAME_MAX})"
    return f"coalesce(nullif({cleaned}, ''), {lit(X.DEFAULT_SECTION_NAME)})"


def numbered_section_name(clean: str, n: str) -> str:
    """The n-th use of a name (n > 1) becomes ``name[:28] + '_' + n``."""
    return (f"(CASE WHEN {n} > 1 THEN concat(substring({clean}, 1, {X.SECTION_NAME_DUP_KEEP}), '_', "
            f"CAST({n} AS STRING)) ELSE {clean} END)")


def daily_shop_name(name: str, shop_id: str) -> str:
    """NULL or '' -> ``门店{id}``."""
    return (f"(CASE WHEN {truthy_text(name)} THEN {name} "
            f"ELSE concat({lit(X.SHOP_NAME_PREFIX)}, CAST({shop_id} AS STRING)) END)")


def period_shop_name(name_p1: str, name_p2: str, has_p1: str) -> str:
    """Period-2 name, else period-1 name, ``未知门店`` only if period 1 has no row."""
    return (f"(CASE WHEN {truthy_text(name_p2)} THEN {name_p2} WHEN {has_p1} THEN {name_p1} "
            f"ELSE {lit(X.UNKNOWN_SHOP)} END)")


def ad_text(n: str) -> str:
    """``当天{n}单``."""
    return f"concat({lit(X.AD_TODAY_PREFIX)}, CAST({n} AS STRING), {lit(X.AD_TODAY_SUFFIX)})"


def pass_fail(ok: str) -> str:
    return f"(CASE WHEN {ok} THEN {lit(X.PASS)} ELSE {lit(X.FAIL)} END)"
