"""Account-derived dimensions and filters.

Both dimensions have one row per shop, so they grow with the number of shops,
not with the facts. They are joined without a broadcast hint: Catalyst and AQE
pick a broadcast hash join only when the measured size is under
``spark.sql.autoBroadcastJoinThreshold`` and a shuffle join otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.functions.jsoncols import explode_regions, explode_store_ids
from shoplens.sources.tables import ReportTables

Accounts = Sequence[str] | DataFrame | None


def given(value, unresolved: str = "none"):
    """One rule for a filter that names nothing: None is no filter; an empty list
    selects nothing, or, with ``unresolved='all'``, counts as no filter (the
    original's fail-open behaviour). DataFrames are left to the joins."""
    if value is None or isinstance(value, DataFrame):
        return value
    value = [str(x) for x in value]
    return None if not value and unresolved == "all" else value


def filter_accounts(df: DataFrame, accounts: Accounts) -> DataFrame:
    """``account IN (...)``; None means no filter, an empty list selects no account.

    A DataFrame of accounts (column ``account``) becomes a left semi join, so
    the list size is not bounded by the plan text.
    """
    if accounts is None:
        return df
    if isinstance(accounts, DataFrame):
        return df.join(accounts.select("account").distinct(), "account", "left_semi")
    return df.where(F.col("account").isin(list(accounts)) if accounts else F.lit(False))


def resolved_shops(tables: ReportTables, accounts: Accounts) -> DataFrame:
    """Distinct shop ids listed by the given accounts' ``stores_json``."""
    acc = filter_accounts(tables.platform_accounts.select("account", "stores_json"), accounts)
    return explode_store_ids(acc).select("shop_id").distinct()


def shop_dim(tables: ReportTables, accounts: Accounts = None) -> DataFrame:
    """J3 + A8: shop_id -> (operator, sales, city).

    Accounts without ``stores_json`` are skipped (P8); each listed shop takes
    the attributes of its account, ``''`` for NULL. A shop listed by several
    accounts keeps one owner: the greatest (account, position) — a fixed rule
    where the original kept whichever row was read last.
    """
    acc = filter_accounts(
        tables.platform_accounts.where(F.col("stores_json").isNotNull())
        .select("account", "stores_json", "sales_name", "city_name", "operator_id"), accounts)
    ops = tables.saas_users.select(F.col("id").alias("operator_id"), F.col("name").alias("operator_name"))
    acc = acc.join(ops, "operator_id", "left")
    shops = explode_store_ids(acc, keep=("account", "sales_name", "city_name", "operator_name"))
    attrs = F.struct(
        F.coalesce(F.col("operator_name"), F.lit("")).alias("operator"),
        F.coalesce(F.col("sales_name"), F.lit("")).alias("sales"),
        F.coalesce(F.col("city_name"), F.lit("")).alias("city"),
    )
    return (shops.groupBy("shop_id")
            .agg(F.max_by(attrs, F.struct("account", "pos")).alias("a"))
            .select("shop_id", "a.operator", "a.sales", "a.city"))


def region_dim(tables: ReportTables, accounts: Accounts = None) -> DataFrame:
    """G2 + G3: shop_id -> (region_city, region_district, region_business)."""
    acc = filter_accounts(
        tables.platform_accounts.where(F.col("compareRegions_json").isNotNull())
        .select("account", "compareRegions_json"), accounts)
    rows = explode_regions(acc)
    attrs = F.struct("region_city", "region_district", "region_business")
    return (rows.groupBy("shop_id")
            .agg(F.max_by(attrs, F.struct("account", "pos")).alias("r"))
            .select("shop_id", "r.region_city", "r.region_district", "r.region_business"))


def shop_filter(tables: ReportTables, accounts: Accounts = None, shop_id: str | None = None,
                shop_ids: Sequence[str] | DataFrame | None = None,
                unresolved: str = "none") -> DataFrame | Column | None:
    """The shops a report is limited to: a predicate, a DataFrame of shop ids
    (for a left semi join), or None for no limit.

    * ``shop_id`` (P6) replaces the account filter -> ``shop_id = x``; the empty id names no shop (P5),
      with ``unresolved='all'`` it counts as not given;
    * ``shop_ids`` (P7), a list (-> ``shop_id IN (...)``) or a DataFrame with
      ``shop_id`` (for sets too large for the text of a plan);
    * ``accounts`` (P4) resolve through ``stores_json`` -> DataFrame.

    Literal predicates reach the parquet scans as pushed filters (row groups of
    other shops are skipped); sets of unbounded size stay joins.

    P5: when a filter is given and names or resolves to no shop, however it was
    given, ``unresolved='none'`` (default) reports no shop; ``'all'`` keeps the
    original fail-open behaviour (no filter). Deciding ``'all'`` for a DataFrame or
    for accounts takes one small ``isEmpty`` job.
    """
    if unresolved not in ("none", "all"):
        raise ValueError(f"unresolved must be 'none' or 'all', not {unresolved!r}")
    if shop_id is not None and str(shop_id):
        return F.col("shop_id") == F.lit(str(shop_id))
    if shop_id is not None and unresolved == "none":
        return F.lit(False)
    shop_ids, accounts = given(shop_ids, unresolved), given(accounts, unresolved)
    if isinstance(shop_ids, list):
        return F.col("shop_id").isin(sorted(set(shop_ids))) if shop_ids else F.lit(False)
    if shop_ids is not None:
        shops = shop_ids.select(F.col("shop_id").cast("string").alias("shop_id")).distinct()
    elif accounts is not None:
        shops = resolved_shops(tables, accounts)
    else:
        return None
    return None if unresolved == "all" and shops.isEmpty() else shops


def apply_shop_filter(df: DataFrame, shops: DataFrame | Column | None) -> DataFrame:
    """Restrict rows with a ``shop_id`` column to the shops of ``shop_filter``."""
    if shops is None:
        return df
    if isinstance(shops, Column):
        return df.where(shops)
    return df.join(shops, "shop_id", "left_semi")
