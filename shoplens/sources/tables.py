"""The five report inputs as one bundle, and ways to load it.

Columns follow the logical schemas (see FIXTURES.md):

* ``store_daily``      key (shop_id, report_date) — per store-day funnel and money
* ``promotion_daily``  key (shop_id, report_date), sparse — promotion counters
* ``store_stats``      key (store_id, date), sparse — ranks, balance, ad orders
* ``platform_accounts`` one row per account, JSON columns ``stores_json`` and
  ``compareRegions_json``
* ``saas_users``       (id, name) operators

At scale the three fact tables are stored partitioned by their date column, so
every date predicate the plans write becomes a partition filter at the scan.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = ("store_daily", "promotion_daily", "store_stats", "platform_accounts", "saas_users")

# Logical schemas (FIXTURES.md §1), used when a stored table has no data files.
SCHEMAS = {
    "store_daily": (
        "shop_id string, report_date date, shop_name string, city string, exposure_users bigint, "
        "visit_users bigint, order_users bigint, verify_person_count bigint, order_coupon_count bigint, "
        "verify_coupon_count bigint, coupon_pay_order_count bigint, order_sale_amount decimal(18,2), "
        "verify_sale_amount decimal(18,2), verify_after_discount decimal(18,2), promotion_cost decimal(18,2), "
        "promotion_exposure_count bigint, promotion_click_count bigint, new_collect_users bigint, "
        "new_review_count bigint, new_good_review_count bigint, consult_users bigint, intent_rate string"),
    "promotion_daily": (
        "shop_id string, report_date date, view_phone_count bigint, view_address_count bigint, "
        "click_avg_price decimal(18,2), order_count bigint, view_groupbuy_count bigint"),
    "store_stats": (
        "store_id string, date date, order_user_rank int, verify_amount_rank int, checkin_count bigint, "
        "ad_balance decimal(18,2), ad_order_count bigint, is_force_offline int"),
    "platform_accounts": (
        "account string, stores_json string, compareRegions_json string, sales_name string, "
        "city_name string, operator_id bigint"),
    "saas_users": "id bigint, name string",
}


def _read_parquet(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A stored table; an existing folder without data files (nothing was written) reads as empty, a missing one is an error."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as err:
        if "UNABLE_TO_INFER_SCHEMA" not in str(err):
            raise
        return spark.createDataFrame([], SCHEMAS[table])


COLOCATED_CONF = "spark.sql.requireAllClusterKeysForCoPartition"


@contextmanager
def colocated_plans(spark: SparkSession):
    """Within it, joins may use a bucketing on fewer columns than their keys; the session's setting is restored after."""
    before = spark.conf.get(COLOCATED_CONF, None)
    spark.conf.set(COLOCATED_CONF, "false")
    try:
        yield
    finally:
        spark.conf.unset(COLOCATED_CONF) if before is None else spark.conf.set(COLOCATED_CONF, before)


@dataclass(frozen=True)
class ReportTables:
    store_daily: DataFrame
    promotion_daily: DataFrame
    store_stats: DataFrame
    platform_accounts: DataFrame
    saas_users: DataFrame

    @classmethod
    def from_driver_tables(cls, spark: SparkSession, sf_dir: str) -> "ReportTables":
        """Views over the driver's synthetic tables (tests, oracle checks, bench)."""
        from shoplens.sources.fixtures import fixture_views

        return cls(**fixture_views(spark, sf_dir))

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str) -> "ReportTables":
        """One parquet dataset per table under ``root`` (facts date-partitioned)."""
        root = root.rstrip("/")
        return cls(**{t: _read_parquet(spark, f"{root}/{t}", t) for t in TABLE_NAMES}).normalized()

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str, names: dict[str, str] | None = None,
                     colocated: bool = False) -> "ReportTables":
        """Catalog tables; ``names`` maps logical names to stored table names.

        ``colocated=True`` is for facts stored by ``save_colocated`` (bucketed by
        shop): joins on (shop, date) then use the shop buckets instead of a shuffle.
        Plans are made when a report is read, so run its reads inside
        ``with colocated_plans(spark):``. Per date a shop has one row, so a bucket
        cannot be skewed by it.
        """
        if colocated and spark.conf.get(COLOCATED_CONF, "true") != "false":
            raise ValueError("read co-located tables inside 'with colocated_plans(spark):'")
        names = names or {}
        return cls(**{t: spark.table(f"{database}.{names.get(t, t)}") for t in TABLE_NAMES}).normalized()

    def normalized(self) -> "ReportTables":
        """Key and date types the plans expect: shop ids as text (a numeric id
        column is cast, as the original cast ids with ``str``), day columns as
        DATE (a DATETIME column would make ``BETWEEN`` drop most of the last
        day). Columns already of the right type are left untouched, so scans
        keep their partition filters."""
        def fix(df: DataFrame, casts: dict[str, str]) -> DataFrame:
            types = dict(df.dtypes)
            need = {c: t for c, t in casts.items() if c in types and types[c] != t}
            if not need:
                return df
            return df.selectExpr(*[f"CAST({c} AS {need[c]}) AS {c}" if c in need else c for c in df.columns])

        return ReportTables(
            store_daily=fix(self.store_daily, {"shop_id": "string", "report_date": "date"}),
            promotion_daily=fix(self.promotion_daily, {"shop_id": "string", "report_date": "date"}),
            store_stats=fix(self.store_stats, {"store_id": "string", "date": "date"}),
            platform_accounts=fix(self.platform_accounts, {"stores_json": "string",
                                                           "compareRegions_json": "string"}),
            saas_users=self.saas_users,
        )

    def replace(self, **frames: DataFrame) -> "ReportTables":
        vals = {t: getattr(self, t) for t in TABLE_NAMES}
        vals.update(frames)
        return ReportTables(**vals)


def write_tables(tables: ReportTables, root: str, mode: str = "overwrite", num_files: int | None = None) -> None:
    """Store a bundle as parquet: facts partitioned by date so reports prune.

    Fact rows are range-partitioned on (date, shop) before the write: each task
    writes a contiguous slice, so a date gets few, large files clustered by shop
    (row-group statistics then skip other shops), and a shop with very many rows
    is still split across tasks. ``num_files`` defaults to the shuffle partition
    count; size it to about (table size / target file size) on a cluster.
    """
    root = root.rstrip("/")
    spark = tables.store_daily.sparkSession
    n = num_files or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def facts(df: DataFrame, date_col: str, key_col: str, name: str) -> None:
        (df.repartitionByRange(n, date_col, key_col).sortWithinPartitions(date_col, key_col)
         .write.mode(mode).partitionBy(date_col).parquet(f"{root}/{name}"))

    writes = [
        lambda: facts(tables.store_daily, "report_date", "shop_id", "store_daily"),
        lambda: facts(tables.promotion_daily, "report_date", "shop_id", "promotion_daily"),
        lambda: facts(tables.store_stats, "date", "store_id", "store_stats"),
        lambda: tables.platform_accounts.write.mode(mode).parquet(f"{root}/platform_accounts"),
        lambda: tables.saas_users.write.mode(mode).parquet(f"{root}/saas_users"),
    ]
    # Independent writes: submitted together so they share the executors.
    with ThreadPoolExecutor(max_workers=len(writes)) as pool:
        for f in [pool.submit(w) for w in writes]:
            f.result()


def save_colocated(tables: ReportTables, database: str, root: str, buckets: int, mode: str = "overwrite") -> None:
    """Store the bundle as catalog tables with the facts co-located by shop.

    Facts are partitioned by date and bucketed (and sorted) by shop into the
    same number of buckets, so the fact joins on (shop, date) and the per-shop
    rollups read matching buckets without a shuffle (load them with
    ``ReportTables.from_catalog(..., colocated=True)``). Size ``buckets`` so a
    bucket of one day is a reasonable file (e.g. day size / 128 MB).
    """
    spark = tables.store_daily.sparkSession
    root = root.rstrip("/")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{root}/_{database}.db'")

    def facts(df: DataFrame, date_col: str, key_col: str, name: str) -> None:
        (df.repartition(buckets, key_col)                  # one writer per bucket
         .write.mode(mode).format("parquet").partitionBy(date_col)
         .bucketBy(buckets, key_col).sortBy(key_col)
         .option("path", f"{root}/{name}").saveAsTable(f"{database}.{name}"))

    facts(tables.store_daily, "report_date", "shop_id", "store_daily")
    facts(tables.promotion_daily, "report_date", "shop_id", "promotion_daily")
    facts(tables.store_stats, "date", "store_id", "store_stats")
    for name in ("platform_accounts", "saas_users"):
        (getattr(tables, name).write.mode(mode).format("parquet")
         .option("path", f"{root}/{name}").saveAsTable(f"{database}.{name}"))
