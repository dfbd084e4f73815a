"""Report sinks (K1-K3) and the empty-result rule.

A report is a set of tidy tables (summary, detail, ...), each written under
``<root>/<run name>/<table>`` (K1); ``shoplens.sources.publish`` makes a run's tables visible together. Tables are written in report order (O1, O2): rows are dealt out by ranges
of (date, number, line), so that the files, in the order of their names, hold
ascending, disjoint ranges and a reader of the whole folder, CSV too, meets the
shops in order. The original wrote one sheet per store (K2); here every detail row
carries its ``sheet_name``, a sheet's lines lie together, and a reader of one
number skips the other row groups. Partitioning the folder by sheet
(``partition_by_sheet=True``) is available for small reports only: with many
shops it would create one directory per shop.
"""

from __future__ import annotations

import datetime as dt
import uuid
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame

from shoplens.plans.params import Period

# FIXED VALUES: run-name prefixes of the daily and period reports, and the
# legacy script's file-name words (daily, weekly, monthly, custom, "shops", "non-food").
DAILY_PREFIX = "日报"
PERIOD_PREFIX = "周报"
LEGACY_DAILY = "日报"
LEGACY_WEEKLY = "周报"
LEGACY_MONTHLY = "月报"
LEGACY_CUSTOM = "自定义"
LEGACY_SHOPS = "家门店"
LEGACY_SEGMENT = "非餐"


def run_name(prefix: str, now: dt.datetime | None = None, token: str | None = None) -> str:
    """K3: ``{prefix}_{YYYYmmddHHMMSS}_{8 hex}`` — unique per run."""
    now = now or dt.datetime.now()
    token = token or uuid.uuid4().hex[:8]
    return f"{prefix}_{now:%Y%m%d%H%M%S}_{token}"


def daily_run_prefix(day: dt.date) -> str:
    return f"{DAILY_PREFIX}_{day:%Y%m%d}"


def period_run_prefix(p2: Period) -> str:
    return f"{PERIOD_PREFIX}_{p2.start:%Y%m%d}_{p2.end:%Y%m%d}"


def legacy_name(kind: str, day: dt.date | None = None, p2: Period | None = None, shop_count: int | None = None,
                now: dt.datetime | None = None) -> str:
    """K3, legacy script names: ``日报 非餐 {date} {ts}``, ``周报|月报 非餐 {p2} {ts}``,
    ``自定义 {n}家门店非餐 {p2} {ts}`` (``shop_count`` from ``report.shop_count``)."""
    ts = f"{(now or dt.datetime.now()):%Y%m%d%H%M%S}"
    if kind == "daily":
        return f"{LEGACY_DAILY} {LEGACY_SEGMENT} {day:%Y%m%d} {ts}"
    span = f"{p2.start:%Y%m%d}~{p2.end:%Y%m%d}"
    if kind in ("weekly", "monthly"):
        word = LEGACY_WEEKLY if kind == "weekly" else LEGACY_MONTHLY
        return f"{word} {LEGACY_SEGMENT} {span} {ts}"
    if kind == "custom":
        return f"{LEGACY_CUSTOM} {shop_count}{LEGACY_SHOPS}{LEGACY_SEGMENT} {span} {ts}"
    raise ValueError(kind)


def check_not_empty(df: DataFrame, on_empty: str = "raise", what: str = "report") -> bool:
    """``raise`` (ValueError, the service) or ``warn`` (the script) on no rows.

    One small ``isEmpty`` job; returns True when there are rows.
    """
    if not df.isEmpty():
        return True
    if on_empty == "raise":
        raise ValueError(f"no data for {what}")
    if on_empty == "warn":
        warnings.warn(f"no data for {what}", stacklevel=2)
        return False
    raise ValueError(f"on_empty must be 'raise' or 'warn', not {on_empty!r}")


def write_report(outputs: dict[str, DataFrame], root: str, name: str, fmt: str = "parquet",
                 partition_by_sheet: bool = False, max_records_per_file: int = 5_000_000,
                 mode: str = "errorifexists") -> str:
    """K1/K2: write every output table of one report run, unpublished; returns the run folder."""
    folder = f"{root.rstrip('/')}/{name}"
    for table, df in outputs.items():
        write_table(df, f"{folder}/{table}", fmt, partition_by_sheet, max_records_per_file, mode)
    return folder


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by_sheet: bool = False, max_records_per_file: int = 5_000_000,
                mode: str = "errorifexists", watched: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """One table in report order; ``watched`` may wrap the rows as they are written."""
    order = [c for c in ("report_date", "seq", "line_no", "row_no") if c in df.columns]
    w = watched(df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df)
    writer = w.write.mode(mode).format(fmt).option("maxRecordsPerFile", max_records_per_file)
    if fmt == "csv":
        writer = writer.option("header", "true")
    if partition_by_sheet and "sheet_name" in df.columns:
        writer = writer.partitionBy("sheet_name")
    writer.save(path)
