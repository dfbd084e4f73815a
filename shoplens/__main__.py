"""Command line: build one report run from stored inputs (works under spark-submit).

    python -m shoplens daily   --input ROOT --out OUT --date 2024-01-10 [--accounts a,b]
    python -m shoplens weekly  --input ROOT --out OUT --p1 2024-01-01:2024-01-07 --p2 2024-01-08:2024-01-14
    python -m shoplens monthly --input ROOT --out OUT --p1 ... --p2 ...
    python -m shoplens custom  --input ROOT --out OUT --p1 ... --p2 ... [--shop-id 17 | --shop-ids 3,5]
    python -m shoplens all     --input ROOT --out OUT [--date D] [--weekly P1,P2] [--monthly P1,P2] [--custom P1,P2]

``--input`` is a folder written by ``write_tables`` (or ``--catalog DB`` for
catalog tables). The shop filters hold for every period report; a filter that
names no shop follows ``--unresolved``. Prints the run folder (``all``: one line a
report); exits 1 when a report has no data (``--on-empty warn``: prints a warning).
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from shoplens.plans.params import Period
from shoplens.plans.runner import run_all, run_daily, run_period
from shoplens.sources.tables import ReportTables


def _period(text: str) -> Period:
    start, _, end = text.partition(":")
    return Period.of(start, end or start)


def _pair(text: str | None) -> tuple[Period, Period] | None:
    return tuple(_period(x) for x in text.split(",")) if text else None


def _list(text: str | None) -> list[str] | None:
    """None if not given; "," or "" is a list that names nothing."""
    return None if text is None else [x.strip() for x in text.split(",") if x.strip()]


def _parser() -> argparse.ArgumentParser:
    ap = argparse.ArgumentParser(prog="shoplens")
    ap.add_argument("report", choices=["daily", "weekly", "monthly", "custom", "all"])
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--input", help="folder written by write_tables")
    src.add_argument("--catalog", help="database holding the five tables")
    ap.add_argument("--out", required=True)
    ap.add_argument("--date")
    ap.add_argument("--p1")
    ap.add_argument("--p2")
    for kind in ("weekly", "monthly", "custom"):
        ap.add_argument(f"--{kind}", help="two periods, START:END,START:END (report 'all')")
    ap.add_argument("--accounts")
    one = ap.add_mutually_exclusive_group()
    one.add_argument("--shop-id")
    one.add_argument("--shop-ids")
    ap.add_argument("--unresolved", default="none", choices=["none", "all"])
    ap.add_argument("--dedupe-right", action="store_true", help="fold duplicate promotion and stats rows")
    ap.add_argument("--legacy", action="store_true", help="legacy status text, legacy summary columns")
    ap.add_argument("--rename", default="sum_latest", choices=["sum_latest", "last_group"])
    ap.add_argument("--by-city", action="store_true", help="legacy custom grouping (with --rename last_group)")
    ap.add_argument("--quarantine", action="store_true", help="leave out shops with rejected store-days, and list them")
    ap.add_argument("--on-empty", default="raise", choices=["raise", "warn"])
    ap.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    ap.add_argument("--per-sheet", action="store_true", help="one folder per sheet (small reports only)")
    ap.add_argument("--legacy-names", action="store_true", help="the legacy script's run names")
    return ap


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    ap = _parser()
    args = ap.parse_args(argv)
    period = args.report in ("weekly", "monthly", "custom")
    if not period and (args.shop_id or args.shop_ids is not None):
        ap.error(f"{args.report} takes no shop filter")
    if args.report == "daily" and not args.date:
        ap.error("daily needs --date")
    if period and not (args.p1 and args.p2):
        ap.error(f"{args.report} needs --p1 and --p2")

    spark = spark or SparkSession.builder.appName(f"shoplens-{args.report}").getOrCreate()
    tables = (ReportTables.from_parquet(spark, args.input) if args.input
              else ReportTables.from_catalog(spark, args.catalog))
    common = dict(accounts=_list(args.accounts), fmt=args.format, partition_by_sheet=args.per_sheet,
                  legacy_names=args.legacy_names, unresolved=args.unresolved, dedupe_right=args.dedupe_right,
                  legacy=args.legacy, on_empty=args.on_empty)
    if args.report == "all":
        done = run_all(tables, args.out, daily_date=args.date, weekly=_pair(args.weekly), monthly=_pair(args.monthly),
                       custom=_pair(args.custom), **common)
        for kind, result in done.items():
            if result is not None:
                print(f"{kind}\t{result}")
        return int(any(isinstance(r, Exception) for r in done.values()))
    try:
        if args.report == "daily":
            folder = run_daily(tables, args.date, args.out, **common)
        else:
            folder = run_period(tables, _period(args.p1), _period(args.p2), args.out, kind=args.report,
                                shop_id=args.shop_id, shop_ids=_list(args.shop_ids), rename=args.rename,
                                by_city=args.by_city, quarantine=args.quarantine, **common)
    except ValueError as err:            # no data: the service answered 400, the script warned
        print(f"shoplens: {err}", file=sys.stderr)
        return 1
    if folder:
        print(folder)
    return 0


if __name__ == "__main__":
    sys.exit(main())
