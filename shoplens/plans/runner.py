"""Report runs: build, check for data (P13), write and publish (K1-K3).

A run evaluates the report's rows (one per shop, or shop and date) once: they are the run's first table,
the empty check counts them, and every other table is made from them. The run becomes
visible when its manifest is written; ``resume`` names an unfinished run, of which the tables that are done
stay and the others are made from the rows that it stored.
"""

from __future__ import annotations

from shoplens.plans.daily import daily_report
from shoplens.plans.params import Period, parse_date
from shoplens.plans.period import period_report
from shoplens.sources.publish import Run
from shoplens.sources.sinks import check_not_empty, daily_run_prefix, legacy_name, period_run_prefix, run_name, write_table


def _filter(value):
    """A filter as the run's request shows it; a table of shops or accounts is not read for that."""
    return value if value is None or isinstance(value, str) else "a table" if hasattr(value, "columns") else sorted(map(str, value))


def _write_run(report, run: Run, what: str, on_empty: str, partition_by_sheet: bool) -> str | None:
    if run.published:
        return run.folder
    report.kept = run.rows(report.rows)
    if not check_not_empty(report.kept, on_empty, what):
        return None
    outputs = report.outputs()
    write = lambda df, watched, path: write_table(df, path, run.fmt, partition_by_sheet, mode="overwrite", watched=watched)
    return run.publish({name: run.table(name, df, write) for name, df in outputs.items()})


def run_daily(tables, report_date, root: str, accounts=None, on_empty: str = "raise", fmt: str = "parquet",
              partition_by_sheet: bool = False, legacy_names: bool = False, resume: str | None = None, **options) -> str | None:
    """R1 end to end; returns the run folder, or None when empty and ``on_empty='warn'``."""
    day = parse_date(report_date)
    report = daily_report(tables, day, accounts=accounts, **options)
    name = resume or (legacy_name("daily", day=day) if legacy_names else run_name(daily_run_prefix(day)))
    request = {"report": "daily", "date": str(day), "accounts": _filter(accounts), "options": options, "by_sheet": partition_by_sheet}
    run = Run.open(tables.store_daily.sparkSession, root, name, request, fmt)
    return _write_run(report, run, f"date {day}", on_empty, partition_by_sheet)


def run_period(tables, p1: Period, p2: Period, root: str, accounts=None, shop_id=None, shop_ids=None,
               on_empty: str = "raise", fmt: str = "parquet", partition_by_sheet: bool = False,
               legacy_names: bool = False, kind: str = "weekly", resume: str | None = None, **options) -> str | None:
    """R2-R4 end to end (weekly, monthly and custom differ only in periods, filters and legacy file names)."""
    report = period_report(tables, p1, p2, accounts=accounts, shop_id=shop_id, shop_ids=shop_ids, **options)
    if resume:
        name = resume
    elif legacy_names:
        shops = report.shop_count.first().store_count if kind == "custom" else None
        name = legacy_name(kind, p2=p2, shop_count=shops)
    else:
        name = run_name(period_run_prefix(p2))
    request = {"report": kind, "p1": p1.label, "p2": p2.label, "accounts": _filter(accounts), "shop_id": shop_id, "shop_ids": _filter(shop_ids),
               "options": options, "by_sheet": partition_by_sheet}
    run = Run.open(tables.store_daily.sparkSession, root, name, request, fmt)
    return _write_run(report, run, f"periods {p1.label} / {p2.label}", on_empty, partition_by_sheet)


def run_all(tables, root: str, daily_date=None, weekly=None, monthly=None, custom=None,
            accounts=None, fmt: str = "parquet", **options) -> dict[str, str | Exception | None]:
    """The script's batch — daily, weekly, monthly and custom reports in turn.

    Periods are ``(p1, p2)`` pairs; ``options`` are the writing options of ``run_period``.
    A report that fails (for example no data) is recorded with its error and the
    others still run, as the script did. Returns report kind -> run folder, ``None``
    (not requested) or the error.
    """
    common = dict(accounts=accounts, fmt=fmt, **options)
    jobs = {"daily": (lambda: run_daily(tables, daily_date, root, **common)) if daily_date else None}
    for kind, periods in (("weekly", weekly), ("monthly", monthly), ("custom", custom)):
        jobs[kind] = (lambda k=kind, p=periods: run_period(tables, *p, root, kind=k, **common)) if periods else None
    out: dict[str, str | Exception | None] = {}
    for kind, job in jobs.items():
        if job is None:
            out[kind] = None
            continue
        try:
            out[kind] = job()
        except ValueError as err:        # no data for this report; the others go on
            out[kind] = err
    return out
