"""shoplens — store performance reports as Spark DataFrame plans.

Daily summaries, trailing seven-day checks, pass/fail thresholds, rank labels
and two-period comparisons (weekly, monthly, custom) over per-store daily fact
tables and account tables with JSON columns.

Layout:
  sources/    table bundles, fixture views, JDBC options, report sinks
  functions/  column expressions: exact rounding, rate text, labels, JSON
  operators/  dimensions, fact joins and rollups, numbering, layouts, quality
  plans/      report plans (daily, period) and the report runner
  streaming/  the daily report over arriving store-day files
"""

from shoplens.sources.tables import ReportTables
from shoplens.plans.params import Period, parse_date
from shoplens.plans.daily import daily_report
from shoplens.plans.period import custom_report, monthly_report, period_report, weekly_report

__all__ = ["ReportTables", "Period", "parse_date", "daily_report", "period_report", "weekly_report",
           "monthly_report", "custom_report"]
