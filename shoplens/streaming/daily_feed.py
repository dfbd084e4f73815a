"""The daily report as a Structured Streaming job.

Store-day fact files arrive in a folder (one batch per load). Each micro-batch
carries new or corrected store-days; for the dates it touches and the six days
after each (whose 7-day totals include the touched day), and no others, the daily
report is rebuilt from the stored tables and written with dynamic partition overwrite by
``report_date``. The stream's checkpoint records which files are done, so a
restarted job neither skips nor repeats a load, and re-running a date replaces
that date's report atomically per partition.

This is the original script's "run the reports in turn" (R5) as an
incremental job; it adds no report logic of its own.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from shoplens.plans.daily import TRAILING_DAYS, daily_report
from shoplens.plans.params import Period
from shoplens.sources.tables import ReportTables


def _write_dates(df: DataFrame, path: str) -> None:
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("report_date").parquet(path))


def rebuild_periods(touched: Sequence[dt.date]) -> list[Period]:
    """Each touched day and the days after it whose trailing totals include it, merged into runs."""
    days = sorted({d + dt.timedelta(days=k) for d in touched for k in range(TRAILING_DAYS)})
    runs: list[list[dt.date]] = []
    for d in days:
        if runs and d - runs[-1][-1] == dt.timedelta(days=1):
            runs[-1].append(d)
        else:
            runs.append([d])
    return [Period(r[0], r[-1]) for r in runs]


def daily_feed(spark: SparkSession, incoming_dir: str, tables: Callable[[], ReportTables], out_dir: str,
               checkpoint_dir: str, accounts=None, available_now: bool = True,
               schema: str | None = None) -> StreamingQuery:
    """Start the stream; ``tables()`` returns the current stored inputs.

    ``incoming_dir`` holds store-day parquet files; ``out_dir`` gets
    ``summary`` and ``detail`` partitioned by ``report_date``.
    """
    if schema is None:
        schema = tables().store_daily.schema
    stream = spark.readStream.schema(schema).parquet(incoming_dir)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        # The calendar days of this load (no rows go to the driver), as runs of days to rebuild.
        touched = [r.report_date for r in batch.select("report_date").where("report_date IS NOT NULL").distinct().collect()]
        for dates in rebuild_periods(touched):
            report = daily_report(tables(), dates, accounts=accounts)
            for name, df in report.outputs().items():
                _write_dates(df, f"{out_dir.rstrip('/')}/{name}")

    writer = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
