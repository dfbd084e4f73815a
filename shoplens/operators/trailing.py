"""Stored trailing totals, corrected by the differences of single days.

For every day the state holds one row per shop with a store-day in the last ``days`` days: that
day's own value, the total over [day - days + 1, day] and how many of those days the shop has. A late
correction of one day reads that day's facts and the state of the ``days`` days whose totals it is part of; the
difference between the new value and the one in the state is added to those totals. The
other days' facts are not read again.

The state is partitioned by day; ``correct`` overwrites just the days it touched. A day without
rows left is kept as one marker row, which readers never see. Totals are sums of whole numbers, so adding
differences gives exactly what summing again would; in ANSI mode an overflow raises in both.

Each correction is first written aside and then put in place of the old days: if a job fails before that, the
state is as it was, and since the difference is taken from the state itself, a correction may be
repeated (a second one finds no difference).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.operators.ranks import stored
from shoplens.plans.params import Period

_SCHEMA = "shop_id string, value long, present boolean, total long, n int, marker boolean, day date"


@dataclass(frozen=True)
class TrailingState:
    """Trailing totals of one counter below ``path``."""
    spark: SparkSession
    path: str
    days: int = 7

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(_SCHEMA).parquet(self.path)

    def totals(self, report: Period) -> DataFrame:
        """(shop_id, report_date, total) for every shop and day of ``report`` with a store-day in the window."""
        rows = self._rows().where(F.col("day").between(F.lit(report.start), F.lit(report.end)) & ~F.col("marker") & (F.col("n") > 0))
        return rows.select("shop_id", F.col("day").alias("report_date"), "total")

    def _daily(self, facts: DataFrame, value: str, shop: str, date: str, first: dt.date, last: dt.date) -> DataFrame:
        """One row per shop and day; NULL values count as 0, but the shop-day is there."""
        rows = facts.where(F.col(date).between(F.lit(first), F.lit(last)))
        return (rows.groupBy(F.col(shop).cast("string").alias("shop_id"), F.col(date).alias("day"))
                .agg(F.coalesce(F.sum(value), F.lit(0)).cast("long").alias("value")))

    def _spread(self, rows: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
        """Every row to the days whose totals it is part of: at most ``days`` rows for one."""
        steps = F.explode(F.sequence(F.lit(0), F.lit(self.days - 1)))
        out = rows.select("*", steps.alias("step")).withColumn("to", F.date_add("day", F.col("step")))
        return out.where(F.col("to").between(F.lit(first), F.lit(last)))

    def build(self, facts: DataFrame, value: str, report: Period, shop: str = "shop_id", date: str = "report_date") -> None:
        """The state of all days of ``report`` from the facts of those days and the ``days`` - 1 before them."""
        daily = self._daily(facts, value, shop, date, report.start - dt.timedelta(days=self.days - 1), report.end)
        sums = self._spread(daily, report.start, report.end).groupBy("shop_id", F.col("to").alias("day")).agg(
            F.max(F.when(F.col("step") == 0, F.col("value"))).alias("value"), F.max(F.col("step") == 0).alias("present"),
            F.sum("value").alias("total"), F.count(F.lit(1)).cast("int").alias("n"))
        self._put(sums, [report.start + dt.timedelta(days=k) for k in range((report.end - report.start).days + 1)])

    def correct(self, facts: DataFrame, value: str, days: Iterable[dt.date], shop: str = "shop_id", date: str = "report_date") -> list[dt.date]:
        """Take over changed days of the state: their facts are read and the totals they are part of corrected.

        Returns the days whose state was written. Only days that the state holds are corrected; a
        day before or after them is taken into account when the state is built.
        """
        held = {r.day for r in self._rows().select("day").distinct().collect()}          # one value per day
        done: set[dt.date] = set()
        for changed in sorted(set(days) & held):
            touched = [d for k in range(self.days) if (d := changed + dt.timedelta(days=k)) in held]
            old = self._rows().where((F.col("day") == F.lit(changed)) & ~F.col("marker")).select("shop_id", F.col("value").alias("was"), F.col("present").alias("was_there"))
            new = self._daily(facts, value, shop, date, changed, changed).select(F.col("shop_id").alias("id"), "value")
            both = old.join(new, F.col("shop_id").eqNullSafe(F.col("id")), "full")
            here, before = F.col("value").isNotNull(), F.coalesce("was_there", F.lit(False))
            delta = both.select(F.when(here, F.col("id")).otherwise(F.col("shop_id")).alias("id"), "value", here.alias("here"),
                                (F.coalesce("value", F.lit(0)) - F.when(before, F.coalesce("was", F.lit(0))).otherwise(F.lit(0))).alias("more"),
                                (here.cast("int") - before.cast("int")).alias("days_more"))
            delta = delta.where("more <> 0 OR days_more <> 0")
            spread = delta.withColumn("to", F.explode(F.array(*[F.lit(d) for d in touched])))        # ``days`` of them at most
            state = self._rows().where(F.col("day").isin(touched) & ~F.col("marker"))
            merged = state.join(spread, state["shop_id"].eqNullSafe(spread["id"]) & (state["day"] == spread["to"]), "full")
            own = F.col("to").isNotNull() & (F.col("to") == F.lit(changed))
            out = merged.select(
                F.when(F.col("day").isNull(), F.col("id")).otherwise(F.col("shop_id")).alias("shop_id"),
                F.when(own, spread["value"]).otherwise(state["value"]).alias("value"),
                F.when(own, F.col("here")).otherwise(F.coalesce("present", F.lit(False))).alias("present"),
                (F.coalesce("total", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("total"),
                (F.coalesce("n", F.lit(0)) + F.coalesce("days_more", F.lit(0))).alias("n"),
                F.coalesce("day", "to").alias("day"))
            self._put(stored(out.where("n > 0"), "trailing-days"), touched)
            done.update(touched)
        return sorted(done)

    def _put(self, rows: DataFrame, days: list[dt.date]) -> None:
        marks = self.spark.createDataFrame([(d,) for d in days], "day date").withColumn("marker", F.lit(True))
        out = rows.withColumn("marker", F.lit(False)).unionByName(marks, allowMissingColumns=True).select("shop_id", "value", "present", "total", "n", "marker", "day")
        (out.repartitionByRange("day", "shop_id").sortWithinPartitions("day", "shop_id")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(self.path))
