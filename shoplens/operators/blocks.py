"""A stored rollup by dyadic blocks of days (A1, A2), for reports over any two periods.

A block of level L holds 2^L days (days since 1970-01-01, so blocks start at multiples of their
length): one row per shop, name and city with the 23 sums of the joined facts and the last
day of that name. Any period is a union of at most two blocks a level, so a report over
n days reads some 2 log2(n) rows a shop instead of n, and needs no fact join. The table is
less than twice as large as its first level.

The table is partitioned by (level, block): a period's blocks are read by partition
filters. ``update`` rebuilds the blocks of touched days, level by level from their two
halves, and overwrites just those partitions; every rewritten block gets one marker row, so that
a block whose last store-day vanished is overwritten too. It can be repeated: after a failure,
run it again with the same days.

``dedupe_right`` (J9) is decided when the table is built: it has a folder for each way.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.operators.dims import apply_shop_filter
from shoplens.operators.facts import PERIOD_SUMS, RollupSpec, flagged_rollup, joined_facts, metric_columns
from shoplens.plans.params import Period

#: Levels 0 .. LEVELS - 1: the longest block has 512 days.
LEVELS = 10
_EPOCH = dt.date(1970, 1, 1)
_KEYS = ["shop_id", "shop_name", "city"]
Block = tuple[int, int]


def day_number(d: dt.date) -> int:
    return (d - _EPOCH).days


def cover(period: Period, levels: int = LEVELS) -> list[Block]:
    """The fewest blocks (level, number) that hold exactly the days of the period; none for a reversed one."""
    lo, hi = day_number(period.start), day_number(period.end) + 1
    out: list[Block] = []
    while lo < hi:
        level = min(levels - 1, (hi - lo).bit_length() - 1, (lo & -lo).bit_length() - 1 if lo else levels - 1)
        out.append((level, lo >> level))
        lo += 1 << level
    return out


def _in_blocks(blocks: Sequence[Block]) -> Column:
    """Whether a row's (level, block) is one of ``blocks``, as plain comparisons that prune partitions."""
    by_level: dict[int, list[int]] = {}
    for level, number in blocks:
        by_level.setdefault(level, []).append(number)
    cond = F.lit(False)
    for level, numbers in sorted(by_level.items()):
        cond = cond | ((F.col("level") == level) & F.col("block").isin(numbers))
    return cond


@dataclass(frozen=True)
class BlockRollup:
    """The stored blocks below ``root``."""
    spark: SparkSession
    root: str
    dedupe_right: bool = False
    levels: int = LEVELS

    @property
    def path(self) -> str:
        return f"{self.root.rstrip('/')}/{'folded' if self.dedupe_right else 'plain'}"

    def rows(self) -> DataFrame:
        """All blocks, without the marker rows."""
        return self._read().where("NOT marker").drop("marker")

    def _read(self) -> DataFrame:
        money = {m for m, *_, kind in PERIOD_SUMS if kind == "money"}
        sums = ", ".join(f"{m} {'decimal(28,2)' if m in money else 'bigint'}" for m, *_ in PERIOD_SUMS)
        schema = f"shop_id string, shop_name string, city string, last date, {sums}, marker boolean, level int, block int"
        return self.spark.read.schema(schema).parquet(self.path)

    def build(self, tables, period: Period) -> None:
        """Blocks of all days of a period (whatever lies there now is replaced)."""
        self._make(joined_facts(tables, [period], dedupe_right=self.dedupe_right),
                   [period.start + dt.timedelta(days=k) for k in range((period.end - period.start).days + 1)])

    def update(self, tables, days: Iterable[dt.date]) -> None:
        """Rebuild the blocks of touched days; only those days' facts are read."""
        days = sorted(set(days))
        runs: list[Period] = []
        for d in days:
            if runs and d - runs[-1].end == dt.timedelta(days=1):
                runs[-1] = Period(runs[-1].start, d)
            else:
                runs.append(Period(d, d))
        if runs:
            self._make(joined_facts(tables, runs, dedupe_right=self.dedupe_right), days)

    def _make(self, joined: DataFrame, days: Sequence[dt.date]) -> None:
        numbers = sorted({day_number(d) for d in days})
        number = F.datediff("report_date", F.lit(_EPOCH))
        rows = (joined.withColumn("block", number).where(F.col("block").between(numbers[0], numbers[-1]) if len(numbers) > 1 else F.col("block") == numbers[0])
                .select(*_KEYS, F.col("report_date").alias("last"), "block", *metric_columns()))
        self._write(rows, 0, numbers)
        for level in range(1, self.levels):
            numbers = sorted({n >> 1 for n in numbers})
            halves = self.rows().where(_in_blocks([(level - 1, 2 * n + k) for n in numbers for k in (0, 1)]))
            self._write(halves.withColumn("block", F.shiftright("block", 1)), level, numbers)

    def _write(self, rows: DataFrame, level: int, numbers: Sequence[int]) -> None:
        sums = [F.sum(m).cast("decimal(28,2)" if kind == "money" else "long").alias(m) for m, *_, kind in PERIOD_SUMS]
        merged = rows.groupBy(*_KEYS, "block").agg(F.max("last").alias("last"), *sums)
        marks = self.spark.createDataFrame([(n,) for n in numbers], "block int").withColumn("marker", F.lit(True))
        out = merged.withColumn("marker", F.lit(False)).unionByName(marks, allowMissingColumns=True).withColumn("level", F.lit(level))
        # A block's rows may be many: dealt out by block and shop, clustered by shop in each file.
        out = out.repartitionByRange("block", "shop_id").sortWithinPartitions("block", "shop_id")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("level", "block").parquet(self.path)

    def touching(self, p1: Period, p2: Period) -> DataFrame:
        """The rows of both periods' blocks, with the flags of the periods that a block belongs to."""
        first, second = cover(p1, self.levels), cover(p2, self.levels)
        rows = self.rows().where(_in_blocks(sorted({*first, *second})))
        return rows.withColumns({"_in1": _in_blocks(first), "_in2": _in_blocks(second)})

    def rollup(self, p1: Period, p2: Period, spec: RollupSpec = RollupSpec(), shops: DataFrame | Column | None = None) -> DataFrame:
        """What ``period_rollup`` gives for the joined facts of both periods."""
        return flagged_rollup(apply_shop_filter(self.touching(p1, p2), shops), spec)
