"""Running numbers over stored rows, from one ordered copy of them.

The rows are written once, dealt out by ranges of (groups, order) and sorted in
each range; a row's place in its range is kept beside it. How many rows of a group
lie in the ranges before is then known from the ranges' counts, so a number is an
offset and a difference, without a window over all rows and without reading what
the rows came from again. The number of ranges grows with the rows
(``ROWS_PER_RANGE`` each), the counts have one row per range and group, and a group or
an order value that holds most of all rows is split like any other, as long as
the rest of the order tells its rows apart. Rows of a single range, ``ROWS_PER_RANGE`` at most, are numbered by
one task without a copy.

The table given is read three times (count, range sample, copy), so it should be a
stored one; ``stored`` writes one in the session's shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shoplens.session import ensure_checkpoint_dir

ROWS_PER_RANGE = 1 << 18
_PLACE_BITS = 33                       # monotonically_increasing_id: partition above, place below


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table below the checkpoint folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def range_count(rows: int, rows_per_range: int = ROWS_PER_RANGE) -> int:
    """How many ranges ``rows`` rows are dealt to: one at least, growing with the rows."""
    return max(1, -(-rows // rows_per_range))


def numbered(rows: DataFrame, order: Sequence[Column | str], groups: Sequence[str] = (), name: str = "seq",
             rows_per_range: int = ROWS_PER_RANGE, count: int | None = None) -> DataFrame:
    """``rows`` with ``name`` = 1..n (long) in ``order`` within each group.

    Rows that are equal in groups and order take consecutive numbers, in no stated
    order: name enough columns to tell different rows apart. NULL groups are a group.
    An empty table gives an empty table.
    """
    place, piece = f"__{name}_place", f"__{name}_range"
    parts = range_count(rows.count() if count is None else count, rows_per_range)
    if parts == 1:                     # one range is one task's share: numbered where it is read, without a copy
        here = W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))
        return rows.coalesce(1).withColumn(name, F.row_number().over(here.orderBy(*order)).cast("long"))
    by = [*[F.asc_nulls_first(g) for g in groups], *order]
    dealt = rows.repartitionByRange(parts, *by)
    kept = stored(dealt.sortWithinPartitions(*by).withColumn(place, F.monotonically_increasing_id()), "ordered")
    kept = kept.withColumn(piece, F.shiftrightunsigned(place, _PLACE_BITS).cast("int"))
    before = (W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))).orderBy(piece).rowsBetween(W.unboundedPreceding, -1)
    sizes = kept.groupBy(piece, *groups).agg(F.min(place).alias("__first"), F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select(F.col(piece).alias("__piece"), *[F.col(g).alias(f"__of_{g}") for g in groups],
                           (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1).alias("__shift"))
    cond = [F.col(piece) == F.col("__piece")] + [F.col(g).eqNullSafe(F.col(f"__of_{g}")) for g in groups]
    return kept.join(offsets, cond).select(*rows.columns, (F.col(place) + F.col("__shift")).alias(name))
