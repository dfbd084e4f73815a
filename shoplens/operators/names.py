"""Unique section names (T5, W2) without a name that two sections of a group share.

The original gave the second, third ... use of a name the suffix ``_2``, ``_3`` ..., and its
workbook library then kept titles apart that still met, whatever their case. The rule
here says it in one go, by group (a date, or the whole report), upper and lower case being one:

* the first section (in ``order``) of each name keeps it as it is;
* the others share their *stem*, the name's first ``SECTION_NAME_DUP_KEEP`` characters, with all
  waiting sections of that stem: in order, each takes ``stem_n`` with the least n >= 2 that no
  earlier one took and that no section has as its own name.

Names made from different stems differ, since a made name says its stem and its number, so one round
settles all of them. Without a clash n is the occurrence number.

Nothing is searched: with the taken numbers t_1 < t_2 < ... of a stem, t_j has t_j - j - 1 free
numbers below it, so the k-th waiting section passes as many taken numbers as have that below k. Both kinds
of rows are put in that order by ``ranks.numbered``, and a section's place there, plus one, is its number.
A name that a third of all sections share, or a stem with a million numbered names, is split like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.functions import labels as L
from shoplens.functions import texts as X
from shoplens.operators.ranks import ROWS_PER_RANGE, numbered, stored

#: Numbers in own names that count as taken; longer ones are never reached.
_NUMBERED = r"^(.*)_([1-9][0-9]{0,17})$"


def unique_names(rows: DataFrame, clean: str, groups: Sequence[str] = (), order: str = "seq", out: str = "sheet_name",
                 rows_per_range: int = ROWS_PER_RANGE, count: int | None = None) -> DataFrame:
    """``rows`` with ``out``, unique in each group also when case is ignored.

    ``rows`` should be cheap to read; (groups, order) tells them apart; ``clean`` is a name, not NULL.
    """
    named = rows.withColumn("__fold", F.lower(clean))
    placed = numbered(named, [order], [*groups, "__fold"], "__no", rows_per_range, count)
    stem = F.lower(F.substring(clean, 1, X.SECTION_NAME_DUP_KEEP))
    key = [*groups, "__stem"]
    waiting = placed.where("__no > 1").select(*groups, order, "__fold", stem.alias("__stem"))
    taken = (placed.where(F.col("__no") == 1).select(*groups, F.regexp_extract("__fold", _NUMBERED, 1).alias("__stem"),
                                                       F.regexp_extract("__fold", _NUMBERED, 2).alias("__t"))
             .where("__t <> ''").withColumn("__t", F.col("__t").cast("long")).where("__t > 1"))
    # Only stems with several waiting names, or with a taken number, need more than the occurrence number.
    stems = waiting.groupBy(*key).agg((F.min("__fold") != F.max("__fold")).alias("__many"))
    own = [*[F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in key]]
    met = stems.alias("a").join(taken.select(*key).distinct().alias("b"), own, "left").select("a.*", F.col("b.__stem").isNotNull().alias("__met"))
    clash = met.where("__many OR __met").select(*key)
    number = F.col("__no")
    if not clash.isEmpty():
        clash = stored(clash, "name-clashes")
        held = lambda df: df.alias("a").join(clash.alias("b"), own, "left_semi")
        queue = numbered(stored(held(waiting).select(*key, order), "names-waiting"), [order], key, "__v", rows_per_range)
        marks = numbered(stored(held(taken).select(*key, "__t"), "names-taken"), ["__t"], key, "__j", rows_per_range)
        both = (queue.select(*key, "__v", F.lit(0).alias("__kind"), F.col(order).cast("long").alias("__of"))
                .unionByName(marks.select(*key, (F.col("__t") - F.col("__j") - 1).alias("__v"), F.lit(1).alias("__kind"), F.lit(None).cast("long").alias("__of"))))
        merged = numbered(stored(both, "names-merged"), ["__v", "__kind"], key, "__at", rows_per_range)
        found = merged.where("__kind = 0").select(*[F.col(g).alias(f"__g_{g}") for g in groups], F.col("__of").alias("__g_order"), (F.col("__at") + 1).alias("__n"))
        same = [F.col(g).eqNullSafe(F.col(f"__g_{g}")) for g in groups] + [F.col(order) == F.col("__g_order")]
        placed = placed.join(found, same, "left")
        number = F.when(F.col("__no") > 1, F.coalesce("__n", "__no")).otherwise(F.lit(1))
    name = F.expr(L.numbered_section_name(clean, "__n_of"))
    return placed.withColumn("__n_of", number).withColumn(out, name).select(*rows.columns, out)
