"""JSON columns of the account table (G1-G4) with built-in JSON functions.

``stores_json`` is a JSON array; each element that is an object with a
non-empty ``shop_id`` names one shop. ``compareRegions_json`` is a JSON object
``{shop_id: {"regions": {"city": {"regionName": ..}, "district": .., "business": ..}}}``.

Malformed values parse to NULL and contribute no rows (G4). The element is kept
as raw JSON text (``array<string>``) so one odd element does not null the whole
array, and ``shop_id`` is read through a struct so a duplicate key keeps the
last value, as a Python ``dict`` does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _is_object(raw: Column) -> Column:
    return F.startswith(F.ltrim(raw), F.lit("{"))


def explode_store_ids(df: DataFrame, json_col: str = "stores_json",
                      keep: tuple[str, ...] = ("account",)) -> DataFrame:
    """G1: one row per (kept columns, pos, shop_id) for every listed shop."""
    elems = df.select(*keep, F.posexplode(F.from_json(F.col(json_col), "array<string>")).alias("pos", "elem"))
    shop = F.from_json(F.col("elem"), "struct<shop_id:string>").getField("shop_id")
    return (elems.where(_is_object(F.col("elem")))
            .select(*keep, "pos", shop.alias("shop_id"))
            .where(F.col("shop_id").isNotNull() & (F.col("shop_id") != "")))


def _region_name(raw: Column, part: str) -> Column:
    """``regions.<part>.regionName`` or '' when absent or of the wrong type."""
    return F.coalesce(F.get_json_object(raw, f"$.regions.{part}.regionName"), F.lit(""))


def explode_regions(df: DataFrame, json_col: str = "compareRegions_json",
                    keep: tuple[str, ...] = ("account",)) -> DataFrame:
    """One row per (kept columns, pos, shop_id, city, district, business).

    An entry counts when its value is an object whose ``regions`` is absent
    (all parts '') or an object; any other shape is skipped.
    """
    entries = df.select(*keep, F.posexplode(F.from_json(F.col(json_col), "map<string,string>"))
                        .alias("pos", "shop_id", "raw"))
    regions_raw = F.get_json_object(F.col("raw"), "$.regions")
    has_regions_key = F.array_contains(F.json_object_keys(F.col("raw")), "regions")
    ok = (_is_object(F.col("raw")) & F.col("raw").isNotNull()
          & (~F.coalesce(has_regions_key, F.lit(False))
             | F.coalesce(_is_object(regions_raw), F.lit(False))))
    return entries.where(ok).select(
        *keep, "pos", F.col("shop_id").cast("string").alias("shop_id"),
        _region_name(F.col("raw"), "city").alias("region_city"),
        _region_name(F.col("raw"), "district").alias("region_district"),
        _region_name(F.col("raw"), "business").alias("region_business"),
    )
