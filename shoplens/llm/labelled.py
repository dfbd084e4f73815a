"""A bounded sample of labelled documents, for the classifiers trained here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STEPS = 1 << 30


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id's text, modulo ``folds``; NULL for a NULL id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def sampled(rows: DataFrame, id_col: str, most: int, total: int) -> DataFrame:
    """About ``most`` of ``total`` rows at most, picked by a hash of the id: the
    same rows for the same table, on any cluster, without a sort."""
    if total <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(_STEPS)) < F.lit(int(_STEPS * most / total)))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: int,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label) of labelled documents outside the held-out fold, ``most`` at most.

    Rows without a label of 0 or 1 are left out; a document labelled twice with
    different values counts once for each.
    """
    own = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    own = own.where(F.col("label").isin(0, 1) & (fold("doc_id", folds) != held_out)).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return sampled(own, "doc_id", most, own.count()).join(texts, "doc_id")
