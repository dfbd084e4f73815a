"""Where intermediate tables go, and how documents are read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it back: lineage ends here,
    and a lost executor costs a reread instead of a recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def wrapped(docs: DataFrame, *plain: str) -> DataFrame:
    """A column ``row`` with all columns of ``docs`` in it, beside copies of some of them: what an operator
    adds next to ``row`` can't meet a column of the caller's. ``row.*`` gives the rows back."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[F.col(f"`{c}`") for c in plain])


def unwrapped(df: DataFrame, columns: list[str], **changed) -> DataFrame:
    """The rows of ``wrapped``, some of their columns replaced."""
    return df.select(*[(changed[c] if c in changed else F.col("row").getField(c)).alias(c) for c in columns])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def picked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of a table with any further columns; the others are not read."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
