"""Publication of report runs (K1, K3): all tables of a run appear together, or not at all.

A run's folder is filled in steps that can be repeated:

1. ``request``: what was asked for, so that only the same request can resume the run;
2. ``rows``, with a receipt of its own: the report's evaluated rows, from which every table is made, also after a failure;
3. one folder per table, each followed by its receipt (``receipts/<table>``: rows, checksum);
4. ``manifest``: the receipts of all tables. It is written last, and readers
   (``published_runs``, ``read_run``) see only runs that have one.

Small files are written as one-row text tables by Spark, so that any storage that Spark writes to will do; their
one file appears when Spark commits the write. A table without its receipt was not finished and is
overwritten when the run is resumed. The checksum is the sum of a 64-bit hash of every row, so it
depends on the rows and not on their files; it is collected while the table is written and
``verify_run`` computes it again from what is stored.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

MANIFEST, REQUEST, RECEIPTS, ROWS = "manifest", "request", "receipts", "rows"


def _row_hash(df: DataFrame) -> Column:
    # As text, so that the sum is the same for every column order of a reader's schema and for maps of types.
    return F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in sorted(df.columns)])


def _figures(df: DataFrame) -> list[Column]:
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(_row_hash(df).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("checksum")]


def _note(spark: SparkSession, path: str, content: dict) -> None:
    text = json.dumps(content, ensure_ascii=False, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _noted(spark: SparkSession, path: str) -> dict | None:
    """A note, or None if there is none, or only the beginning of one."""
    try:
        lines = spark.read.text(path).collect()
        return json.loads(lines[0].value) if lines else None
    except (AnalysisException, json.JSONDecodeError):
        return None


@dataclass(frozen=True)
class Run:
    """One run's folder."""
    spark: SparkSession
    folder: str
    fmt: str = "parquet"

    @classmethod
    def open(cls, spark: SparkSession, root: str, name: str, request: dict, fmt: str = "parquet") -> "Run":
        """A new run, or the unfinished one of that name and the same request."""
        run = cls(spark, f"{root.rstrip('/')}/{name}", fmt)
        asked = json.loads(json.dumps({**request, "format": fmt}, default=str))
        before = _noted(spark, f"{run.folder}/{REQUEST}")
        if before is None:
            _note(spark, f"{run.folder}/{REQUEST}", asked)
        elif before != asked:
            raise ValueError(f"run {name} was started for another request")
        return run

    @property
    def published(self) -> bool:
        return _noted(self.spark, f"{self.folder}/{MANIFEST}") is not None

    def rows(self, rows: DataFrame) -> DataFrame:
        """The run's evaluated rows: stored by the first attempt, read by every later one."""
        path, mark = f"{self.folder}/{ROWS}", f"{self.folder}/{RECEIPTS}/{ROWS}"
        if _noted(self.spark, mark) is None:
            rows.write.mode("overwrite").parquet(path)
            _note(self.spark, mark, {"columns": rows.columns})
        return self.spark.read.schema(rows.schema).parquet(path)

    def table(self, name: str, df: DataFrame, write) -> dict:
        """Write a table with ``write(df, path)`` unless its receipt is there; returns the receipt."""
        place = f"{self.folder}/{RECEIPTS}/{name}"
        receipt = _noted(self.spark, place)
        if receipt is None:
            seen = Observation()
            write(df, lambda ordered: ordered.observe(seen, *_figures(ordered)), f"{self.folder}/{name}")
            receipt = {"rows": seen.get["rows"], "checksum": seen.get["checksum"], "columns": df.columns}
            _note(self.spark, place, receipt)
        return receipt

    def publish(self, receipts: dict[str, dict]) -> str:
        request = _noted(self.spark, f"{self.folder}/{REQUEST}")
        _note(self.spark, f"{self.folder}/{MANIFEST}", {"request": request, "tables": receipts})
        return self.folder


def published_runs(spark: SparkSession, root: str) -> list[str]:
    """The folders below ``root`` that hold a whole run, in the order of their names."""
    root = root.rstrip("/")
    try:
        files = spark.read.text(f"{root}/*/{MANIFEST}").select(F.col("_metadata.file_path").alias("f")).distinct().collect()
    except AnalysisException:
        return []
    names = {unquote(r.f).rsplit(f"/{MANIFEST}/", 1)[0].rsplit("/", 1)[1] for r in files}
    return [f"{root}/{n}" for n in sorted(names) if _noted(spark, f"{root}/{n}/{MANIFEST}") is not None]


def read_run(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table of a published run; an unpublished run has none."""
    folder = folder.rstrip("/")
    manifest = _noted(spark, f"{folder}/{MANIFEST}")
    if manifest is None:
        raise ValueError(f"{folder} holds no published run")
    if table not in manifest["tables"]:
        raise KeyError(f"{folder} has no table {table}")
    reader = spark.read.format(manifest["request"]["format"])
    if manifest["request"]["format"] == "csv":
        reader = reader.option("header", "true")
    return reader.load(f"{folder}/{table}")


def verify_run(spark: SparkSession, folder: str) -> dict[str, str]:
    """What is wrong with a published run's tables: {table: finding}; empty if all is as published.

    A CSV file keeps no types and no NULLs, so of CSV tables the rows are counted, not compared.
    """
    manifest = _noted(spark, f"{folder.rstrip('/')}/{MANIFEST}")
    if manifest is None:
        return {MANIFEST: "missing"}
    wrong = {}
    for table, receipt in manifest["tables"].items():
        if not receipt["rows"]:
            continue                                   # an empty CSV table may have no file to read
        try:
            df = read_run(spark, folder, table)
            now = df.agg(*_figures(df)).first()
        except AnalysisException:
            wrong[table] = "missing"
            continue
        if now["rows"] != receipt["rows"]:
            wrong[table] = f"{now['rows']} rows, {receipt['rows']} published"
        elif manifest["request"]["format"] != "csv" and now["checksum"] != receipt["checksum"]:
            wrong[table] = "other rows than published"
    return wrong
