"""Relational source (S6): the report inputs read from a database with Spark's
JDBC reader.

Credentials come from the caller, never from code or the environment. A fact table is
read in parallel by predicates that cover its wanted rows exactly once, made from a
histogram that the database computes (rows per day, and id cuts within days of many rows): days of few rows are read
together, a day of many is cut at ids. Cuts are half-open comparisons, of which one is the other's negation, so
negative, textual and any other ids fall on exactly one side; rows without an id go with a
day's first part, and rows without a date, which no report shows but whose shops
a quarantined report must know, have a predicate of their own. Days between two periods are not read.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from shoplens.plans.params import Period
from shoplens.sources.tables import ReportTables

# Logical table -> (stored table name, date column or None). Pass ``sources``
# to map the logical names to the database's own table names.
DEFAULT_SOURCES = {
    "store_daily": ("store_daily", "report_date"),
    "promotion_daily": ("promotion_daily", "report_date"),
    "store_stats": ("store_stats", "date"),
    "platform_accounts": ("platform_accounts", None),
    "saas_users": ("saas_users", None),
}


def jdbc_options(url: str, table: str, user: str | None = None, password: str | None = None,
                 partition_column: str | None = None, lower_bound: str | None = None,
                 upper_bound: str | None = None, num_partitions: int | None = None,
                 fetch_size: int = 10_000, driver: str | None = None) -> dict[str, str]:
    """Options for ``spark.read.format('jdbc')``; a partitioned read needs all four
    of column, bounds and partition count."""
    opts = {"url": url, "dbtable": table, "fetchsize": str(fetch_size)}
    if user is not None:
        opts["user"] = user
    if password is not None:
        opts["password"] = password
    if driver:
        opts["driver"] = driver
    part = (partition_column, lower_bound, upper_bound, num_partitions)
    if any(v is not None for v in part):
        if not all(v is not None for v in part):
            raise ValueError("partitioned JDBC read needs column, lower/upper bound and num_partitions")
        opts.update(partitionColumn=partition_column, lowerBound=str(lower_bound),
                    upperBound=str(upper_bound), numPartitions=str(num_partitions))
    return opts


#: Rows of a fact table that one task reads, about.
ROWS_PER_PARTITION = 2_000_000

# Logical table -> its shop id column.
SHOP_COLUMNS = {"store_daily": "shop_id", "promotion_daily": "shop_id", "store_stats": "store_id"}


def _literal(value) -> str:
    """A cut's id as an SQL literal: numbers as they are, anything else quoted."""
    if isinstance(value, (int, Decimal)) and not isinstance(value, bool):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def wanted_days(periods: Sequence[Period], lookback_days: int = 6) -> list[dt.date]:
    """The days of the periods and the days before each that trailing sums need, once each."""
    return sorted({p.start + dt.timedelta(days=k) for p in periods for k in range(-lookback_days, (p.end - p.start).days + 1)})


def _between(date_column: str, first: dt.date, last: dt.date) -> str:
    # Half-open, so that a column with a time of day keeps all of its last day.
    return f"{date_column} >= '{first}' AND {date_column} < '{last + dt.timedelta(days=1)}'"


def _any_day(date_column: str, days: Sequence[dt.date]) -> str:
    """A condition for the days, run by run."""
    runs: list[list[dt.date]] = []
    for d in days:
        if runs and d - runs[-1][1] == dt.timedelta(days=1):
            runs[-1][1] = d
        else:
            runs.append([d, d])
    return "(" + " OR ".join(f"({_between(date_column, a, b)})" for a, b in runs) + ")"


def histogram_query(table: str, date_column: str, days: Sequence[dt.date]) -> str:
    """Rows per wanted day (``d``, ``n``), as a table expression for the database."""
    return (f"(SELECT CAST({date_column} AS DATE) AS d, COUNT(*) AS n FROM {table} WHERE {_any_day(date_column, days)} "
            f"GROUP BY CAST({date_column} AS DATE)) h")


def cuts_query(table: str, date_column: str, shop_column: str, days: Sequence[dt.date], rows: int) -> str:
    """For days of many rows: (``d``, ``cut``, ``r``), the ids at which a day is cut into parts of about ``rows`` rows.

    ``r`` rises with the ids in the database's own order, which need not be Python's.
    """
    numbered = (f"SELECT CAST({date_column} AS DATE) AS d, {shop_column} AS id, ROW_NUMBER() OVER (PARTITION BY CAST({date_column} AS DATE) ORDER BY {shop_column}) AS r "
                f"FROM {table} WHERE {shop_column} IS NOT NULL AND {_any_day(date_column, days)}")
    return f"(SELECT d, id AS cut, r FROM ({numbered}) x WHERE MOD(r, {rows}) = 0) c"


def split_predicates(counts: dict[dt.date, int], cuts: dict[dt.date, Sequence], date_column: str, shop_column: str, rows: int) -> list[str]:
    """Predicates of about ``rows`` rows each: every row of a counted day, and every row without a date, satisfies exactly one.

    ``cuts`` lists ids of a day, in the database's order; equal neighbours count once. Days that are not cut are
    put together until they have ``rows`` rows.
    """
    out, group, size = [], [], 0

    def close() -> None:
        nonlocal group, size
        if group:
            out.append(_any_day(date_column, group))
        group, size = [], 0

    for d in sorted(counts):
        ids = list(dict.fromkeys(cuts.get(d, ())))
        if not ids:
            if group and size + counts[d] > rows:
                close()
            group.append(d)
            size += counts[d]
            continue
        day = _between(date_column, d, d)
        edges = [f"{shop_column} < {_literal(i)}" for i in ids]
        out.append(f"{day} AND ({edges[0]} OR {shop_column} IS NULL)")
        out += [f"{day} AND NOT ({a}) AND {b}" for a, b in zip(edges, edges[1:])]
        out.append(f"{day} AND NOT ({edges[-1]})")
    close()
    return [*out, f"{date_column} IS NULL"]


def plan_predicates(read: Callable[[str], Iterable], table: str, date_column: str, shop_column: str, periods: Sequence[Period],
                    rows: int = ROWS_PER_PARTITION, lookback_days: int = 6) -> list[str]:
    """The predicates of a fact table from its histogram; ``read`` runs a table expression and returns its rows.

    The histogram has one row a day and the cuts one for each ``rows`` rows, so the driver holds about
    as many values as there will be partitions.
    """
    days = wanted_days(periods, lookback_days)
    as_date = lambda d: d.date() if isinstance(d, dt.datetime) else d
    counts = dict.fromkeys(days, 0) | {as_date(r[0]): int(r[1]) for r in read(histogram_query(table, date_column, days))}
    many = [d for d in days if counts[d] > rows]
    cuts: dict[dt.date, list] = {}
    if many:
        for r in read(cuts_query(table, date_column, shop_column, many, rows)):
            cuts.setdefault(as_date(r[0]), []).append((int(r[2]), r[1]))
    in_order = {d: [i for _, i in sorted(ids, key=lambda x: x[0])] for d, ids in cuts.items()}
    return split_predicates(counts, in_order, date_column, shop_column, rows)


def read_jdbc_tables(spark: SparkSession, url: str, user: str, password: str, dates: Period | Sequence[Period],
                     rows_per_partition: int = ROWS_PER_PARTITION, sources: dict | None = None,
                     driver: str | None = None) -> ReportTables:
    """The five inputs from a database, fact tables cut to the report periods ``dates`` (and their lookback)."""
    sources = sources or DEFAULT_SOURCES
    periods = [dates] if isinstance(dates, Period) else list(dates)
    properties = {"user": user, "password": password, "fetchsize": "10000"} | ({"driver": driver} if driver else {})
    frames: dict[str, DataFrame] = {}
    for logical, (table, date_col) in sources.items():
        if date_col:
            parts = plan_predicates(lambda q: spark.read.jdbc(url, q, properties=properties).collect(), table, date_col, SHOP_COLUMNS[logical],
                                    periods, rows_per_partition)
            frames[logical] = spark.read.jdbc(url, table, predicates=parts, properties=properties)
        else:
            frames[logical] = spark.read.format("jdbc").options(
                **jdbc_options(url, table, user, password, driver=driver)).load()
    return ReportTables(**frames).normalized()
