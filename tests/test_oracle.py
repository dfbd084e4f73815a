"""Every registered query against its DuckDB oracle on sf0.001 (the driver runs sf0.01)."""

import duckdb
import pytest

from shoplens import queries as E
from tools.oracle_check import rows_of

SF = "/root/testdata/sf0.001"
QUERIES = E.queries()
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "events"):
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF)
    srows = [tuple(r) for r in sdf.collect()]
    res = con.execute(SQL[name])
    dcols = [c[0] for c in res.description]
    drows = res.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert rows_of(sdf.columns, srows) == rows_of(dcols, drows)


def test_every_query_has_an_oracle():
    assert set(SQL) == set(QUERIES)


def test_oracle_sees_a_wrong_denominator(spark, con, monkeypatch):
    """The oracle shares no metric table with the plans: a swapped denominator shows."""
    from shoplens.plans import period

    def wrong(block):
        return [(n, k, ("new_collect", "order_users")) if n == "collect_rate" else (n, k, a) for n, k, a in block]

    monkeypatch.setattr(period, "BLOCK2", wrong(period.BLOCK2))
    monkeypatch.setattr(period, "METRICS", wrong(period.METRICS))
    sdf = QUERIES["weekly_wide"](spark, SF)
    got = rows_of(sdf.columns, [tuple(r) for r in sdf.collect()])
    res = con.execute(SQL["weekly_wide"])
    assert got != rows_of([c[0] for c in res.description], res.fetchall())


def test_oracle_imports_nothing_of_the_plans():
    import ast
    import inspect

    from shoplens import oracle

    names = {n.module for n in ast.walk(ast.parse(inspect.getsource(oracle))) if isinstance(n, ast.ImportFrom)}
    assert not any(m.startswith(("shoplens.operators", "shoplens.plans.period", "shoplens.plans.daily")) for m in names)
