"""Runs become visible as a whole; an unfinished run is completed from its own rows."""

import glob
import os

import pytest

from shoplens.plans import runner
from shoplens.plans.params import Period
from shoplens.plans.runner import run_daily, run_period
from shoplens.sources.publish import published_runs, read_run, verify_run
from tests.micro import make_tables, store_row

P1, P2 = Period.of("2024-01-01", "2024-01-07"), Period.of("2024-01-08", "2024-01-14")


def _tables(spark, exposure=5):
    return make_tables(spark, store=[store_row("1", "2024-01-03", "A", exposure_users=exposure), store_row("2", "2024-01-10", "B"), store_row("3", "2024-01-10", "A")])


def test_a_run_is_published_with_counts_and_checksums(spark, scratch):
    folder = run_period(_tables(spark), P1, P2, scratch)
    assert [os.path.basename(x) for x in published_runs(spark, scratch)] == [os.path.basename(folder)]
    assert read_run(spark, folder, "summary").count() == 24 and verify_run(spark, folder) == {}
    with pytest.raises(KeyError):
        read_run(spark, folder, "nothing")
    for part in glob.glob(f"{folder}/wide/*.parquet"):
        os.remove(part)
    read_run(spark, folder, "trend").limit(5).write.mode("overwrite").parquet(f"{scratch}/other")
    assert verify_run(spark, folder)["wide"]


def test_changed_rows_are_found(spark, scratch):
    folder = run_period(_tables(spark), P1, P2, scratch)
    other = read_run(spark, folder, "wide").replace("A", "Z", ["shop_name"])
    rows = other.collect()
    spark.createDataFrame(rows, other.schema).write.mode("overwrite").parquet(f"{folder}/wide")
    assert verify_run(spark, folder) == {"wide": "other rows than published"}


def test_a_killed_run_is_invisible_and_completed_from_its_rows(spark, scratch, monkeypatch):
    real, done = runner.write_table, []

    def dies(df, path, *args, **kw):
        if len(done) == 2:
            raise KeyboardInterrupt
        done.append(path)
        real(df, path, *args, **kw)

    monkeypatch.setattr(runner, "write_table", dies)
    with pytest.raises(KeyboardInterrupt):
        run_period(_tables(spark), P1, P2, scratch)
    name = os.path.basename(os.path.dirname(done[0]))
    folder = f"{scratch}/{name}"
    assert published_runs(spark, scratch) == []
    with pytest.raises(ValueError):
        read_run(spark, folder, "wide")
    stamps = {p: os.path.getmtime(p) for p in glob.glob(f"{folder}/wide/*.parquet")}
    monkeypatch.setattr(runner, "write_table", lambda df, path, *a, **kw: (done.append(path), real(df, path, *a, **kw)))
    # The inputs have changed since; the run goes on with the rows that it had evaluated.
    again = run_period(_tables(spark, exposure=99), P1, P2, scratch, resume=name)
    assert again == folder and {p: os.path.getmtime(p) for p in glob.glob(f"{folder}/wide/*.parquet")} == stamps
    assert len(done) == 5 and len(set(done)) == 5            # two tables before, three after
    assert verify_run(spark, folder) == {} and len(published_runs(spark, scratch)) == 1
    assert {r.shop_id: r.exposure_users_p1 for r in read_run(spark, folder, "wide").collect()} == {"1": 5, "2": 0, "3": 0}
    assert read_run(spark, folder, "detail").where("row_no = 3 and seq = 1").first().p1 == "5"
    # A published run is left as it is, another request can't take its name.
    assert run_period(_tables(spark, exposure=99), P1, P2, scratch, resume=name) == folder
    with pytest.raises(ValueError):
        run_period(_tables(spark), P1, P1, scratch, resume=name)


def test_a_half_written_table_is_written_again(spark, scratch):
    folder = run_daily(_tables(spark), "2024-01-10", scratch)
    name = os.path.basename(folder)
    for gone in ("manifest", "receipts/summary", "summary"):
        os.remove(glob.glob(f"{folder}/{gone}/part-*")[0])
    assert published_runs(spark, scratch) == []
    assert run_daily(_tables(spark), "2024-01-10", scratch, resume=name) == folder
    assert verify_run(spark, folder) == {} and read_run(spark, folder, "summary").count() == 2


def test_csv_and_empty_runs(spark, scratch):
    folder = run_daily(_tables(spark), "2024-01-10", scratch, fmt="csv")
    assert verify_run(spark, folder) == {} and read_run(spark, folder, "detail").count() == 78
    with pytest.warns(UserWarning):
        assert run_daily(_tables(spark), "2023-01-10", scratch, on_empty="warn") is None
    assert published_runs(spark, scratch) == published_runs(spark, scratch + "/") and len(published_runs(spark, scratch)) == 1
    assert published_runs(spark, scratch + "/none") == []
