"""Numbers from one ordered copy equal a plain row_number; names are unique in any case."""

import random
import re

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shoplens.operators.names import unique_names
from shoplens.operators.ranks import numbered, range_count, stored


def test_numbers_match_row_number_with_skew(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(3000):
        g = "hot" if i % 3 == 0 else f"g{rnd.randint(0, 40)}"      # one group holds a third of the rows
        rows.append((f"{i:05d}", rnd.choice(["d1", "d2", None]), g))
    df = stored(spark.createDataFrame(rows, "k string, day string, grp string").repartition(5), "rows")
    for groups in ([], ["day"], ["day", "grp"]):
        got = numbered(df, ["k"], groups, "n", rows_per_range=200)
        w = (W.partitionBy(*groups) if groups else W.partitionBy(F.lit(1))).orderBy("k")
        want = df.withColumn("n", F.row_number().over(w).cast("long"))
        assert got.exceptAll(want).count() == 0 and got.count() == 3000


def test_ranges_grow_with_the_rows(spark):
    assert [range_count(n, 100) for n in (0, 1, 100, 101, 100_000)] == [1, 1, 1, 2, 1000]
    df = stored(spark.range(2000).selectExpr("concat('a-very-long-shared-prefix-', lpad(cast(id as string), 6, '0')) AS k"), "rows")
    got = numbered(df, ["k"], name="n", rows_per_range=50)
    assert [r.k[-6:] for r in got.orderBy("n").collect()] == [f"{i:06d}" for i in range(2000)]
    files = {f.rsplit("/", 1)[1][:10] for f in numbered(df, ["k"], rows_per_range=50).inputFiles() if "ordered" in f}
    assert len(files) > 30


def test_numbers_of_null_keys_ties_and_empty_tables(spark):
    df = stored(spark.createDataFrame([(None, 1), ("a", 1), ("a", 1), ("b", 1)], "k string, x int"), "rows")
    assert [(r.k, r.n) for r in numbered(df, ["k"], name="n", rows_per_range=1).orderBy("n").collect()] == [(None, 1), ("a", 2), ("a", 3), ("b", 4)]
    assert numbered(df.limit(0), ["k"]).count() == 0
    down = numbered(df, [F.desc_nulls_last("k")], ["x"], "n", rows_per_range=2)
    assert [(r.k, r.n) for r in down.orderBy("n").collect()] == [("b", 1), ("a", 2), ("a", 3), (None, 4)]


def _brute_names(names):
    """Sections in order: own names first, then the least free number behind the stem."""
    kept, out, waiting = set(), [None] * len(names), []
    for i, n in enumerate(names):
        if n.lower() in kept:
            waiting.append(i)
        else:
            kept.add(n.lower())
            out[i] = n
    made = set()
    for i in waiting:
        stem, n = names[i][:28], 2
        while f"{stem}_{n}".lower() in kept or f"{stem}_{n}".lower() in made:
            n += 1
        out[i] = f"{stem}_{n}"
        made.add(out[i].lower())
    return out


@pytest.mark.parametrize("seed", range(4))
def test_names_equal_the_rule_and_are_unique(spark, seed):
    r = random.Random(seed)
    pool = ["A", "a", "A_2", "a_3", "A_02", "A_10", "A_2_2", "x" * 28 + "ab", "X" * 28 + "cd", "x" * 28 + "_2", "é", "É", "A_99999999999999999999", "_2", "Sheet"]
    days = {d: [r.choice(pool) for _ in range(r.randint(0, 60))] + [f"A_{i}" for i in range(2, r.randint(2, 30))] for d in ("d1", "d2", None)}
    rows = [(d, i, n) for d, names in days.items() for i, n in enumerate(names, 1)]
    df = stored(spark.createDataFrame(rows, "day string, seq int, name string").repartition(3), "rows")
    got = {(x.day, x.seq): x.sheet_name for x in unique_names(df, "name", ["day"], rows_per_range=7).collect()}
    want = {(d, i): n for d, names in days.items() for i, n in enumerate(_brute_names(names), 1)}
    assert got == want
    for d in days:
        made = [n.lower() for (x, _), n in got.items() if x == d]
        assert len(set(made)) == len(made)


def test_names_without_a_clash_take_their_occurrence_number(spark):
    names = ["B", "A", "B", "B", "A", "C"]
    df = stored(spark.createDataFrame(list(enumerate(names, 1)), "seq int, name string"), "rows")
    got = [x.sheet_name for x in unique_names(df, "name").orderBy("seq").collect()]
    assert got == ["B", "A", "B_2", "B_3", "A_2", "C"]
    assert not any(re.search("__", c) for c in unique_names(df, "name").columns)
    assert unique_names(df.limit(0), "name").count() == 0
