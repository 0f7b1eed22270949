"""Balance intervals against a plain month spine."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerflow.operators.intervals import ALWAYS, MAX_MONTHS, balance_intervals, balances_at

JAN, FEB, APR, JUL = (dt.date(2024, m, 1) for m in (1, 2, 4, 7))


def _intervals(spark, rows, every=None):
    lines = spark.createDataFrame(rows, "acc string, d date, v int").withColumn("amt", F.col("v").cast("decimal(18,2)"))
    every = every and spark.createDataFrame([(k,) for k in every], "acc string")
    return balance_intervals(lines, ["acc"], F.col("d"), F.col("amt"), every)


def _rows(df):
    return sorted((tuple(int(x) if i == 3 else x for i, x in enumerate(r)) for r in df.collect()), key=str)


def test_one_row_for_each_month_that_moves(spark):
    rows = [("a", dt.date(2024, 1, 5), 10), ("a", dt.date(2024, 1, 31), 5), ("a", APR, -15), ("a", JUL, 1),
            ("b", FEB, 3), ("b", dt.date(2024, 4, 9), 4), ("b", dt.date(2024, 4, 10), -4),      # April moves nothing
            (None, FEB, 2), ("c", None, 9), ("d", FEB, None)]
    assert _rows(_intervals(spark, rows)) == sorted([("a", JAN, APR, 15), ("a", APR, JUL, 0), ("a", JUL, None, 1),
                                                     ("b", FEB, None, 3), (None, FEB, None, 2)], key=str)


def test_every_key_has_a_balance_at_all_times(spark):
    got = _intervals(spark, [("a", FEB, 3)], every=["a", "z", "z"])
    assert _rows(got) == [("a", ALWAYS, FEB, 0), ("a", FEB, None, 3), ("z", ALWAYS, None, 0)]
    at = balances_at(got, [JAN, dt.date(2024, 2, 29), FEB])
    assert sorted((r.acc, r.month, int(r.balance)) for r in at.collect()) == [
        ("a", JAN, 0), ("a", FEB, 3), ("z", JAN, 0), ("z", FEB, 0)]


def test_intervals_equal_the_spine(spark):
    rng = random.Random(5)
    rows = [(rng.choice("aaaaabcd"), dt.date(2020 + rng.randrange(4), 1 + rng.randrange(12), 1 + rng.randrange(28)), rng.randrange(-9, 10))
            for _ in range(400)]
    asked = [dt.date(y, m, 1) for y in range(2019, 2025) for m in range(1, 13)]
    got = {(r.acc, r.month): int(r.balance) for r in balances_at(_intervals(spark, rows, every="abcde"), asked).collect()}
    assert got == {(k, m): sum(v for a, d, v in rows if a == k and d.replace(day=1) <= m) for k in "abcde" for m in asked}


def test_rows_are_bound_by_movements_and_months_by_a_check(spark):
    rows = [(k, dt.date(y, 1, 1), 1) for k in "ab" for y in (1900, 2020)]
    i = _intervals(spark, rows)
    assert i.count() == 4                                                # the spine has 2 x 1,441 rows
    assert balances_at(i, []).count() == 0 and balances_at(i, [dt.date(1899, 12, 1)]).count() == 0
    assert balances_at(i, [dt.date(1950, 6, 1)]).columns == ["acc", "month", "balance"]
    with pytest.raises(ValueError, match="months"):
        balances_at(i, [dt.date(1900 + k // 12, 1 + k % 12, 1) for k in range(MAX_MONTHS + 1)])


def test_asked_months_need_no_join(spark):
    i = _intervals(spark, [("a", FEB, 3)])
    plan = balances_at(i, [JAN, FEB])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "PythonUDF" not in plan
    assert plan.count("Exchange hashpartitioning") == 2                  # the sums by month, the months by key


def test_empty_tables(spark):
    assert _intervals(spark, []).count() == 0
    assert _rows(_intervals(spark, [], every=["a"])) == [("a", ALWAYS, None, 0)]
