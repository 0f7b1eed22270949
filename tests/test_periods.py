"""Stored period balances against the full sum, after inserts, corrections, deletions and failures."""

import datetime as dt
import tempfile
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerflow.sources.periods import MONTH, YEAR, PeriodBalances

BASE = [("a", dt.date(1997, 11, 3), 5), ("b", dt.date(1997, 12, 31), 7), ("a", dt.date(1998, 1, 1), 11),
        (None, dt.date(1998, 2, 2), 13), ("a", dt.date(1998, 3, 1), 17), ("a", dt.date(1998, 3, 9), 19), ("b", dt.date(1999, 1, 1), 23)]


def _lines(spark, rows):
    return spark.createDataFrame(rows, "acc string, d date, v int").withColumn("amt", F.col("v").cast("decimal(18,2)"))


def _store(spark):
    path = tempfile.mkdtemp(prefix="ledgerflow-periods-") + "/store"
    return PeriodBalances(spark, path, ["acc"], "d", [("amt", F.col("amt")), ("n", F.lit(1).cast("long"))])


def _sum(rows, start):
    out = defaultdict(lambda: [0, 0])
    for acc, d, v in rows:
        if d < start:
            out[acc][0] += v
            out[acc][1] += 1
    return {k: tuple(v) for k, v in out.items()}


def _check(spark, store, rows):
    for start in (dt.date(1997, 1, 1), dt.date(1997, 12, 31), dt.date(1998, 1, 1), dt.date(1998, 3, 1), dt.date(1998, 3, 10), dt.date(2003, 5, 5)):
        got = {r.acc: (int(r.amt), r.n) for r in store.before(_lines(spark, rows), start).collect()}
        assert got == _sum(rows, start), start


def test_openings_equal_the_full_sum_after_changes(spark):
    store = _store(spark)
    assert store.refresh(_lines(spark, BASE)) == [199711, 199712, 199801, 199802, 199803, 199901]
    _check(spark, store, BASE)
    first = store.manifest()
    assert store.refresh(_lines(spark, BASE)) == [] and store.manifest() == first       # nothing to do
    late = [*BASE, ("b", dt.date(1998, 2, 20), 100)]                                   # a late line
    assert store.refresh(_lines(spark, late)) == [199802]
    _check(spark, store, late)
    now = store.manifest()
    assert {k for k in now if now[k] != first[k]} == {(MONTH, 199802), (YEAR, 1998)}     # the rest is not written again
    fixed = [(a, d, 6 if v == 5 else v) for a, d, v in late if v != 23]                  # a correction, a whole month gone
    assert store.refresh(_lines(spark, fixed)) == [199711, 199901]
    _check(spark, store, fixed)
    assert (YEAR, 1999) not in store.manifest()


def test_only_named_months_are_looked_at(spark):
    store = _store(spark)
    store.refresh(_lines(spark, BASE))
    late = [*BASE, ("b", dt.date(1998, 2, 20), 100), ("c", dt.date(1999, 6, 1), 50)]
    assert store.refresh(_lines(spark, late), periods=[199906, 199801]) == [199906]
    assert store.refresh(_lines(spark, late), periods=[]) == []
    assert store.refresh(_lines(spark, late)) == [199802]
    _check(spark, store, late)


def test_a_broken_load_leaves_the_old_balances(spark, monkeypatch):
    store = _store(spark)
    store.refresh(_lines(spark, BASE))
    late = [*BASE, ("b", dt.date(1997, 11, 20), 100)]
    with monkeypatch.context() as m:
        m.setattr(store, "_publish", lambda entry: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store.refresh(_lines(spark, late))
    _check(spark, store, BASE)                                                          # data written, manifest not
    spark.createDataFrame([(1,)], "x int").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false") \
         .parquet(f"{store.path}/manifest/version=2")                                   # manifest begun, not complete
    _check(spark, store, BASE)
    assert store.refresh(_lines(spark, late)) == [199711]
    _check(spark, store, late)


def test_no_lines_and_no_date(spark):
    store = _store(spark)
    assert store.refresh(_lines(spark, [])) == [] and store.before(_lines(spark, []), dt.date(1999, 1, 1)).collect() == []
    with pytest.raises(ValueError, match="without d"):
        store.refresh(_lines(spark, [("a", None, 1)]))


def test_an_opening_reads_years_months_and_the_cut_month_only(spark):
    store = _store(spark)
    store.refresh(_lines(spark, BASE))
    files = store.before(_lines(spark, BASE), dt.date(1998, 3, 5)).inputFiles()
    assert sorted({f.split("grain=")[1].rsplit("/", 1)[0] for f in files if "grain=" in f}) == [
        "month/period=199801", "month/period=199802", "year/period=1997"]
