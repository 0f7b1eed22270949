"""Published reports: replaced partitions, reruns, writes that break off, and what a reader sees."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from ledgerflow.plans import REGISTRY
from ledgerflow.plans.books import republished_journal
from ledgerflow.sources import PublishedReport

SF = "/root/testdata/sf0.001"
FIRST = [("2024", "a", 1), ("2024", "b", 2), ("2025", "a", 3), (None, "x", 4), ("", "y", 5), ("a/b=c %", "z", 6)]


def _df(spark, rows):
    return spark.createDataFrame(rows, "period string, acc string, v int")


def _report(spark, column="period"):
    return PublishedReport(spark, tempfile.mkdtemp(prefix="ledgerflow-published-") + "/report", column)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_partitions_are_replaced_as_a_whole(spark):
    r = _report(spark)
    assert r.publish(_df(spark, FIRST)) == [None, "", "2024", "2025", "a/b=c %"]
    assert _rows(r.read()) == sorted(FIRST, key=str)
    before = r.partitions()
    again = [("2024", "c", 7), (None, "n", 8)]
    assert r.publish(_df(spark, again)) == [None, "2024"]
    assert _rows(r.read()) == sorted([x for x in FIRST if x[0] not in (None, "2024")] + again, key=str)
    assert {p for p, v in r.partitions().items() if v != before[p]} == {None, "2024"}       # the rest is not written again
    assert r.publish(_df(spark, again)) == [None, "2024"]                                    # a rerun gives the same report
    assert _rows(r.read([None, "2024"])) == sorted(again, key=str)
    assert _rows(r.read(["", "none"])) == [("", "y", 5)]


def test_partitions_without_rows_become_empty_when_they_are_named(spark):
    r = _report(spark)
    r.publish(_df(spark, FIRST))
    assert r.publish(_df(spark, [("2025", "q", 9)]), replace=["2024", "2025", None, "2030"]) == [None, "2024", "2025"]
    assert set(r.partitions()) == {"", "2025", "a/b=c %"}
    assert r.publish(_df(spark, [])) == []
    with pytest.raises(ValueError, match="not to be replaced"):
        r.publish(_df(spark, [("2031", "q", 9)]), replace=["2025"])
    assert r.publish(_df(spark, []), replace=["", "2025", "a/b=c %"]) == ["", "2025", "a/b=c %"]
    assert r.read().columns == ["period", "acc", "v"] and r.read().count() == 0
    assert r.publish(_df(spark, FIRST[:1])) == ["2024"] and _rows(r.read()) == FIRST[:1]


def test_readers_see_the_old_report_while_a_write_is_unfinished(spark, monkeypatch):
    r = _report(spark)
    with pytest.raises(ValueError, match="nothing is published"):
        r.read()
    r.publish(_df(spark, FIRST))

    def broken(*a, **k):
        raise RuntimeError("lost")
    with monkeypatch.context() as m:                                   # the data is there, the manifest isn't
        m.setattr(type(spark), "createDataFrame", broken)
        with pytest.raises(RuntimeError):
            r.publish(spark.sql("SELECT '2024' AS period, 'new' AS acc, CAST(1 AS INT) AS v"))
    assert _rows(r.read()) == sorted(FIRST, key=str)
    os.makedirs(f"{r.path}/manifest/version=2")                        # a manifest that was never finished
    assert _rows(r.read()) == sorted(FIRST, key=str)
    assert r.publish(_df(spark, [("2024", "new", 1)])) == ["2024"]     # the run is repeated
    assert _rows(r.read(["2024"])) == [("2024", "new", 1)]


def test_a_reader_of_the_old_report_keeps_it(spark):
    r = _report(spark)
    r.publish(_df(spark, FIRST))
    old = r.read()
    r.publish(_df(spark, [("2024", "new", 1)]))
    assert _rows(old) == sorted(FIRST, key=str)


def test_other_columns_are_refused(spark):
    r = _report(spark)
    r.publish(_df(spark, FIRST))
    with pytest.raises(ValueError, match="other columns"):
        r.publish(_df(spark, FIRST).withColumn("v", F.col("v").cast("long")))


def test_dates_decimals_and_clashing_names(spark):
    rows = [(dt.date(2024, 1, 1), "a", 1), (dt.date(2024, 2, 1), None, None)]
    df = spark.createDataFrame(rows, "day date, load string, part int").withColumn("amt", F.lit("1.25").cast("decimal(18,2)"))
    r = _report(spark, "day")
    assert r.publish(df.withColumnRenamed("load", "cargo")) == ["2024-01-01", "2024-02-01"]
    back = r.read([dt.date(2024, 2, 1)])
    assert back.schema.simpleString() == "struct<day:date,cargo:string,part:int,amt:decimal(18,2)>"
    assert [tuple(x)[:3] for x in back.collect()] == [rows[1]]
    with pytest.raises(ValueError, match="name"):
        _report(spark, "day").publish(df)


def test_only_asked_partitions_are_read(spark):
    r = _report(spark)
    r.publish(_df(spark, [(str(y), "a", y) for y in range(2000, 2020)]))
    p = r.read(["2003"])
    scan = p._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and "_part" in scan.split("PartitionFilters: [")[1].split("]")[0]
    files = {x["f"] for x in p.select(F.input_file_name().alias("f")).distinct().collect()}
    assert len(files) == 1 and "p2003" in files.pop()


def test_the_journal_is_published_in_two_parts(spark):
    path = tempfile.mkdtemp(prefix="ledgerflow-published-") + "/journal"
    got = republished_journal(spark, SF, store=path)
    loads = {}
    for part, (load, _) in PublishedReport(spark, path, "period").partitions().items():
        loads.setdefault(load, []).append(int(part))
    early, late = sorted(loads.values())
    assert max(early) == 199802 and min(late) == 199803
    assert got.count() == sum(n for _, n in PublishedReport(spark, path, "period").partitions().values())
    assert "republished_journal" in REGISTRY
