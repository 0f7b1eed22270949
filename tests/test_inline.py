"""Literal relations hold distinct rows."""

import pytest
from pyspark.sql import functions as F

from ledgerflow.sources import inline, where_in


def test_duplicate_literals_do_not_fan_out(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, v string")
    codes = inline.values(spark, [(1, "one"), (1, "one"), [2, "two"], (2, "two")], "k int, name string")
    assert sorted(map(tuple, rows.join(codes, "k").collect())) == [(1, "x", "one"), (2, "y", "two")]


def test_bound_counts_distinct_rows(spark, monkeypatch):
    monkeypatch.setattr(inline, "MAX_INLINE_ROWS", 3)
    assert inline.values(spark, [(i % 3,) for i in range(9)], "k int").count() == 3
    with pytest.raises(ValueError):
        inline.values(spark, [(i,) for i in range(4)], "k int")


def test_parameter_lists_of_any_length(spark, monkeypatch):
    rows = spark.range(0, 300_000, 7).select("id", (F.col("id") % 5).alias("r"))
    rows = rows.unionByName(spark.createDataFrame([(None, 1), (14, 2)], "id long, r long"))
    assert where_in(rows, "id", None).count() == where_in(rows, "id", []).count() == rows.count()
    assert where_in(rows, "id", [None]).count() == 0
    assert sorted(r.id for r in where_in(rows, "id", [14, 14, 21, None, 22]).collect()) == [14, 14, 21]
    many = [*range(50_000, 150_000), 50_001, None]                      # 100,000 ids, a repeat and a NULL
    got = where_in(rows, "id", many)
    assert sorted(r.id for r in got.collect()) == [i for i in range(0, 300_000, 7) if 50_000 <= i < 150_000]
    short = where_in(rows, "id", range(49_000, 50_000))
    monkeypatch.setattr(inline, "MAX_INLINE_ROWS", 10)
    assert sorted(where_in(rows, "id", range(49_000, 50_000)).collect()) == sorted(short.collect())


def test_long_lists_push_their_bounds(spark):
    plan = where_in(spark.read.parquet("/root/testdata/sf0.001/orders.parquet"), "o_orderkey", range(100, 20_000))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderkey,100)" in text and "LessThanOrEqual(o_orderkey,19999)" in text
