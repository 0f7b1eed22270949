"""Control breaks and accumulators on hand-made rows (FIXTURES.md §3)."""

from decimal import Decimal

from pyspark.sql import functions as F

from ledgerflow.operators import bands


def test_breaks_follow_row_order_not_key(spark):
    df = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B"), (4, "A"), (5, None), (6, None), (7, "A")],
                               "pos int, k string")
    got = bands.with_breaks(df, ["k"], ["pos"]).orderBy("pos").select("run_id").collect()
    assert [r.run_id for r in got] == [1, 1, 2, 3, 4, 4, 5]


def test_breaks_per_partition_and_nested_keys(spark):
    df = spark.createDataFrame(
        [("x", 1, "A", "a"), ("x", 2, "A", "a"), ("x", 3, "B", "a"), ("y", 1, "B", "a"), ("y", 2, "B", "b")],
        "book string, pos int, outer string, inner string")
    got = bands.with_breaks(df, ["outer", "inner"], ["pos"], by=["book"]).orderBy("book", "pos")
    assert [r.run_id for r in got.collect()] == [1, 1, 2, 1, 2]
    plain = bands.with_breaks(df, ["outer", "inner"], ["pos"], by=["book"], plain=True).orderBy("book", "pos")
    assert [r.run_id for r in plain.collect()] == [1, 1, 2, 1, 2]


def test_resettable_running_restarts_after_zero(spark):
    xs = [0, 5, 0, 3, -3, 2]
    df = spark.createDataFrame([("acc", i, Decimal(x)) for i, x in enumerate(xs)], "k string, pos int, x decimal(18,2)")
    got = bands.resettable_running(df, "x", ["k"], ["pos"], F.lit(Decimal(100)).cast("decimal(18,2)"), prev_out="prev")
    rows = got.orderBy("pos").collect()
    # prev 0/absent restarts at opening + x; otherwise previous acc + x
    assert [float(r.acc) for r in rows] == [100, 105, 105, 103, 100, 102]
    assert [None if r.prev is None else float(r.prev) for r in rows] == [None, 0, 5, 0, 3, -3]


def test_breaks_with_forced_chunks(spark):
    spark.conf.set("ledgerflow.scan.chunks", "7")
    try:
        df = spark.createDataFrame([(i, k) for i, k in enumerate("AABAABBBAC")], "pos int, k string")
        got = bands.with_breaks(df, ["k"], ["pos"]).orderBy("pos").select("run_id").collect()
    finally:
        spark.conf.unset("ledgerflow.scan.chunks")
    assert [r.run_id for r in got] == [1, 1, 2, 3, 3, 4, 4, 4, 5, 6]
