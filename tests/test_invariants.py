"""Invariants of SURVEY §5 on the registered reports (sf0.001)."""

import math

from pyspark.sql import functions as F

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def q(spark, name):
    return E.queries()[name](spark, SF)


def test_opening_plus_movement_is_closing(spark):
    for r in q(spark, "opening_balance").collect():
        assert math.isclose(r.opening + r.movement, r.closing, abs_tol=1e-6)
    tb = q(spark, "trial_balance")
    for r in tb.collect():
        assert math.isclose(r.opening + r.debit - r.credit, r.closing, abs_tol=1e-6)


def test_rollup_total_is_sum_of_leaves(spark):
    tb = q(spark, "trial_balance")
    leaves = tb.where(F.col("gid") == 0).agg(F.sum("closing").alias("s"), F.sum("debit").alias("d")).first()
    grand = tb.where(F.col("gid") == 15).first()
    assert math.isclose(leaves.s, grand.closing, abs_tol=1e-6) and math.isclose(leaves.d, grand.debit, abs_tol=1e-6)


def test_pivot_row_sum_equals_long_sum(spark):
    wide = q(spark, "wide_pivot_sum").agg(F.sum(F.col("qty_a") + F.col("qty_n") + F.col("qty_r")).alias("w")).first().w
    long_sum = spark.read.parquet(f"{SF}/lineitem.parquet").agg(F.sum("l_quantity").alias("s")).first().s
    assert math.isclose(wide, long_sum, abs_tol=1e-6)


def test_share_rows_add_up_to_total_row(spark):
    rows = q(spark, "status_share_total").collect()
    total = [r.total_state for r in rows if r.state_label == "Total"][0]
    assert math.isclose(sum(r.total_state for r in rows if r.state_label != "Total"), total, abs_tol=1e-6)


def test_results_do_not_depend_on_partition_count(spark):
    names = ["running_ledger", "control_break_runs", "wide_pivot_last", "master_detail_lines"]
    before = {n: sorted(map(tuple, q(spark, n).collect()), key=repr) for n in names}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    spark.conf.set("ledgerflow.scan.chunks", "12")
    try:
        after = {n: sorted(map(tuple, q(spark, n).collect()), key=repr) for n in names}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("ledgerflow.scan.chunks")
    assert before == after
