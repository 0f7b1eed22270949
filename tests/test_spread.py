"""A join with one row per key must split a hot key, and agree with the plain join."""

import pytest
from pyspark.sql import functions as F

from ledgerflow.operators.spread import join_per_key
from ledgerflow.plans import REGISTRY

SMALL = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50KB",
         "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}


@pytest.fixture
def small_partitions(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _lines(spark):
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 5000)
    return spark.range(0, 120_000, 1, 12).select(key.alias("k"), "id", F.sha2(F.col("id").cast("string"), 256).alias("x"))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_key_is_split(spark, small_partitions, how):
    rows = _lines(spark)
    per_key = rows.where("k <> 8").groupBy("k").agg(F.sum("id").alias("t"))
    totals = [df.agg(F.sum(F.xxhash64("k", "id", "t").cast("decimal(38,0)")), F.count(F.lit(1)))
              for df in (rows.join(per_key, "k", how), join_per_key(rows, per_key, ["k"], how))]
    assert totals[0].collect() == totals[1].collect()
    plain, spread = (t._jdf.queryExecution().executedPlan().toString() for t in totals)
    assert "skew=true" in spread and "skew=true" not in plain


def test_null_keys_meet_nothing(spark):
    rows = spark.createDataFrame([(None, 1), (2, 2)], "k long, v int")
    per_key = spark.createDataFrame([(None, 5), (2, 6)], "k long, t int")
    assert sorted(map(tuple, join_per_key(rows, per_key, ["k"], "left").collect()), key=str) == [(2, 2, 6), (None, 1, None)]


@pytest.mark.parametrize("name", ["running_ledger", "general_ledger", "accumulator_ledger", "numbered_lines", "control_break_runs"])
def test_totals_come_from_the_scan(spark, name, small_partitions):
    """No join of these reports but on the second key, the summary's chunk or nothing (scalars)."""
    plan = REGISTRY[name].build(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join " in x]
    keyed = [x for x in joins if "Inner" in x and "rightHint=(strategy=broadcast)" not in x and "_spread" not in x and "=" in x]
    assert all("o_orderkey" in x for x in keyed), keyed     # posted documents only
